"""Operator 7: mixing sources to target weights by a low-discrepancy schedule.

Sources in code point order, null last, weigh 5, 2, 1, repeating. They share ``share`` times all words;
a target stops at ``epochs`` times its source's size and the excess goes to the others by weight. Each
source's documents are put in a seeded random order, and their words are cut into blocks of equal size.
Golden-ratio points, mapped through the cumulative targets, give each slot of the schedule a source; the
r-th slot of a source takes its r-th block (a second round of the source begins when the first is used
up). Slots that a source no longer needs are skipped, and the few that low discrepancy leaves short
follow at the end; its last block is cut at the target. So a source's taken words are its target, rounded.

Defined cases: a null text has size 0 and nothing is taken of it; a null source is a source of its own;
equal rows are documents of their own; an empty table gives no row; a clashing name is refused by Spark as
ambiguous, so the added columns are named in ``ADDED`` and replaced if the input has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadwise.llm.common import count_words, partitions
from threadwise.session import reliable

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
BLOCK = 256
SEED = "mix"
CELLS = 4096
CHUNK = 1 << 16
#: Golden-ratio step on the circle of 2**31 points.
CIRCLE, STEP = 1 << 31, 1_327_217_885

ADDED = ("size", "source_size", "target", "taken", "first_slot")


def source_key(source: Column) -> Column:
    """Sorts by code point, null last; never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("~"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(_src, source_size) to (_src, source_size, target, goal, lo, hi): one row per source.

    With the sources sorted by cap / weight, those capped come first; the others share what is left."""
    pattern = F.array(*[F.lit(w) for w in weights])
    one = Window.orderBy("_src")
    rows = sizes.withColumn("_w", F.element_at(pattern, (F.pmod(F.row_number().over(one) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(epochs))
    whole = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), "_src")
    before, everything = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    rows = rows.withColumn("_level", left / weight)
    rows = rows.withColumn("_free", F.col("_cap") > F.col("_level") * F.col("_w"))
    level = F.max(F.when(F.col("_free"), F.col("_level"))).over(everything)
    rows = rows.withColumn("target", F.when(F.col("_free"), level * F.col("_w")).otherwise(F.col("_cap").cast("double")))
    rows = rows.withColumn("goal", F.least(F.round("target").cast("long"), F.col("_cap")))
    upto = Window.orderBy("_src").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.orderBy("_src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("hi", F.floor(F.sum("goal").over(upto) * F.lit(float(CIRCLE)) / F.greatest(F.lit(1), F.sum("goal").over(all_))).cast("long"))
    rows = rows.withColumn("lo", F.coalesce(F.lag("hi").over(one), F.lit(0)))
    return rows.select("_src", "source_size", "target", "goal", "lo", "hi")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(_src, rank, slot): the slot of the schedule that takes each needed block of each source."""
    spark = sources.sparkSession
    need = F.ceil(F.col("goal") / F.lit(float(block))).cast("long")
    rows = sources.withColumn("need", need).where("need > 0")
    n = rows.agg(F.coalesce(F.sum("need"), F.lit(0))).head()[0]
    width = CIRCLE // CELLS
    ranges = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.greatest("hi", F.col("lo") + 1) - 1) / width))))
    points = spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(CIRCLE)) * F.lit(STEP), F.lit(CIRCLE)).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") / width))
    drawn = points.join(ranges, "cell").where("u >= lo AND u < hi").select("_src", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    drawn = reliable(drawn)
    sums = drawn.groupBy("_src", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_src", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("own", own).join(sums, ["_src", "chunk"]).select("_src", (F.col("base") + F.col("own")).alias("rank"), "slot")
    had = sums.groupBy("_src").agg(F.sum("n").alias("had"))
    short = rows.join(had, "_src", "left").select("_src", F.coalesce("had", F.lit(0)).alias("had"), "need").where("had < need")
    late = short.select("_src", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank")).select("_src", "rank", (F.lit(n) + F.col("rank")).alias("slot"))
    return ranked.unionByName(late)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK, seed: str = SEED, rows_per_bucket: int = 20_000) -> DataFrame:
    """The input's columns (the text too, if given) and ``ADDED``. ``size`` is counted here unless
    ``text_col`` names no column and the input brings ``size``.

    A source is cut into buckets of its random order, so a hot one is spread over many tasks; what is
    summed per source is one row per bucket."""
    if text_col in docs.columns:
        docs = docs.drop("size").withColumn("size", count_words(F.col(text_col)))
    docs = docs.drop(*[c for c in ADDED if c != "size" and c in docs.columns])
    spark, n_docs = docs.sparkSession, docs.count()
    n = 1
    while n < min(65_536, max(partitions(spark), n_docs // rows_per_bucket)):
        n *= 2
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.withColumn("_src", source_key(F.col(source_col))).withColumn("_mark", mark)
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("_mark", 1, 4), 16, 10).cast("long") * n / 65_536))
    sums = reliable(rows.groupBy("_src", "_bucket").agg(F.sum("size").alias("_n")))
    sizes = sums.groupBy("_src").agg(F.sum("_n").alias("source_size"))
    goals = reliable(targets(sizes))
    before = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").join(goals.drop("lo", "hi"), "_src")
    order = [F.col("_mark"), F.col(id_col), F.col("size")] + ([F.xxhash64(text_col)] if text_col in docs.columns else [])
    inside = Window.partitionBy("_src", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = rows.join(sums, ["_src", "_bucket"]).withColumn("_at", F.col("_base") + F.col("_own")).drop("_base", "_own", "_mark")
    narrow = placed.where("size > 0").select("_src", "_at", "size", "source_size", "goal")
    rounds = narrow.withColumn("_from", F.explode(F.transform(F.sequence(F.lit(0), F.lit(EPOCHS - 1)), lambda e: e * F.col("source_size") + F.col("_at"))))
    rounds = rounds.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("goal"))).where("_from < _to")
    first, last = F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block)
    pieces = rounds.withColumn("rank", F.explode(F.sequence(first, last)))
    words = F.least(F.col("_to"), (F.col("rank") + 1) * block) - F.greatest(F.col("_from"), F.col("rank") * block)
    pieces = pieces.select("_src", "rank", "_at", words.alias("_words"))
    used = pieces.join(schedule(goals, block), ["_src", "rank"]).groupBy("_src", "_at").agg(F.sum("_words").alias("taken"), F.min("slot").alias("first_slot"))
    used = reliable(used.withColumn("_some", F.lit(True)))
    out = placed.withColumn("_some", F.col("size") > 0).join(used, ["_src", "_at", "_some"], "left")
    return out.withColumn("taken", F.coalesce("taken", F.lit(0))).select(*[c for c in docs.columns if c != "size"], *ADDED)
