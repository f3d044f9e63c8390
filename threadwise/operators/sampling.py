"""Reproducible samples, splits and dataset building.

Order comes from ``md5(seed:key)``, so a result depends on the data alone and never on partitioning.
Exact global ranks need no global sort: rows are counted per hash bucket (at most 65,536 of them),
the running total of the counts is broadcast, and only buckets that a result can touch are sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadwise.lexicon import Lexicon
from threadwise.operators.classify import classify_rules
from threadwise.operators.threads import first_per

BUCKETS = 65536


def hash_order(key: str, seed: int | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def _bucketed(df: DataFrame, key: str, seed: int | str) -> DataFrame:
    df = df.withColumn("_hash", hash_order(key, seed))
    return df.withColumn("_bucket", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"))


def hash_rank(
    df: DataFrame, key: str, seed: int | str, out: str = "rank", upto: int | None = None
) -> DataFrame:
    """Add the exact 0-based rank in hash order; keep only ranks below ``upto`` when given."""
    rows = _bucketed(df, key, seed)
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_bucket")
        .count()
        .select("_bucket", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("_offset"))
    )
    if upto is not None:
        offsets = offsets.where(F.col("_offset") < upto)
    inside = Window.partitionBy("_bucket").orderBy("_hash", key)
    ranked = rows.join(F.broadcast(offsets), "_bucket").withColumn(
        out, F.col("_offset") + F.row_number().over(inside) - 1
    )
    if upto is not None:
        ranked = ranked.where(F.col(out) < upto)
    return ranked.drop("_bucket", "_hash", "_offset")


def disjoint_split(
    df: DataFrame, key: str, sizes: Mapping[str, int], seed: int = 42, out: str = "split"
) -> DataFrame:
    """Shuffle by hash and cut consecutive parts of the given sizes, e.g. pool then corpus."""
    ranked = hash_rank(df, key, seed, "_rank", upto=sum(sizes.values()))
    name, start = F.lit(None).cast("string"), 0
    for part, size in sizes.items():
        inside = (F.col("_rank") >= start) & (F.col("_rank") < start + size)
        name, start = F.when(inside, part).otherwise(name), start + size
    return ranked.withColumn(out, name).drop("_rank")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample of exactly n rows (all rows when fewer exist)."""
    return hash_rank(df, key, seed, "_rank", upto=n).drop("_rank")


def leakage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` found in ``b``: counts of leaked and clean rows, and whether they are disjoint."""
    leaked = a.join(b.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("n_leaked"))
    total = a.agg(F.count(F.lit(1))).scalar()
    return leaked.select(
        "n_leaked",
        (total - F.col("n_leaked")).alias("n_clean"),
        (F.col("n_leaked") == 0).alias("disjoint"),
    )


def without_leakage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def attach_labels(
    sample: DataFrame, labels: DataFrame, key: str, ambiguous: DataFrame, label: str = "label"
) -> DataFrame:
    """Labelled rows with a flag for those whose key is in the ``ambiguous`` table."""
    flags = ambiguous.select(key).distinct().withColumn("_amb", F.lit(True))
    return (
        sample.join(labels.select(key, label), key)
        .join(flags, key, "left")
        .withColumn("ambiguous", F.coalesce("_amb", F.lit(False)))
        .withColumn("notes", F.when(F.col("ambiguous"), "mixed/context-dependent").otherwise(""))
        .drop("_amb")
    )


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    taxonomy: Sequence[str],
    frac: float = 0.15,
    seed: int = 42,
    names: tuple[str, str] = ("train", "val"),
    out: str = "split",
) -> DataFrame:
    """Put ``round(frac * n)`` rows of each taxonomy label, in hash order, into the second part.

    A label's cut falls inside one hash bucket. Rows of other buckets are decided where they lie;
    only the cut buckets (about 1/65,536 of a label) are shuffled and ranked.
    """
    rows = _bucketed(df.where(F.col(label).isin(list(taxonomy))), key, seed)
    counts = rows.groupBy(label, "_bucket").count()
    by_label = Window.partitionBy(label)
    running = by_label.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        counts.withColumn("_offset", F.coalesce(F.sum("count").over(running), F.lit(0)))
        .withColumn("_take", F.round(F.lit(frac) * F.sum("count").over(by_label)).cast("long"))
        .where("_offset < _take AND _offset + count >= _take")
        .select(label, F.col("_bucket").alias("_cut"), (F.col("_take") - F.col("_offset")).alias("_k"))
    )
    rows = rows.join(F.broadcast(cuts), label, "left")  # at most one row per taxonomy label
    train, val = names
    sure = rows.where("_cut IS NULL OR _bucket <> _cut").withColumn(
        out, F.when(F.col("_bucket") < F.col("_cut"), val).otherwise(train)
    )
    inside = Window.partitionBy(label, "_bucket").orderBy("_hash", key)
    edge = (
        rows.where("_bucket = _cut")
        .withColumn("_rn", F.row_number().over(inside))
        .withColumn(out, F.when(F.col("_rn") <= F.col("_k"), val).otherwise(train))
        .drop("_rn")
    )
    return sure.unionByName(edge).drop("_hash", "_bucket", "_cut", "_k")


def dedup_prefix(
    df: DataFrame, text: str, order: Sequence[str], n: int = 80
) -> DataFrame:
    """Keep the first of the rows which share their first n characters."""
    keyed = df.withColumn("_prefix", F.substring(text, 1, n))
    return first_per(keyed, ["_prefix"], order).drop("_prefix")


def augment(
    df: DataFrame, curated: DataFrame, taxonomy: Sequence[str], label: str = "label"
) -> DataFrame:
    """Add curated examples and keep rows whose label is in the taxonomy."""
    return df.unionByName(curated).where(F.col(label).isin(list(taxonomy)))


def weak_label(df: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "label") -> DataFrame:
    """Label rows with the rule classifier."""
    return classify_rules(df, lexicon, text, out="_c").withColumn(out, F.col("_c.intent")).drop("_c")


def class_weights(df: DataFrame, label: str, taxonomy: Sequence[str]) -> DataFrame:
    """n / (K * count) per label of the taxonomy; a label with no rows counts as one."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    classes = df.sparkSession.createDataFrame([(t,) for t in taxonomy], f"{label} string")
    return classes.join(counts, label, "left").select(
        label,
        F.coalesce("n", F.lit(0)).alias("n"),
        (total / (F.lit(len(taxonomy)) * F.coalesce("n", F.lit(1)))).alias("weight"),
    )


def label_distribution(
    df: DataFrame, label: str = "label", flag: str = "ambiguous"
) -> DataFrame:
    """Rows, share of all rows, and share of ambiguous rows per label."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(flag).cast("double")).alias("ambiguous_share"))
        .withColumn("share", F.col("n") / total)
    )
