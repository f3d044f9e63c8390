"""Repeated, unresolved questions: does a message restate an earlier one of its thread?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadwise.config import Settings
from threadwise.functions import text as X
from threadwise.lexicon import Lexicon
from threadwise.operators.ordered import int_chunk
from threadwise.session import reliable

NEAR_ROWS = 64


def similar(a: Column, b: Column, settings: Settings) -> Column:
    """Two structs of (tok, con): broadly alike, or enough content words in common."""
    alike = X.set_jaccard(a["tok"], b["tok"]) >= settings.repeat_jaccard
    shared = F.size(F.array_intersect(a["con"], b["con"])) >= settings.repeat_shared_words
    return alike | shared


def is_repeat(
    conv: DataFrame,
    lexicon: Lexicon,
    settings: Settings = Settings(),
    role: str = "user",
    key: str = "conv_id",
    order: str = "turn",
    text: str = "text",
    near_rows: int = NEAR_ROWS,
) -> DataFrame:
    """Messages of ``role`` as (key, order, is_repeat), exact for threads of any length.

    Earlier messages of the same stretch of ``near_rows`` turns are compared in place. Only threads
    longer than one stretch go on: their copies are folded to the first of each token set, and
    distinct sets meet through shared prefix tokens (``_restated``), never as all pairs.
    """
    cleaned = X.clean_text(F.col(text), abbreviations=lexicon.abbreviations)
    msgs = (
        conv.where(F.col("role") == role)
        .withColumn("_clean", cleaned)
        .select(
            key,
            order,
            X.token_set(F.col("_clean")).alias("tok"),
            X.content_words(F.col("_clean"), lexicon.content_stop).alias("con"),
        )
        .withColumn("_chunk", int_chunk(order, near_rows))
    )
    near = Window.partitionBy(key, "_chunk").orderBy(order)
    me = F.struct("tok", "con")
    rows = msgs.withColumn("_me", me).withColumn(
        "_before", F.collect_list("_me").over(near.rowsBetween(Window.unboundedPreceding, -1))
    )
    rows = rows.withColumn(
        "is_repeat", F.exists("_before", lambda b: similar(F.col("_me"), b, settings))
    ).select(key, order, "tok", "_chunk", "is_repeat")

    long_threads = msgs.where("_chunk > 0").select(key).distinct()
    far = _restated(msgs.join(long_threads, key, "left_semi"), key, order, settings)
    joined = rows.join(far, [key, order], "left")
    # A message of a long thread that is not the first of its token set is a copy of the first.
    copy = (F.col("_chunk") > 0) & F.col("_far").isNull() & (F.size("tok") > 0)
    return joined.select(
        key,
        order,
        (F.col("is_repeat") | copy | F.coalesce("_far", F.lit(False))).alias("is_repeat"),
    )


def _restated(msgs: DataFrame, key: str, order: str, settings: Settings) -> DataFrame:
    """First messages of each token set as (key, order, _far): like an earlier set or not. The sets are
    joined to the pairs that can be alike."""
    sets = msgs.groupBy(key, F.array_sort("tok").alias("tok"), F.array_sort("con").alias("con")).agg(
        F.min(order).alias(order)
    )
    sets = reliable(sets)
    pairs = candidate_pairs(sets, key, order, settings)
    side = lambda at, out: sets.select(key, F.col(order).alias(at), F.struct("tok", "con").alias(out))
    met = pairs.join(side("_later", "_me"), [key, "_later"]).join(side("_earlier", "_them"), [key, "_earlier"])
    hits = met.where(similar(F.col("_me"), F.col("_them"), settings)).select(key, F.col("_later").alias(order)).distinct()
    return sets.select(key, order).join(hits.withColumn("_far", F.lit(True)), [key, order], "left").select(
        key, order, F.coalesce("_far", F.lit(False)).alias("_far")
    )


def candidate_pairs(sets: DataFrame, key: str, order: str, settings: Settings) -> DataFrame:
    """(key, _later, _earlier) of all sets of a thread that can be alike.

    Prefix filter: a set's tokens are sorted by how many sets of the thread hold them, rarest first. Two sets that
    share enough must share a token within their prefixes, so only such pairs come out. What is
    shuffled to find them is ids.
    """
    size = {"tok": F.size("tok"), "con": F.size("con")}
    keep = {
        "tok": size["tok"] - F.ceil(size["tok"] * F.lit(settings.repeat_jaccard)).cast("int") + 1,
        "con": size["con"] - settings.repeat_shared_words + 1,
    }
    word = lambda c: F.transform(c, lambda t: F.struct(F.lit(c).alias("kind"), t.alias("t"), keep[c].alias("keep")))
    words = sets.select(key, order, F.inline(F.concat(word("tok"), word("con")))).where("keep > 0")
    spread = words.groupBy(key, "kind", "t").agg(F.count(F.lit(1)).alias("met"))
    # a set's words are all that one window group holds
    rare = Window.partitionBy(key, order, "kind").orderBy("met", "t")
    posts = words.join(spread, [key, "kind", "t"]).withColumn("_at", F.row_number().over(rare))
    # a word of one set only meets nothing
    posts = posts.where((F.col("_at") <= F.col("keep")) & (F.col("met") > 1)).select(key, "kind", "t", F.col(order).alias("_later"))
    earlier = posts.withColumnRenamed("_later", "_earlier")
    return posts.join(earlier, [key, "kind", "t"]).where("_earlier < _later").select(key, "_later", "_earlier").distinct()
