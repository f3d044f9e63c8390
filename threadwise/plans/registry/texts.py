"""Text functions over whole documents and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwise.functions import text as X
from threadwise.operators import responses
from threadwise.operators.retrieval import minmax_scale
from threadwise.plans.registry import common as c
from threadwise.plans.registry.common import L, table


def d1_squish(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.squish(F.col("text")).alias("squished"))


def d2_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


def d3_collapse_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", X.collapse_repeats(F.col("text")).alias("collapsed")
    )


EXPANSIONS = {"th": "the", "re": "reply", "to": "towards"}


def d4_expand(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", X.expand(F.lower("text"), EXPANSIONS).alias("expanded")
    )


def d5_words(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select("lang", F.explode(X.words(F.col("text"))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def d6_norm_key(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", X.norm_key(F.col("text")).alias("k"))
    return docs.select("doc_id", F.md5(F.col("k").cast("binary")).alias("key_hash"), F.length("k").alias("n_chars"))


def d7_content_id(spark: SparkSession, sf: str) -> DataFrame:
    return c.pairs(spark, sf).select(
        "pair_id", X.content_id(F.col("customer_msg"), F.col("brand_reply")).alias("content_id")
    )


def d8_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return c.pairs(spark, sf).select(
        "pair_id", F.round(X.jaccard(F.col("customer_msg"), F.col("brand_reply")), 6).alias("jaccard")
    )


def d9_shared_content(spark: SparkSession, sf: str) -> DataFrame:
    shared = X.shared_content(F.col("customer_msg"), F.col("brand_reply"), L.content_stop)
    return c.pairs(spark, sf).select("pair_id", F.array_join(F.array_sort(shared), " ").alias("shared"))


def d11_urls(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.explode(X.urls(F.col("text"))).alias("url"))
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), F.explode(X.urls(F.col("url"))).alias("url")
    )
    return docs.unionByName(pages)


def d12_minmax(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    scaled = minmax_scale(e, "user_id", "value", "scaled")
    return scaled.select("event_id", F.round("scaled", 6).alias("scaled"))


def d13_extract_json(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").select("event_id", noisy().alias("raw"))
    found = responses.extract_json(raw, "raw")
    return found.select("event_id", F.coalesce(F.get_json_object("json", "$.k"), F.lit("none")).alias("k"))


def noisy():
    """Event properties the way models return them: fenced, in prose, or broken."""
    kind, body = F.col("event_type"), F.col("props")
    return (
        F.when(kind == "view", body)
        .when(kind == "click", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == "error", F.concat(F.lit("Sure {here} it is: "), body, F.lit(" done")))
        .when(kind == "purchase", F.concat(F.lit("{broken "), F.substring("props", 2, 3)))
    )


def d14_preview(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.preview(F.col("text"), 60).alias("preview"))


QUERIES = {
    f.__name__: f
    for f in (
        d1_squish, d2_clean_text, d3_collapse_repeats, d4_expand, d5_words, d6_norm_key, d7_content_id,
        d8_jaccard, d9_shared_content, d11_urls, d12_minmax, d13_extract_json, d14_preview,
    )
}

_A, _B = c.tokens(c.clean("customer_msg")), c.tokens(c.clean("brand_reply"))

SQL = {
    "d1_squish": f"SELECT doc_id, {c.squish('text')} AS squished FROM documents",
    "d2_clean_text": f"SELECT doc_id, {c.clean('text')} AS cleaned FROM documents",
    "d3_collapse_repeats": f"SELECT doc_id, {c.collapse('text')} AS collapsed FROM documents",
    "d4_expand": f"SELECT doc_id, {c.expand('lower(text)', EXPANSIONS)} AS expanded FROM documents",
    "d5_words": f"""SELECT lang, word, count(*) AS n FROM (
      SELECT lang, unnest({c.words('text')}) AS word FROM documents) GROUP BY 1, 2""",
    "d6_norm_key": f"""SELECT doc_id, md5(k) AS key_hash, len(k) AS n_chars FROM (
      SELECT doc_id, {c.squish('lower(text)')} AS k FROM documents)""",
    "d7_content_id": f"""WITH {c.PAIRS} SELECT pair_id, substr(sha1(concat(
      {c.squish('lower(customer_msg)')}, '␟', {c.squish('lower(brand_reply)')})), 1, 16) AS content_id FROM pairs""",
    "d8_jaccard": f"""WITH {c.PAIRS}, t AS (SELECT pair_id, {_A} AS a, {_B} AS b FROM pairs)
      SELECT pair_id, round({c.jaccard('a', 'b')}, 6) AS jaccard FROM t""",
    "d9_shared_content": f"""WITH {c.PAIRS}, t AS (SELECT pair_id, {_A} AS a, {_B} AS b FROM pairs)
      SELECT pair_id, coalesce(array_to_string(list_sort(list_intersect({c.content('a')}, {c.content('b')})), ' '), '') AS shared FROM t""",
    "d11_urls": r"""SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\s\p{Z}]+|t\.co/[^\s\p{Z}]+')) AS url FROM documents
      UNION ALL SELECT page_id, unnest(regexp_extract_all(url, 'https?://[^\s\p{Z}]+|t\.co/[^\s\p{Z}]+')) FROM pages""",
    "d12_minmax": """SELECT event_id, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.0 END, 6) AS scaled
      FROM (SELECT event_id, value, min(value) OVER (PARTITION BY user_id) AS lo,
              max(value) OVER (PARTITION BY user_id) AS hi FROM events)""",
    "d13_extract_json": """SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'error')
      THEN json_extract_string(props, '$.k') ELSE 'none' END AS k FROM events""",
    "d14_preview": "SELECT doc_id, substr(replace(text, '|', '/'), 1, 60) AS preview FROM documents",
}
