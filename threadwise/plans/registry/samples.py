"""Samples, splits and dataset building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwise.operators import sampling as ops
from threadwise.plans.registry import common as c
from threadwise.plans.registry.common import L, table

LANGS = ("en", "fr", "de", "es")


def c1_disjoint_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return ops.disjoint_split(docs, "doc_id", {"pool": 60, "corpus": 150}, seed=42)


def c2_sample_n(spark: SparkSession, sf: str) -> DataFrame:
    return ops.sample_n(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 60, seed=3)


def c3_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return ops.leakage(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


def c4_attach_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = ops.attach_labels(
        docs.select("doc_id", "text"), labels, "doc_id", labels.where("toxic = 1"), "quality"
    )
    return rows.select("doc_id", "quality", "ambiguous", "notes")


def c5_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return ops.stratified_split(docs, "doc_id", "lang", LANGS, 0.15, seed=42)


def c6_dedup_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return ops.dedup_prefix(table(spark, sf, "documents"), "text", ["doc_id"]).select("doc_id", "text")


def c7_augment(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")
    )
    curated = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("en").alias("label"))
    return ops.augment(docs, curated, ("en", "fr")).select("id", "text", "label")


def c8_weak_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.weak_label(table(spark, sf, "documents"), L)
    return rows.select("doc_id", "label")


def c9_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    weights = ops.class_weights(table(spark, sf, "documents"), "lang", (*LANGS, "it"))
    return weights.select("lang", "n", F.round("weight", 6).alias("weight"))


def c10_label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").withColumn("ambiguous", F.col("toxic") == 1)
    return ops.label_distribution(rows, "quality").select(
        "quality", "n", F.round("share", 6).alias("share"), F.round("ambiguous_share", 6).alias("ambiguous_share")
    )


QUERIES = {
    f.__name__: f
    for f in (
        c1_disjoint_split, c2_sample_n, c3_leakage, c4_attach_labels, c5_stratified_split,
        c6_dedup_prefix, c7_augment, c8_weak_label, c9_class_weights, c10_label_distribution,
    )
}

SQL = {
    "c1_disjoint_split": """SELECT doc_id, lang, CASE WHEN rn <= 60 THEN 'pool' ELSE 'corpus' END AS split FROM (
      SELECT doc_id, lang, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) AS rn FROM documents)
      WHERE rn <= 210""",
    "c2_sample_n": """SELECT doc_id, lang FROM documents
      ORDER BY md5(concat('3:', doc_id)), doc_id LIMIT 60""",
    "c3_leakage": """SELECT n_leaked, n - n_leaked AS n_clean, n_leaked = 0 AS disjoint FROM (
      SELECT count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS n_leaked FROM documents)""",
    "c4_attach_labels": """SELECT doc_id, quality, toxic = 1 AS ambiguous,
      CASE WHEN toxic = 1 THEN 'mixed/context-dependent' ELSE '' END AS notes
      FROM documents JOIN labels USING (doc_id)""",
    "c5_stratified_split": """SELECT doc_id, lang, CASE WHEN rn <= round(0.15::DOUBLE * n) THEN 'val' ELSE 'train' END AS split
      FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n,
        row_number() OVER (PARTITION BY lang ORDER BY md5(concat('42:', doc_id)), doc_id) AS rn FROM documents)""",
    "c6_dedup_prefix": """SELECT doc_id, text FROM (SELECT doc_id, text,
      row_number() OVER (PARTITION BY substr(text, 1, 80) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
    "c7_augment": """SELECT doc_id AS id, text, lang AS label FROM documents WHERE lang IN ('en', 'fr')
      UNION ALL SELECT item_id, text, 'en' FROM benchmark""",
    "c8_weak_label": f"WITH {c.classified('documents', 'doc_id')} SELECT doc_id, intent AS label FROM c_out",
    "c9_class_weights": """WITH t AS (SELECT unnest(['en', 'fr', 'de', 'es', 'it']) AS lang),
      n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
      SELECT lang, coalesce(n, 0) AS n,
        round((SELECT count(*) FROM documents)::DOUBLE / (5 * coalesce(n, 1)), 6) AS weight FROM t LEFT JOIN n USING (lang)""",
    "c10_label_distribution": """SELECT quality, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM labels), 6) AS share,
      round(avg(CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS ambiguous_share FROM labels GROUP BY 1""",
}
