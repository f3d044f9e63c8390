"""The flagship query: conversations to routing decisions, counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwise.functions.text import squish
from threadwise.lexicon import Lexicon
from threadwise.operators.classify import classify_rules
from threadwise.operators.routing import route
from threadwise.operators.threads import with_depth
from threadwise.plans.fixture import FIXTURE


def routed_turns(conv: DataFrame, lexicon: Lexicon = FIXTURE) -> DataFrame:
    """Every customer turn with its classification, context verdict, depth and routing."""
    rows = with_depth(conv).where(F.col("role") == "user").withColumn("text", squish(F.col("text")))
    return route(classify_rules(rows, lexicon, keep_safety="safety"), lexicon)


def routing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return (
        routed_turns(conv)
        .groupBy(F.col("classification.intent").alias("intent"), F.col("routing.decision").alias("decision"))
        .agg(F.count(F.lit(1)).alias("n_messages"), F.round(F.avg("classification.confidence"), 6).alias("mean_confidence"))
    )
