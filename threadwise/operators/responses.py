"""Use a table of model responses: parse noisy JSON, validate it, fall back to the rules."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threadwise.config import Settings
from threadwise.lexicon import Lexicon
from threadwise.operators.threads import first_per

SCHEMA = "intent STRING, confidence STRING, runner_up STRING, reason STRING"


def _objects(text: str) -> Iterator[str]:
    """Brace-balanced parts of a text, by where they open."""
    opened, spans = [], []
    for i, ch in enumerate(text):
        if ch == "{":
            opened.append(i)
        elif ch == "}" and opened:
            spans.append((opened.pop(), i + 1))
    for start, end in sorted(spans):
        yield text[start:end]


@F.pandas_udf(StringType())
def _scan_json(texts: pd.Series) -> pd.Series:
    def first(text: str | None) -> str | None:
        for part in _objects(text or ""):
            try:
                json.loads(part)
                return part
            except ValueError:
                continue
        return None

    return texts.map(first)


def extract_json(df: DataFrame, raw: str, out: str = "json") -> DataFrame:
    """Add the JSON text found in a noisy response, or null.

    Fences go first. A text which is JSON as a whole is recognised JVM-side; only the others reach
    the Python scan for a balanced object.
    """
    bare = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), "```(?:json)?|```", "")
    bare = F.btrim(bare, F.lit(" \t\r\n\f"))
    df = df.withColumn("_bare", bare).withColumn(
        "_whole", F.try_parse_json("_bare").isNotNull() & (F.col("_bare") != "")
    )
    noisy = F.when(~F.col("_whole") & F.contains("_bare", F.lit("{")), F.col("_bare"))
    return (
        df.withColumn("_noisy", noisy)
        .withColumn(out, F.when(F.col("_whole"), F.col("_bare")).otherwise(_scan_json("_noisy")))
        .drop("_bare", "_whole", "_noisy")
    )


def apply_responses(
    rules: DataFrame,
    responses: DataFrame | None,
    lexicon: Lexicon,
    key: str = "id",
    classification: str = "classification",
    mode: str = "auto",
    settings: Settings = Settings(),
) -> DataFrame:
    """Replace rule results by model responses where a usable response exists.

    ``responses`` holds key, raw, provider. Modes: ``rules`` ignores responses, ``auto`` falls back
    to the rule result and says so in ``method``, ``model`` leaves unusable rows null.
    """
    if mode == "rules" or responses is None:
        return rules
    one = first_per(responses.select(key, "raw", "provider"), [key], ["provider", "raw"])
    parsed = extract_json(one, "raw", "_json").withColumn("_r", F.from_json("_json", SCHEMA))
    joined = rules.join(parsed.drop("raw").withColumn("_given", F.lit(True)), key, "left")

    def label(c: Column) -> Column:
        known = c.isin(list(lexicon.taxonomy))
        return F.when(known, c).otherwise(F.lit(lexicon.default_label))

    number = F.coalesce(F.col("_r.confidence"), F.lit("0.5")).try_cast("double")
    is_object = F.coalesce(F.col("_json").startswith("{"), F.lit(False))
    usable = is_object & number.isNotNull()
    intent = label(F.col("_r.intent"))
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)), 3)
    told = F.trim(F.coalesce("_r.reason", F.lit("")))
    model = F.struct(
        intent.alias("intent"),
        confidence.alias("confidence"),
        label(F.col("_r.runner_up")).alias("runner_up"),
        F.concat(F.lit("llm:"), F.coalesce("provider", F.lit("table"))).alias("method"),
        (confidence < settings.low_confidence).alias("needs_context"),
        F.when(told != "", told)
        .otherwise(F.concat(F.lit("model classified this as "), intent))
        .alias("reason"),
    )
    if mode == "model":
        result = F.when(usable, model)
    else:
        failed = F.col(classification).withField("method", F.lit("rules (llm_error: bad_response)"))
        result = (
            F.when(F.coalesce(usable, F.lit(False)), model)
            .when(F.col("_given"), failed)
            .otherwise(F.col(classification))
        )
    return joined.withColumn(classification, result).drop("_json", "_r", "_given", "provider")


def _parsed(responses: DataFrame, key: str, schema: str) -> DataFrame:
    """(key, _r, _given, provider): the fields of each key's response, null where none was found."""
    one = first_per(responses.select(key, "raw", "provider"), [key], ["provider", "raw"])
    found = extract_json(one, "raw", "_json")
    is_object = F.coalesce(F.col("_json").startswith("{"), F.lit(False))
    return found.select(
        key,
        F.when(is_object, F.from_json("_json", schema)).alias("_r"),
        F.lit(True).alias("_given"),
        "provider",
    )


def _pick(usable: Column, model: Column, rules: str, mode: str) -> Column:
    """The model's answer, or the rule result with a method that says what happened."""
    if mode == "model":
        return F.when(usable, model)
    failed = F.col(rules).withField("method", F.lit("rules (llm_error: bad_response)"))
    return (
        F.when(F.coalesce(usable, F.lit(False)), model)
        .when(F.col("_given"), failed)
        .otherwise(F.col(rules))
    )


def apply_safety_responses(
    rules: DataFrame, responses: DataFrame | None, key: str = "id", safety: str = "safety", mode: str = "auto"
) -> DataFrame:
    """Replace context verdicts by model verdicts {safety, trigger, reason} where one is usable."""
    if mode == "rules" or responses is None:
        return rules
    parsed = _parsed(responses, key, "safety STRING, trigger STRING, reason STRING")
    joined = rules.join(parsed, key, "left")
    flag = F.coalesce(F.col("_r.safety"), F.lit("0"))
    number = F.when(flag == "true", 1).when(flag == "false", 0).otherwise(flag.try_cast("double").cast("int"))
    fired, told = number != 0, F.trim(F.coalesce("_r.reason", F.lit("")))
    trigger = F.trim(F.coalesce("_r.trigger", F.lit("")))
    none = F.array().cast("array<string>")
    model = F.struct(
        fired.alias("is_safety"),
        F.when(trigger != "", F.array(trigger)).otherwise(none).alias("triggers"),
        F.when(told != "", told)
        .otherwise(F.when(fired, "safety incident").otherwise("no safety signal"))
        .alias("reason"),
        F.concat(F.lit("llm:"), F.coalesce("provider", F.lit("table"))).alias("method"),
        none.alias("ignored"),
    )
    usable = F.col("_r").isNotNull() & number.isNotNull()
    return joined.withColumn(safety, _pick(usable, model, safety, mode)).drop("_r", "_given", "provider")


def apply_dissatisfaction_responses(
    rules: DataFrame,
    responses: DataFrame | None,
    key: str = "id",
    explicit: str = "explicit",
    out: str = "dissatisfaction",
    mode: str = "auto",
    settings: Settings = Settings(),
) -> DataFrame:
    """Replace rule results by model results {dissatisfied, score, reason} where one is usable.

    Feedback ``helpful`` and ``human_request`` decides alone; ``not_helpful`` lifts the score.
    """
    if mode == "rules" or responses is None:
        return rules
    parsed = _parsed(responses, key, "dissatisfied STRING, score STRING, reason STRING")
    joined = rules.join(parsed, key, "left")
    said = F.coalesce(F.col(explicit), F.lit(""))
    flag = F.coalesce(F.col("_r.dissatisfied"), F.lit("0"))
    number = F.when(flag == "true", 1).when(flag == "false", 0).otherwise(flag.try_cast("double").cast("int"))
    given = F.coalesce(F.col("_r.score"), F.lit("0")).try_cast("double")
    down = said == "not_helpful"
    score = F.when(down, F.greatest(given, F.lit(0.6))).otherwise(given)
    sad = (number != 0) | (down & (score >= settings.dissatisfaction))
    told = F.trim(F.coalesce("_r.reason", F.lit("")))
    none = F.array().cast("array<string>")
    model = F.struct(
        sad.alias("dissatisfied"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3).alias("score"),
        F.when(told != "", F.array(told))
        .otherwise(F.when(sad, F.array(F.lit("dissatisfied"))).otherwise(none))
        .alias("signals"),
        F.concat(F.lit("llm:"), F.coalesce("provider", F.lit("table"))).alias("method"),
    )
    decided = lambda score, signal: F.struct(
        F.lit(score > 0).alias("dissatisfied"),
        F.lit(score).alias("score"),
        F.array(F.lit(signal)).alias("signals"),
        F.lit("rules").alias("method"),
    )
    usable = F.col("_r").isNotNull() & number.isNotNull() & given.isNotNull()
    result = (
        F.when(said == "helpful", decided(0.0, "explicit_helpful"))
        .when(said == "human_request", decided(1.0, "explicit_human_request"))
        .otherwise(_pick(usable, model, out, mode))
    )
    return joined.withColumn(out, result).drop("_r", "_given", "provider")
