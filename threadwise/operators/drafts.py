"""Drafting from templates, checking drafts against their evidence, choosing the final draft."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwise import fixed_values as fixed
from threadwise.fixed_values import ERROR_METHOD
from threadwise.functions import text as X
from threadwise.lexicon import Lexicon

SHORT = "empty_or_too_short"


def draft_from_templates(
    df: DataFrame,
    hits: DataFrame,
    lexicon: Lexicon,
    key: str = "query_id",
    intent: str = "intent",
    top: int = 3,
) -> DataFrame:
    """A fresh reply per query from its intent and its best hits; no reply is copied.

    When two of the best three hits move the customer to a private channel, so does the draft. A
    query with no hits gets an empty draft and the method ``none``.
    """
    private = X.any_contained(F.lower(X.text_or_empty(F.col("brand_reply"))), lexicon.deflection)
    best = (
        hits.where(F.col("rank") <= top)
        .groupBy(key)
        .agg(
            F.sum(private.cast("int")).alias("_private"),
            F.sort_array(F.collect_list(F.struct("rank", "pair_id"))).alias("_ids"),
        )
        .withColumn("_ids", F.transform("_ids", lambda h: h["pair_id"]))
    )
    table = lambda t: F.create_map(*[F.lit(x) for kv in t.items() for x in kv])
    pick = lambda t: F.coalesce(
        F.try_element_at(table(t), F.col(intent)), F.lit(t.get("", ""))
    )
    df = df.join(best, key, "left").withColumns(
        {"_open": pick(lexicon.opening), "_next": pick(lexicon.next_step)}
    )
    kind = (
        F.when(F.col(intent) == lexicon.override_label, "safety")
        .when(F.col("_private") >= 2, "private")
        .otherwise("open")
    )
    df = df.withColumn("_kind", kind)
    text, pattern = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, form in fixed.DRAFT_FORMATS.items():
        chosen = F.col("_kind") == name
        text = F.when(chosen, F.format_string(form, "_open", "_next")).otherwise(text)
        pattern = F.when(chosen, fixed.DRAFT_PATTERNS[name]).otherwise(pattern)
    found = F.col("_ids").isNotNull()
    why = F.format_string(
        fixed.JUSTIFICATION_FORMAT, F.size("_ids"), F.array_join("_ids", ", "), pattern
    )
    return df.withColumns(
        {
            "draft": F.when(found, text).otherwise(""),
            "cited_example_id": F.when(found, F.get("_ids", 0)).otherwise(""),
            "justification": F.when(found, why).otherwise("no retrieval context"),
            "method": F.when(found, "rules-synth").otherwise("none"),
        }
    ).drop("_private", "_ids", "_open", "_next", "_kind")


def verify_drafts(
    drafts: DataFrame,
    hits: DataFrame,
    lexicon: Lexicon,
    key: str = "query_id",
    intent: str = "intent",
    top: int | None = None,
) -> DataFrame:
    """Add ``ok`` and ``issues``. Hard: too short, a link no evidence shows, a promise of a completed
    action. Soft (``ok`` stays true): pure deflection, a safety reply without a calming word. All hits
    given are evidence, or those up to rank ``top``."""
    evidence = (
        (hits if top is None else hits.where(F.col("rank") <= top))
        .groupBy(key)
        .agg(F.collect_list(F.lower(X.text_or_empty(F.col("brand_reply")))).alias("_evidence"))
    )
    df = drafts.join(evidence, key, "left")
    df = df.withColumns(
        {"_low": F.lower(X.text_or_empty(F.col("draft"))), "_links": X.urls(F.col("draft"))}
    )
    # A link holds no white space, so it lies within one reply or in none.
    shown = lambda u: F.exists(
        F.coalesce("_evidence", F.array().cast("array<string>")), lambda e: F.contains(e, F.lower(u))
    )
    hard = F.concat(
        F.transform(
            F.filter("_links", lambda u: ~shown(u)), lambda u: F.concat(F.lit("invented_url:"), u)
        ),
        F.transform(
            X.contained(F.col("_low"), lexicon.promises),
            lambda p: F.concat(F.lit("unsupported_promise:"), p),
        ),
    )
    calm = X.any_contained(F.col("_low"), lexicon.calm_words)
    soft = F.array_compact(
        F.array(
            F.when(
                X.is_deflection(F.col("draft"), lexicon.deflection, lexicon.deflection_words),
                "dm_deflection_soft",
            ),
            F.when((F.col(intent) == lexicon.override_label) & ~calm, "safety_tone_missing_soft"),
        )
    )
    short = X.word_count(F.col("draft")) < 4
    empty = F.col("_evidence").isNull() & (F.col("_low") == "")
    df = df.withColumns({"_hard": hard, "_soft": soft, "_short": short})
    return df.withColumns(
        {
            "ok": ~F.col("_short") & (F.size("_hard") == 0),
            "issues": F.when(empty, F.array(F.lit("no_retrieval")))
            .when(F.col("_short"), F.array(F.lit(SHORT)))
            .otherwise(F.concat("_hard", "_soft")),
        }
    ).drop("_evidence", "_low", "_links", "_hard", "_soft", "_short")


def choose_draft(
    candidates: DataFrame, key: str = "query_id", attempt: str = "attempt", error: str | None = None
) -> DataFrame:
    """The first attempt that passed, else the last attempt (the template), marked as a fallback.

    ``error`` names the kind of error an attempt ended with, or null. An error before any attempt passed
    also leads to the template, and the method says so."""
    rest = [c for c in candidates.columns if c not in (key, attempt, error)]
    whole = F.struct(attempt, *rest)
    kind = F.col(error) if error else F.lit(None).cast("string")
    picked = candidates.groupBy(key).agg(
        F.min_by(whole, F.when(F.col("ok"), F.col(attempt))).alias("_pass"),
        F.max_by(whole, F.col(attempt)).alias("_last"),
        F.min(attempt).alias("_start"),
        F.min(F.when(F.col("ok"), F.col(attempt))).alias("_passed"),
        F.min(F.when(kind.isNotNull(), F.struct(F.col(attempt).alias("at"), kind.alias("kind")))).alias("_error"),
    )
    broke = F.coalesce(F.col("_error.at") < F.col("_passed"), F.col("_error").isNotNull())
    chosen = picked.select(
        key, "_start", F.when(broke, F.col("_error.kind")).alias("_kind"), F.when(broke, F.col("_last")).otherwise(F.coalesce("_pass", "_last")).alias("c")
    ).select(key, "_start", "_kind", "c.*")
    if "method" in rest:
        late = (F.col(attempt) > F.col("_start")) & F.col("method").startswith("rules")
        method = F.when(F.col("_kind").isNotNull(), F.format_string(ERROR_METHOD, "_kind")).when(late, F.concat("method", F.lit(" (verify_fallback)")))
        chosen = chosen.withColumn("method", method.otherwise(F.col("method")))
    return chosen.drop("_start", "_kind")


def verification_rate(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("ok").cast("int")).alias("n_pass"),
        F.avg(F.col("ok").cast("double")).alias("pass_rate"),
        F.sum(
            F.exists("issues", lambda i: i.startswith("invented_url") | i.startswith("unsupported_promise")).cast("int")
        ).alias("n_hard_fail"),
    )
