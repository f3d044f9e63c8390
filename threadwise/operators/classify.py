"""Rule classification, context detection, and reactions to a reply, as projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwise.config import Settings
from threadwise.functions import text as X
from threadwise.lexicon import Lexicon

METHOD_RULES = "rules"


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


# ---------------------------------------------------------------- context detector


def context_hits(tokens: Column, lexicon: Lexicon, settings: Settings = Settings()) -> Column:
    """Array of (term, note) for every strong or ambiguous term; an empty note means a trigger.

    ``tokens`` must be a plain column of words: the lambdas below read it once per hit.

    A strong term counts unless a negation stands close before it. An ambiguous term needs one of
    its supporting words near by and none of its excluding words; the tests run in the order
    excluding, supporting, negation.
    """
    terms = [*lexicon.strong, *lexicon.ambiguous]
    placed = F.filter(
        F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
        lambda p: p["t"].isin(terms),
    )
    support = {t: v[0] for t, v in lexicon.ambiguous.items()}
    exclude = {t: v[1] for t, v in lexicon.ambiguous.items()}
    negations = _strings(lexicon.negations)
    near, back = settings.context_window, settings.negation_window

    def note(p: Column) -> Column:
        start = F.greatest(p["i"] - near, F.lit(0))
        window = F.slice(tokens, start + 1, p["i"] + near + 1 - start)
        first = F.greatest(p["i"] - back, F.lit(0))
        before = F.transform(
            F.slice(tokens, first + 1, p["i"] - first), lambda t: F.replace(t, F.lit("'"), F.lit(""))
        )
        quoted = F.concat(F.lit("'"), p["t"], F.lit("' ignored "))
        negated = F.when(
            F.arrays_overlap(before, negations), F.concat(quoted, F.lit("(negated)"))
        ).otherwise(F.lit(""))
        if not lexicon.ambiguous:
            return negated
        wanted, unwanted = F.try_element_at(_lookup(support), p["t"]), F.try_element_at(
            _lookup(exclude), p["t"]
        )
        bad = F.array_sort(F.array_distinct(F.array_intersect(window, unwanted)))
        return (
            F.when(wanted.isNull(), negated)
            .when(
                F.size(bad) > 0,
                F.concat(quoted, F.lit("(tech context: "), F.array_join(bad, ", "), F.lit(")")),
            )
            .when(
                (F.size(wanted) > 0) & ~F.arrays_overlap(wanted, window),
                F.concat(quoted, F.lit("(no physical/vehicle context nearby)")),
            )
            .otherwise(negated)
        )

    return F.transform(placed, lambda p: F.struct(p["t"].alias("term"), note(p).alias("note")))


def _lookup(table: Mapping[str, Sequence[str]]) -> Column:
    entries = [c for t, v in table.items() for c in (F.lit(t), _strings(v))]
    return F.create_map(*entries)


def detect_context(
    df: DataFrame,
    lexicon: Lexicon,
    text: str = "text",
    out: str = "safety",
    settings: Settings = Settings(),
) -> DataFrame:
    """Add struct(is_safety, triggers, reason, method, ignored)."""
    # Most messages hold no listed term at all; those are not cut into words.
    terms = [*lexicon.strong, *lexicon.ambiguous]
    df = df.withColumn("_plain", F.lower(X.text_or_empty(F.col(text))))
    some = X.any_contained(F.col("_plain"), terms)
    df = df.withColumn(
        "_words", F.when(some, X.words(F.col("_plain"))).otherwise(F.array().cast("array<string>"))
    ).drop("_plain")
    df = df.withColumn("_hits", context_hits(F.col("_words"), lexicon, settings))
    fired = F.filter("_hits", lambda h: h["note"] == "")
    df = df.withColumn(
        "_triggers", F.array_sort(F.array_distinct(F.transform(fired, lambda h: h["term"])))
    )
    df = df.withColumn(
        "_notes",
        F.transform(F.filter("_hits", lambda h: h["note"] != ""), lambda h: h["note"]),
    )
    found = F.size("_triggers") > 0
    quiet = F.concat(
        F.lit("no physical-safety signal"),
        F.when(
            F.size("_notes") > 0, F.concat(F.lit(" ("), F.array_join("_notes", "; "), F.lit(")"))
        ).otherwise(F.lit("")),
    )
    loud = F.concat(
        F.lit("physical-safety terms in context: "), F.array_join("_triggers", ", ")
    )
    verdict = F.struct(
        found.alias("is_safety"),
        F.col("_triggers").alias("triggers"),
        F.when(found, loud).otherwise(quiet).alias("reason"),
        F.lit(METHOD_RULES).alias("method"),
        F.when(found, F.array().cast("array<string>")).otherwise(F.col("_notes")).alias("ignored"),
    )
    return df.withColumn(out, verdict).drop("_words", "_hits", "_triggers", "_notes")


def compare_detectors(
    df: DataFrame, lexicon: Lexicon, text: str = "text", safety: str = "safety"
) -> DataFrame:
    """Plain substring hits beside the context detector, and which of the two was right."""
    df = df.withColumn("_low", F.lower(X.text_or_empty(F.col(text))))
    df = df.withColumn("naive_hits", X.contained(F.col("_low"), lexicon.naive))
    naive, context = F.size("naive_hits") > 0, F.col(f"{safety}.is_safety")
    verdict = F.when(naive & ~context, "fixed").when(naive == context, "correct").otherwise("gain")
    return df.withColumn("verdict", verdict).drop("_low")


# ---------------------------------------------------------------- rule classifier


def lexicon_scores(df: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "scores") -> DataFrame:
    """Add an array, in taxonomy order, of how many of a label's keywords occur in the text."""
    low = F.lower(X.text_or_empty(F.col(text)))
    counts = [X.count_contained(F.col("_low"), lexicon.keywords.get(t, ())) for t in lexicon.taxonomy]
    return df.withColumn("_low", low).withColumn(out, F.array(*counts)).drop("_low")


def context_override(scores: str, flag: Column, lexicon: Lexicon, bonus: int) -> Column:
    """Scores where the override label counts only when the context detector fired."""
    at = lexicon.taxonomy.index(lexicon.override_label)
    return F.transform(
        F.col(scores),
        lambda s, i: F.when(i != at, s).when(flag, s + bonus).otherwise(F.lit(0)),
    )


def classify_rules(
    df: DataFrame,
    lexicon: Lexicon,
    text: str = "text",
    out: str = "classification",
    settings: Settings = Settings(),
    keep_safety: str | None = None,
) -> DataFrame:
    """Add struct(intent, confidence, runner_up, method, needs_context, reason).

    The highest score wins and ties go to the label that stands first in the taxonomy.
    ``keep_safety`` names a column that keeps the context verdict, so it is computed once.
    """
    safety = keep_safety or "_safety"
    df = detect_context(df, lexicon, text, safety, settings)
    df = lexicon_scores(df, lexicon, text, "_scores")
    fired = F.col(f"{safety}.is_safety")
    df = df.withColumn(
        "_scores", context_override("_scores", fired, lexicon, settings.override_bonus)
    )
    ranked = F.array_sort(
        F.transform("_scores", lambda s, i: F.struct((-s).alias("neg"), i.alias("at")))
    )
    df = df.withColumn("_ranked", ranked).withColumn(
        "_total", F.aggregate("_scores", F.lit(0), lambda a, s: a + s)
    )
    df = df.withColumns(
        {
            "_top": -F.get("_ranked", 0)["neg"],
            "_first": F.get("_ranked", 0)["at"],
            "_second": F.get("_ranked", 1)["at"],
        }
    )
    names = _strings(lexicon.taxonomy)
    low = F.col("_low")
    at_override = lexicon.taxonomy.index(lexicon.override_label)
    # The winning label decides which keyword list is searched, so one list is tried per row.
    hits = F.array().cast("array<string>")
    for i, label in enumerate(lexicon.taxonomy):
        hits = F.when(
            F.col("_first") == i, X.contained(low, lexicon.keywords.get(label, ()))
        ).otherwise(hits)
    quoted = F.array_join(
        F.transform(
            F.slice("_found", 1, 4),
            lambda k: F.when(F.contains(k, F.lit("'")), F.concat(F.lit('"'), k, F.lit('"'))).otherwise(
                F.concat(F.lit("'"), k, F.lit("'"))
            ),
        ),
        ", ",
    )
    nothing = F.col("_top") == 0
    df = df.withColumn("_low", F.lower(X.text_or_empty(F.col(text))))
    df = df.withColumn("_found", F.when(~nothing, hits))
    df = df.withColumn(
        "_intent", F.when(nothing, lexicon.default_label).otherwise(F.get(names, F.col("_first")))
    )
    reason = (
        F.when(
            nothing,
            f"no strong intent keywords matched — defaulted to {lexicon.default_label}",
        )
        .when(
            (F.col("_first") == at_override) & fired,
            "context-aware safety detector flagged a physical-safety signal",
        )
        .when(
            F.size("_found") > 0,
            F.concat(F.lit("matched "), F.col("_intent"), F.lit(" keyword(s): "), quoted),
        )
        .otherwise(F.concat(F.lit("highest keyword score for "), F.col("_intent")))
    )
    sure = F.least(F.lit(0.95), F.lit(0.45) + F.lit(0.5) * (F.col("_top") / F.col("_total")))
    df = df.withColumn("_conf", F.when(nothing, 0.3).otherwise(F.round(sure, 3)))
    return df.withColumn(
        out,
        F.struct(
            F.col("_intent").alias("intent"),
            F.col("_conf").alias("confidence"),
            F.get(names, F.col("_second")).alias("runner_up"),
            F.lit(METHOD_RULES).alias("method"),
            (F.col("_conf") < settings.low_confidence).alias("needs_context"),
            reason.alias("reason"),
        ),
    ).drop(
        "_safety", "_scores", "_ranked", "_total", "_top", "_first", "_second", "_found",
        "_intent", "_conf", "_low",
    )


def needs_context(confidence: Column, settings: Settings = Settings()) -> Column:
    return F.coalesce(confidence, F.lit(0.0)) < settings.low_confidence


# ---------------------------------------------------------------- simple detectors


def frustration(df: DataFrame, lexicon: Lexicon, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Add the frustration markers found and whether there are enough to matter."""
    df = df.withColumn("_low", F.lower(X.text_or_empty(F.col(text))))
    df = df.withColumn("frustration_hits", X.contained(F.col("_low"), lexicon.frustration))
    enough = F.size("frustration_hits") >= settings.frustration_markers
    return df.withColumn("frustrated", enough).drop("_low")


def deflection(c: Column, lexicon: Lexicon) -> Column:
    return X.is_deflection(c, lexicon.deflection, lexicon.deflection_words)


def deflection_rate(
    df: DataFrame, lexicon: Lexicon, text: str = "text", by: Sequence[str] = ()
) -> DataFrame:
    flag = deflection(F.col(text), lexicon).cast("int")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(flag).alias("n_deflection"),
        F.avg(flag.cast("double")).alias("deflection_rate"),
    )


def majority_baseline(train: DataFrame, df: DataFrame, label: str, out: str = "prediction") -> DataFrame:
    """Predict the most frequent training label for every row; ties by name."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(label).alias("label"))).alias("m"))
    return df.withColumn(out, best.select("m.label").scalar())


def reaction_flags(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Add whether the customer rejects the help given, and whether they ask for a person."""
    return df.withColumns(
        {
            "rejection": X.matches_any(F.col(text), lexicon.rejection),
            "human_request": X.matches_any(F.col(text), lexicon.human_request),
        }
    )


def dissatisfaction(
    df: DataFrame,
    lexicon: Lexicon,
    text: str = "text",
    explicit: str = "explicit",
    repeat: str = "is_repeat",
    out: str = "dissatisfaction",
    settings: Settings = Settings(),
) -> DataFrame:
    """Add struct(dissatisfied, score, signals, method) from feedback, wording and repetition."""
    said = F.coalesce(F.col(explicit), F.lit(""))
    helpful = said == "helpful"
    asks = (said == "human_request") | X.matches_any(F.col(text), lexicon.human_request)
    rejects = X.matches_any(F.col(text), lexicon.rejection)
    again = F.coalesce(F.col(repeat), F.lit(False))
    df = df.withColumns({"_asks": asks, "_rejects": rejects, "_again": again})
    zero = F.lit(0.0)
    score = F.greatest(
        F.when(F.col("_asks"), 1.0).otherwise(zero),
        F.when(said == "not_helpful", 0.6).otherwise(zero),
        F.when(F.col("_rejects"), 0.7).otherwise(zero),
        F.when(F.col("_again"), 0.65).otherwise(zero),
    )
    # The wording signal follows the thumbs-down signal but merges into an explicit request.
    signals = F.array_distinct(
        F.array_compact(
            F.array(
                F.when(said == "human_request", "explicit_human_request"),
                F.when(said == "not_helpful", "explicit_thumbs_down"),
                F.when(F.col("_asks"), "explicit_human_request"),
                F.when(F.col("_rejects"), "rejection_language"),
                F.when(F.col("_again"), "repeated_unresolved_question"),
            )
        )
    )
    df = df.withColumn("_score", F.when(helpful, zero).otherwise(F.round(score, 3)))
    return df.withColumn(
        out,
        F.struct(
            (F.col("_score") >= settings.dissatisfaction).alias("dissatisfied"),
            F.col("_score").alias("score"),
            F.when(helpful, F.array(F.lit("explicit_helpful"))).otherwise(signals).alias("signals"),
            F.lit(METHOD_RULES).alias("method"),
        ),
    ).drop("_asks", "_rejects", "_again", "_score")
