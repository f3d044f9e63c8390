"""Routing and escalation: who answers, and the reason in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwise import fixed_values as fixed
from threadwise.config import Settings
from threadwise.functions import text as X
from threadwise.lexicon import Lexicon
from threadwise.operators.classify import dissatisfaction
from threadwise.operators.ordered import hot_time_chunk, with_neighbour, with_running
from threadwise.operators.sampling import sample_n


def _two(c: Column) -> Column:
    return F.format_string("%.2f", c)


def route(
    df: DataFrame,
    lexicon: Lexicon,
    text: str = "text",
    classification: str = "classification",
    safety: str = "safety",
    depth: str = "depth",
    out: str = "routing",
    settings: Settings = Settings(),
) -> DataFrame:
    """Add struct(decision, reason) from safety, frustration, confidence and repeat contact."""
    df = df.withColumn("_low", F.lower(X.text_or_empty(F.col(text))))
    df = df.withColumn("_marks", X.contained(F.col("_low"), lexicon.frustration))
    conf, intent = F.col(f"{classification}.confidence"), F.col(f"{classification}.intent")
    unsafe, why = F.col(f"{safety}.is_safety"), F.col(f"{safety}.reason")
    marks, contacts = F.size("_marks"), F.coalesce(F.col(depth), F.lit(0))
    reasons = F.array_compact(
        F.array(
            F.when(
                unsafe,
                F.concat(F.lit("safety incident — "), why, F.lit(" ["), F.col(f"{safety}.method"), F.lit("]")),
            ).when(
                intent == lexicon.override_label,
                F.concat(
                    F.lit(f"classifier intent={lexicon.override_label} (context check: "), why, F.lit(")")
                ),
            ),
            F.when(
                marks >= settings.frustration_markers,
                F.concat(
                    F.lit("high frustration ("),
                    marks.cast("string"),
                    F.lit(" markers: "),
                    F.array_join(F.slice("_marks", 1, 4), ", "),
                    F.lit(")"),
                ),
            ),
            F.when(
                conf < settings.low_confidence,
                F.concat(
                    F.lit("low classifier confidence ("),
                    _two(conf),
                    F.lit(f" < {settings.low_confidence:.2f})"),
                ),
            ),
            F.when(
                contacts >= settings.repeat_contact,
                F.concat(
                    F.lit("repeat contact ("), contacts.cast("string"), F.lit(" prior messages in thread)")
                ),
            ),
        )
    )
    df = df.withColumn("_reasons", reasons)
    human = F.size("_reasons") > 0
    quiet = F.concat(
        F.lit("confident ("), _two(conf), F.lit(") non-safety intent '"), intent,
        F.lit("', no frustration/repeat signals"),
    )
    decision = F.when(human, "HUMAN").otherwise("AI")
    reason = F.concat(
        F.lit("Routed to "), decision, F.lit(" because: "),
        F.when(human, F.array_join("_reasons", "; ")).otherwise(quiet), F.lit("."),
    )
    return df.withColumn(
        out, F.struct(decision.alias("decision"), reason.alias("reason"))
    ).drop("_low", "_marks", "_reasons")


def escalate(
    df: DataFrame,
    lexicon: Lexicon,
    text: str = "text",
    classification: str = "classification",
    safety: str = "safety",
    depth: str = "depth",
    repeat: str = "is_repeat",
    explicit: str = "explicit",
    thumbs_down: str = "thumbs_down_count",
    top_score: str = "top_score",
    verified_ok: str = "verification_ok",
    failed: str = "generation_failed",
    out: str = "escalation",
    settings: Settings = Settings(),
) -> DataFrame:
    """Add struct(route, reason, confidence, signals) from nine ordered signals.

    Dissatisfaction is a reaction, so it counts only with earlier messages or explicit feedback. A
    request for a person in the text counts always. Null inputs mean "not known".
    """
    df = dissatisfaction(df, lexicon, text, explicit, repeat, "_dis", settings)
    conf, intent = F.col(f"{classification}.confidence"), F.col(f"{classification}.intent")
    said, dis = F.col(explicit), F.col("_dis")
    context = (F.coalesce(F.col(depth), F.lit(0)) > 0) | said.isNotNull()
    downs = F.coalesce(F.col(thumbs_down), F.lit(0)) >= 2
    asks = X.matches_any(F.col(text), lexicon.human_request) | (
        context & F.array_contains(dis["signals"], "explicit_human_request")
    )
    rejected = (
        context
        & dis["dissatisfied"]
        & (dis["score"] >= settings.high_dissatisfaction)
        & ~said.eqNullSafe(F.lit("not_helpful"))
    )
    names = [
        ((F.col(f"{safety}.is_safety")) | (intent == lexicon.override_label), "safety_incident"),
        (said == "human_request", "explicit_human_request"),
        (downs & F.lit(settings.second_thumbs_down_escalates), "second_thumbs_down"),
        (asks, "explicit_human_request"),
        (
            context & F.array_contains(dis["signals"], "repeated_unresolved_question"),
            "repeated_unresolved_question",
        ),
        (rejected, "high_dissatisfaction"),
        (conf < settings.low_confidence, "low_classifier_confidence"),
        (F.col(top_score) < settings.low_retrieval, "low_retrieval_confidence"),
        (~F.col(verified_ok), "groundedness_failure"),
        (F.col(failed), "llm_failure"),
    ]
    signals = F.array_distinct(F.array_compact(F.array(*[F.when(c, s) for c, s in names])))
    df = df.withColumn("_signals", signals)
    clauses = F.create_map(*[F.lit(x) for kv in fixed.ESCALATION_CLAUSES.items() for x in kv])
    human = F.size("_signals") > 0
    loud = F.concat(
        F.lit("Escalated because "),
        F.array_join(F.transform("_signals", lambda s: F.try_element_at(clauses, s)), "; and "),
        F.lit("."),
    )
    quiet = F.concat(
        F.lit("Handled by AI: confident ("), _two(conf), F.lit(") non-safety intent '"), intent,
        F.lit("', no dissatisfaction or grounding issues."),
    )
    strength = F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.15) * F.size("_signals"))
    return df.withColumn(
        out,
        F.struct(
            F.when(human, "HUMAN").otherwise("AI").alias("route"),
            F.when(human, loud).otherwise(quiet).alias("reason"),
            F.round(F.when(human, strength).otherwise(conf), 3).alias("confidence"),
            F.col("_signals").alias("signals"),
        ),
    ).drop("_dis", "_signals")


def apply_feedback(
    feedback: DataFrame,
    conv: str = "conversation_id",
    message: str = "message_id",
    kind: str = "feedback",
    order: tuple[str, ...] = ("ts", "event_id"),
    chunk: Column | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """Feedback events with the thread's running count of thumbs down, and whether that escalates.

    A message holds one opinion at a time: new feedback replaces the old. So an event adds 1 when it
    turns a message to not helpful and takes 1 away when it turns it back, and the count is the
    running sum of those steps.
    """
    if chunk is None:
        feedback, chunk = hot_time_chunk(feedback, conv, order[0])
    seen = with_neighbour(feedback, [conv, message], order, chunk, [kind], "_prev")
    down = (F.col(kind) == "not_helpful").cast("long")
    was = F.coalesce((F.col(f"_prev.{kind}") == "not_helpful").cast("long"), F.lit(0))
    counted = with_running(seen, [conv], order, chunk, {"thumbs_down_count": down - was})
    second = F.lit(settings.second_thumbs_down_escalates) & (F.col("thumbs_down_count") >= 2)
    return counted.withColumn("escalated", (F.col(kind) == "human_request") | second).drop("_prev", "_hot")


def feedback_policy(df: DataFrame, mode: str = "immediate", kind: str = "feedback") -> DataFrame:
    """``immediate`` escalates on any bad feedback; ``second`` keeps the thread's count rule."""
    if mode == "second":
        return df.withColumn("escalate_now", F.col("escalated")).withColumn(
            "escalation_reason", F.lit(None).cast("string")
        )
    reasons = F.create_map(*[F.lit(x) for kv in fixed.IMMEDIATE_REASONS.items() for x in kv])
    reason = F.try_element_at(reasons, F.col(kind))
    return df.withColumn("escalate_now", reason.isNotNull()).withColumn("escalation_reason", reason)


def escalation_records(df: DataFrame, hits: DataFrame, key: str = "query_id", k: int | None = None) -> DataFrame:
    """The record a human agent receives. ``df`` holds one row per escalated message with
    conversation_id, original_message, ai_response, intent, safety_status, reason, timestamp. The history is
    a table of its own (``earlier_rows``), since an array per message grows with the square of the thread."""
    best = hits if k is None else hits.where(F.col("rank") <= k)
    evidence = best.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("rank", "pair_id", "score"))).alias("_e")
    )
    listed = F.transform("_e", lambda e: F.struct(e["pair_id"], e["score"]))
    empty = F.array().cast("array<struct<pair_id: string, score: double>>")
    return (
        df.join(evidence, key, "left")
        .withColumn("retrieved_evidence", F.coalesce(listed, empty))
        .withColumn("status", F.lit("ESCALATED"))
        .drop("_e")
    )


def earlier_rows(
    messages: DataFrame, conv: DataFrame, id_: str = "query_id", key: str = "conv_id", order: str = "turn"
) -> DataFrame:
    """The whole history of each given message in normal form: (id, order, role, text) of every earlier one."""
    asked = messages.select(id_, key, F.col(order).alias("_until"))
    both = conv.select(key, order, "role", "text").join(asked, key)
    return both.where(F.col(order) < F.col("_until")).drop("_until")


def history_rows(
    escalated: DataFrame, conv: DataFrame, key: str = "conv_id", order: str = "turn"
) -> DataFrame:
    """The whole history of each escalated conversation in normal form, one row per message."""
    return conv.join(escalated.select(key).distinct(), key, "left_semi").select(
        key, order, "role", "text"
    )


def routing_audit(
    df: DataFrame, key: str, n: int = 8, seed: int = 5, text: str = "text", routing: str = "routing"
) -> DataFrame:
    """A small seeded sample of decisions for reading."""
    return sample_n(df, key, n, seed).select(
        key,
        X.preview(F.col(text), 60).alias("message"),
        F.col("classification.intent").alias("intent"),
        F.col(f"{routing}.decision").alias("decision"),
        F.substring(F.col(f"{routing}.reason"), 1, 90).alias("reason"),
    )


def escalation_rate(df: DataFrame, by: str = "intent", decision: str = "decision") -> DataFrame:
    human = (F.col(decision) == "HUMAN").cast("int")
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(human).alias("n_human"),
        F.avg(human.cast("double")).alias("human_rate"),
    )
