"""Routing, escalation and feedback policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwise.fixed_values import ESCALATION_CLAUSES
from threadwise.operators import routing as ops
from threadwise.operators.threads import with_depth
from threadwise.plans import flagship
from threadwise.plans.registry import classify as cq
from threadwise.plans.registry import common as c
from threadwise.plans.registry import search as sq
from threadwise.plans.registry.common import L, table
from threadwise.session import reliable


def routed(spark: SparkSession, sf: str) -> DataFrame:
    rows = flagship.routed_turns(table(spark, sf, "conversations"))
    return rows.withColumn("query_id", F.concat_ws("_", "conv_id", "turn"))


def routing_counts(spark: SparkSession, sf: str) -> DataFrame:
    return flagship.routing_counts(spark, sf)


def h1_route(spark: SparkSession, sf: str) -> DataFrame:
    return routed(spark, sf).select("query_id", "depth", "routing.decision", "routing.reason")


def escalated(spark: SparkSession, sf: str) -> DataFrame:
    depth = with_depth(table(spark, sf, "conversations")).select("conv_id", "turn", "depth")
    rows = c.classify(cq.with_reactions(spark, sf).join(depth, ["conv_id", "turn"]))
    n = F.length("text")
    # text sizes stand in for what drafting and retrieval report
    rows = rows.withColumns(
        {
            "thumbs_down_count": n % 4,
            "top_score": F.when(n % 7 == 0, 0.05).when(n % 7 == 1, 0.5),
            "verification_ok": F.when(n % 9 == 0, False).when(n % 9 == 1, True),
            "generation_failed": n % 11 == 0,
        }
    )
    return ops.escalate(rows, L)


def h2_escalate(spark: SparkSession, sf: str) -> DataFrame:
    return escalated(spark, sf).select(
        "query_id", "escalation.route", F.array_join("escalation.signals", ",").alias("signals"),
        "escalation.confidence", "escalation.reason",
    )


def h3_apply_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return ops.apply_feedback(c.feedback(spark, sf)).select(
        "event_id", "thumbs_down_count", "escalated"
    )


def h4_feedback_policy(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.feedback_policy(c.feedback(spark, sf))
    return rows.select("event_id", "escalate_now", F.coalesce("escalation_reason", F.lit("")).alias("why"))


def handed_over(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that go to a human. Decisions are written before they are filtered: a filter on a computed
    decision would be pushed below it and compute everything it depends on again."""
    needed = ["conv_id", "turn", "query_id", "text", "classification", "safety", "escalation"]
    return reliable(escalated(spark, sf).select(*needed)).where("escalation.route = 'HUMAN'")


def h5_escalation_records(spark: SparkSession, sf: str) -> DataFrame:
    replies = c.pairs(spark, sf).select("conv_id", "turn", F.col("brand_reply").alias("ai_response"))
    heads = handed_over(spark, sf).join(replies, ["conv_id", "turn"], "left").select(
        "query_id",
        F.col("conv_id").alias("conversation_id"),
        F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn")).alias("timestamp"),
        F.col("text").alias("original_message"),
        F.coalesce("ai_response", F.lit("")).alias("ai_response"),
        F.col("classification.intent").alias("intent"),
        F.col("escalation.reason").alias("reason"),
        F.when(F.col("safety.is_safety"), "YES").otherwise("no").alias("safety_status"),
    )
    records = ops.escalation_records(heads, sq.lexical(spark, sf, pad=True)[1])
    evidence = F.transform(
        "retrieved_evidence", lambda e: F.concat(e["pair_id"], F.lit("="), e["score"].cast("decimal(6,4)").cast("string"))
    )
    return records.select(
        "query_id", "conversation_id", F.unix_timestamp("timestamp").alias("at"), "original_message", "ai_response",
        "intent", "reason", "safety_status", "status", F.array_join(evidence, ";").alias("evidence"),
    )


def h5_escalation_history(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations")
    rows = ops.earlier_rows(handed_over(spark, sf).select("query_id", "conv_id", "turn"), conv)
    return rows.select("query_id", F.col("turn").alias("earlier_turn"), "role", "text")


def h6_routing_audit(spark: SparkSession, sf: str) -> DataFrame:
    return ops.routing_audit(routed(spark, sf), "query_id", 8)


def h6_escalation_rate(spark: SparkSession, sf: str) -> DataFrame:
    rows = routed(spark, sf).select(
        F.col("classification.intent").alias("intent"), F.col("routing.decision").alias("decision")
    )
    return ops.escalation_rate(rows).withColumn("human_rate", F.round("human_rate", 6))


QUERIES = {
    f.__name__: f
    for f in (
        routing_counts, h1_route, h2_escalate, h3_apply_feedback, h4_feedback_policy,
        h5_escalation_records, h5_escalation_history, h6_routing_audit, h6_escalation_rate,
    )
}

DEPTH = """
dep AS (SELECT concat(conv_id, '_', turn) AS query_id, role, coalesce(sum((role = 'user')::INT) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS depth
  FROM conversations)"""

MARKS = f"list_filter({c.lst(L.frustration)}, lambda k: contains(low, k))"

SQUISHED = (
    f"turns AS (SELECT concat(conv_id, '_', turn) AS query_id, conv_id, turn, {c.squish('text')} AS text "
    "FROM conversations WHERE role = 'user')"
)

# The context notes of a quiet verdict are part of the reason only when the intent disagrees, which
# cannot happen here: the override label scores only when the detector fires.
ROUTED = f"""
{SQUISHED}, {c.classified('turns', 'query_id, text')}, {DEPTH},
sig AS (SELECT c_out.*, depth, {MARKS} AS marks FROM c_out JOIN dep USING (query_id)),
rs AS (SELECT *, list_filter([
    CASE WHEN is_safety THEN concat('safety incident — physical-safety terms in context: ', array_to_string(trig, ', '), ' [rules]') END,
    CASE WHEN len(marks) >= 2 THEN concat('high frustration (', len(marks), ' markers: ', array_to_string(marks[1:4], ', '), ')') END,
    CASE WHEN confidence < 0.55 THEN concat('low classifier confidence (', {c.two('confidence')}, ' < 0.55)') END,
    CASE WHEN depth >= 3 THEN concat('repeat contact (', depth, ' prior messages in thread)') END],
    lambda x: x IS NOT NULL) AS reasons FROM sig),
rt AS (SELECT query_id, text, depth, intent, confidence, CASE WHEN len(reasons) > 0 THEN 'HUMAN' ELSE 'AI' END AS decision,
    concat('Routed to ', CASE WHEN len(reasons) > 0 THEN 'HUMAN' ELSE 'AI' END, ' because: ',
      CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, '; ')
      ELSE concat('confident (', {c.two('confidence')}, ') non-safety intent ''', intent, ''', no frustration/repeat signals') END, '.') AS reason
  FROM rs)"""

ESCALATED = f"""
{c.turns_sql()}, {cq.REPEATS}, {cq.REACTIONS}, {c.classified('turns', 'query_id, text')}, {DEPTH},
es AS (SELECT d.query_id, d.conv_id, d.turn, d.text, o.intent, o.confidence, o.is_safety, list_distinct(list_filter([
    CASE WHEN o.is_safety OR o.intent = 'delta' THEN '1' END,
    CASE WHEN explicit = 'human_request' OR asks_text THEN CASE WHEN explicit = 'human_request' THEN '2' ELSE '4' END END,
    CASE WHEN len(d.text) % 4 >= 2 THEN '3' END,
    CASE WHEN (depth > 0 OR explicit IS NOT NULL) AND coalesce(explicit, '') <> 'helpful' AND is_repeat THEN '5' END,
    CASE WHEN (depth > 0 OR explicit IS NOT NULL) AND score >= 0.7 AND coalesce(explicit, '') <> 'not_helpful' THEN '6' END,
    CASE WHEN o.confidence < 0.55 THEN '7' END,
    CASE WHEN len(d.text) % 7 = 0 THEN '8' END,
    CASE WHEN len(d.text) % 9 = 0 THEN '9' END,
    CASE WHEN len(d.text) % 11 = 0 THEN 'x' END], lambda x: x IS NOT NULL)) AS codes
  FROM dis d JOIN c_out o USING (query_id) JOIN dep USING (query_id)),
esn AS (SELECT *, list_transform(list_sort(codes), lambda k: CASE k WHEN '1' THEN 'safety_incident' WHEN '2' THEN 'explicit_human_request'
    WHEN '3' THEN 'second_thumbs_down' WHEN '4' THEN 'explicit_human_request' WHEN '5' THEN 'repeated_unresolved_question'
    WHEN '6' THEN 'high_dissatisfaction' WHEN '7' THEN 'low_classifier_confidence' WHEN '8' THEN 'low_retrieval_confidence'
    WHEN '9' THEN 'groundedness_failure' ELSE 'llm_failure' END) AS signals FROM es)"""

_CLAUSE = "CASE s " + " ".join(
    f"WHEN {c.q(k)} THEN {c.q(v)}" for k, v in ESCALATION_CLAUSES.items()
) + " END"

_REASON = f"""CASE WHEN len(signals) > 0 THEN concat('Escalated because ',
          array_to_string(list_transform(signals, lambda s: {_CLAUSE}), '; and '), '.')
          ELSE concat('Handled by AI: confident (', {c.two('confidence')}, ') non-safety intent ''', intent, ''', no dissatisfaction or grounding issues.') END"""

THUMBS = f"""
{c.FEEDBACK},
st AS (SELECT *, (feedback = 'not_helpful')::INT - coalesce((lag(feedback) OVER (
    PARTITION BY conversation_id, message_id ORDER BY ts, event_id) = 'not_helpful')::INT, 0) AS step FROM fb),
td AS (SELECT *, sum(step) OVER (PARTITION BY conversation_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS n FROM st)"""

SQL = {
    "routing_counts": f"""WITH {ROUTED} SELECT intent, decision, count(*) AS n_messages,
      round(avg(confidence), 6) AS mean_confidence FROM rt GROUP BY 1, 2""",
    "h1_route": f"WITH {ROUTED} SELECT query_id, depth, decision, reason FROM rt",
    "h2_escalate": f"""WITH {ESCALATED}
      SELECT query_id, CASE WHEN len(signals) > 0 THEN 'HUMAN' ELSE 'AI' END AS route, array_to_string(signals, ',') AS signals,
        CASE WHEN len(signals) > 0 THEN round(least(1.0::DOUBLE, 0.5::DOUBLE + 0.15::DOUBLE * len(signals)), 3) ELSE confidence END AS confidence,
        {_REASON} AS reason
      FROM esn""",
    "h3_apply_feedback": f"""WITH {THUMBS} SELECT event_id, n AS thumbs_down_count,
      feedback = 'human_request' OR n >= 2 AS escalated FROM td""",
    "h4_feedback_policy": f"""WITH {c.FEEDBACK} SELECT event_id, feedback <> 'helpful' AS escalate_now,
      CASE feedback WHEN 'human_request' THEN 'the customer explicitly requested a human agent'
        WHEN 'not_helpful' THEN 'the customer marked the AI response Not Helpful' ELSE '' END AS why FROM fb""",
    "h5_escalation_records": f"""WITH {sq.SPACE_SQL}, {sq.TOP3}, {sq.PADDED}, {ESCALATED.replace(c.turns_sql() + ',', '', 1)},
      evd AS (SELECT query_id, string_agg(concat(pair_id, '=', printf('%.4f', score)), ';' ORDER BY rank) AS evidence FROM hits GROUP BY 1)
      SELECT query_id, esn.conv_id AS conversation_id, (esn.conv_id * 100 + esn.turn)::BIGINT AS at, text AS original_message,
        coalesce(brand_reply, '') AS ai_response, intent, {_REASON} AS reason,
        CASE WHEN is_safety THEN 'YES' ELSE 'no' END AS safety_status, 'ESCALATED' AS status, evidence
      FROM esn JOIN evd USING (query_id) LEFT JOIN pairs ON pairs.conv_id = esn.conv_id AND pairs.turn = esn.turn
      WHERE len(signals) > 0""",
    "h5_escalation_history": f"""WITH {ESCALATED}
      SELECT query_id, b.turn AS earlier_turn, b.role, b.text FROM esn JOIN conversations b
      ON b.conv_id = esn.conv_id AND b.turn < esn.turn WHERE len(signals) > 0""",
    "h6_routing_audit": f"""WITH {ROUTED} SELECT query_id, substr(replace(text, '|', '/'), 1, 60) AS message, intent, decision,
      substr(reason, 1, 90) AS reason FROM rt ORDER BY md5(concat('5:', query_id)), query_id LIMIT 8""",
    "h6_escalation_rate": f"""WITH {ROUTED} SELECT intent, count(*) AS n, sum((decision = 'HUMAN')::INT)::BIGINT AS n_human,
      round(avg((decision = 'HUMAN')::INT), 6) AS human_rate FROM rt GROUP BY 1""",
}
