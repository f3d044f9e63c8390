"""End to end: the chain of decisions on every customer turn, the human loop, and conversation cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwise.operators import drafts, memory, retrieval, routing
from threadwise.operators.lifecycle import conversation_summary
from threadwise.operators.repeats import is_repeat
from threadwise.operators.threads import first_per, with_depth
from threadwise.plans.registry import classify as cq
from threadwise.plans.registry import common as c
from threadwise.plans.registry import routes
from threadwise.plans.registry import search as sq
from threadwise.plans.registry.common import L, table
from threadwise.session import reliable

#: A first draft times out where the message's length is divisible by this.
TIMEOUT_EVERY = 7


def chain_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Classify, retrieve from both layers, draft, verify, escalate, each on what the one before gave."""
    corpus, model = sq.space(spark, sf)
    turns = reliable(c.classify(c.turns(spark, sf)))
    asked = turns.select("query_id", "text", F.col("classification.intent").alias("intent"))
    hits = reliable(sq.both_layers(model, asked, corpus, c.resolutions(spark, sf)))
    written = drafts.verify_drafts(drafts.draft_from_templates(asked, hits, L), hits, L)
    # The service that writes the first draft times out on some messages; the template then stands in.
    late = (F.length("text") % TIMEOUT_EVERY == 0) & (F.col("attempt") == 0)
    tries = written.withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("error", F.when(late, "Timeout"))
    tries = tries.select(
        "query_id", "attempt", "draft", "cited_example_id", "error", F.col("ok").alias("verified"), (F.col("ok") & F.col("error").isNull()).alias("ok"),
        F.when(F.col("attempt") == 0, "model").otherwise("rules-synth").alias("method"),
    )
    drafted = drafts.choose_draft(tries, error="error")
    top = hits.where(F.col("rank") == 1).select("query_id", F.col("score").alias("top_score"))
    conv = table(spark, sf, "conversations")
    rows = (
        turns.join(drafted.select("query_id", "draft", "cited_example_id", F.col("verified").alias("verification_ok"), F.col("method").startswith("rules (llm_error").alias("generation_failed")), "query_id")
        .join(top, "query_id", "left")
        .join(with_depth(conv).select("conv_id", "turn", "depth"), ["conv_id", "turn"])
        .join(is_repeat(conv, L), ["conv_id", "turn"])
        .withColumns({"explicit": F.lit(None).cast("string"), "thumbs_down_count": F.lit(0)})
    )
    return routing.escalate(rows, L).select(
        "query_id", "classification.intent", "cited_example_id", "draft", "verification_ok", "top_score",
        "escalation.route", F.array_join("escalation.signals", ",").alias("signals"), "escalation.reason",
    )


def human_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Closed conversations become records; those that a human verified pass the gate and are found by
    later questions of the same intent. A conversation closed by the assistant's side counts as verified."""
    conv = table(spark, sf, "conversations")
    closed = conv.groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("human_resolution"), (F.max_by("role", "turn") == "assistant").alias("_trusted")
    ).withColumns({"escalation_reason": F.lit(""), "category": F.lit(""), "internal_note": F.lit("")})
    records = memory.build_resolutions(conv, closed).withColumn("human_verified", F.col("_trusted"))
    records = c.classify(records, "original_query").withColumns({"intent": F.col("classification.intent"), "seq": F.col("conv_id")})
    records = reliable(records.drop("classification", "safety", "_trusted"))
    # Earlier conversations are in the memory already when the rest is taken in.
    ends = records.agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).first()
    early = F.col("conv_id") <= F.lit(((ends.low or 0) + (ends.high or 0)) // 2)
    stored = reliable(memory.ingest_resolutions(records.where(early), records.limit(0)).where("status = 'added'"))
    kept = stored.unionByName(memory.ingest_resolutions(records.where(~early), stored).where("status = 'added'"))
    _, model = sq.space(spark, sf)
    hits = retrieval.retrieve_verified(model, sq.asked(spark, sf), kept, 3)
    return hits.select("query_id", "pair_id", "score", "rank", "memory_intent")


def j6_conversation_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Card with created, safety, escalation reason and evidence ids of the first customer message."""
    conv = table(spark, sf, "conversations")
    first = first_per(conv.where("role = 'user'"), ["conv_id"], ["turn"]).select(F.concat_ws("_", "conv_id", "turn").alias("query_id"))
    made = routes.h5_escalation_records(spark, sf).join(first, "query_id")
    ids = F.array_join(F.transform(F.split("evidence", ";"), lambda e: F.substring_index(e, "=", 1)), ", ")
    cards = made.select(F.col("conversation_id").alias("conv_id"), "status", "intent", "safety_status", "reason", ids.alias("evidence_ids"))
    created = conv.groupBy("conv_id").agg((F.col("conv_id") * 100 + F.min("turn")).alias("created"))
    return conversation_summary(conv, cards.join(created, "conv_id"))


QUERIES = {f.__name__: f for f in (chain_decisions, human_loop, j6_conversation_cards)}

_LINKS = f"""
replies AS (SELECT pair_id, brand_reply FROM pairs
  UNION ALL SELECT concat('res_', resolution_id), human_resolution FROM memory),
best AS (SELECT query_id, list(pair_id ORDER BY rank) AS ids, max(CASE WHEN rank = 1 THEN score END) AS top_score,
    count(*) FILTER (contains(lower(brand_reply), 'to ') OR contains(lower(brand_reply), 'on ')) AS private
  FROM mrg JOIN replies USING (pair_id) GROUP BY 1),
kind AS (SELECT query_id, ids, top_score, CASE WHEN intent = 'delta' THEN 1 WHEN private >= 2 THEN 2 ELSE 3 END AS k
  FROM c_out JOIN best USING (query_id)),
dft AS (SELECT *, concat({c.q(sq._OPEN)}, CASE k WHEN 1 THEN ' Please DM us the trip details now so we can '
    WHEN 2 THEN ' If you DM us your account email and the trip details, we''ll '
    ELSE ' Reply here with your account email and the details and we''ll ' END, {c.q(sq._NEXT)},
    CASE k WHEN 1 THEN ' straight away.' WHEN 2 THEN ' as quickly as we can.' ELSE '.' END) AS draft FROM kind),
chk AS (SELECT *, NOT ({' OR '.join(f"contains(lower(draft), {c.q(p)})" for p in L.promises)}) AS ok FROM dft)"""

_DECIDED = f"""
{cq.REPEATS}, {cq.REACTIONS.replace("CASE len(text) % 5 WHEN 0 THEN 'helpful' WHEN 1 THEN 'not_helpful' WHEN 2 THEN 'human_request' END AS explicit", "NULL::VARCHAR AS explicit")},
{routes.DEPTH},
es AS (SELECT d.query_id, o.intent, o.confidence, chk.ids[1] AS cited_example_id, draft, ok, top_score, list_filter([
    CASE WHEN o.is_safety OR o.intent = 'delta' THEN 'safety_incident' END,
    CASE WHEN asks_text THEN 'explicit_human_request' END,
    CASE WHEN depth > 0 AND is_repeat THEN 'repeated_unresolved_question' END,
    CASE WHEN depth > 0 AND d.score >= 0.7 THEN 'high_dissatisfaction' END,
    CASE WHEN o.confidence < 0.55 THEN 'low_classifier_confidence' END,
    CASE WHEN top_score < 0.10 THEN 'low_retrieval_confidence' END,
    CASE WHEN NOT ok THEN 'groundedness_failure' END,
    CASE WHEN len(d.text) % {TIMEOUT_EVERY} = 0 THEN 'llm_failure' END], lambda x: x IS NOT NULL) AS signals
  FROM dis d JOIN c_out o USING (query_id) JOIN dep USING (query_id) JOIN chk USING (query_id))"""

_CLOSED = f"""
shut AS (SELECT conv_id, coalesce(min_by(text, turn) FILTER (role = 'user'), '') AS original_query,
    trim(max_by(text, turn), E' \\t\\n\\r\\f\\x0b') AS human_resolution, max_by(role, turn) = 'assistant' AS trusted
  FROM conversations GROUP BY 1),
{c.classified('shut', 'conv_id, original_query, human_resolution, trusted', 'original_query').replace('c_', 'm_')},
named AS (SELECT *, substr(sha1(concat({c.squish('lower(original_query)')}, '␟', {c.squish('lower(human_resolution)')})), 1, 16) AS resolution_id
  FROM m_out WHERE trusted),
memory AS (SELECT resolution_id, conv_id AS seq, original_query, human_resolution, intent FROM (
  SELECT *, row_number() OVER (PARTITION BY resolution_id ORDER BY conv_id) AS rn FROM named) WHERE rn = 1)"""

SQL = {
    "chain_decisions": f"""WITH {sq.SPACE_SQL}, {sq.TOP3}, {sq.PADDED}, {sq.VERIFIED}, {sq.MERGED}, {_LINKS}, {_DECIDED}
      SELECT query_id, intent, cited_example_id, draft, ok AS verification_ok, top_score,
        CASE WHEN len(signals) > 0 THEN 'HUMAN' ELSE 'AI' END AS route, array_to_string(signals, ',') AS signals, {routes._REASON} AS reason
      FROM es""",
    "human_loop": f"""WITH {sq.SPACE_SQL}, {sq.TOP3}, {sq.VERIFIED.replace(c.RESOLUTIONS, _CLOSED)}
      SELECT query_id, concat('res_', resolution_id) AS pair_id, score, rank::INT AS rank, intent AS memory_intent FROM ver""",
    "j6_conversation_cards": f"""SELECT conversation_id AS conv_id, status, intent, safety_status, reason,
        array_to_string(list_transform(string_split(evidence, ';'), lambda e: split_part(e, '=', 1)), ', ') AS evidence_ids,
        created, substr(first.text, 1, 60) AS first_text
      FROM ({routes.SQL["h5_escalation_records"]}) h
      JOIN (SELECT conv_id, min(turn) AS turn, min_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1) first
        ON h.query_id = concat(first.conv_id, '_', first.turn)
      JOIN (SELECT conv_id, conv_id * 100 + min(turn) AS created FROM conversations GROUP BY 1) born ON born.conv_id = first.conv_id""",
}
