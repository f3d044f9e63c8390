"""Declared schemas of every source; nothing is inferred."""

from __future__ import annotations

MESSAGES = (
    "tweet_id BIGINT, author_id STRING, inbound BOOLEAN, created_at TIMESTAMP, text STRING, "
    "in_response_to_tweet_id BIGINT"
)

RESOLUTIONS = (
    "resolution_id STRING, original_query STRING, ai_response STRING, human_resolution STRING, "
    "intent STRING, escalation_reason STRING, category STRING, internal_note STRING, "
    "human_verified BOOLEAN, created_at STRING, source STRING, conflict_flag BOOLEAN"
)

FEEDBACK = (
    "conversation_id STRING, message_id STRING, feedback STRING, customer_query STRING, "
    "ai_response STRING, intent STRING, validated BOOLEAN, trusted BOOLEAN, ts STRING"
)

CONVERSATION = (
    "conversation_id STRING, customer_id STRING, status STRING, intent STRING, "
    "safety_status STRING, escalation_reason STRING, created_at STRING, updated_at STRING, "
    "messages ARRAY<STRUCT<message_id: STRING, role: STRING, text: STRING, ts: STRING, "
    "meta: MAP<STRING, STRING>>>, "
    "feedback MAP<STRING, STRUCT<feedback: STRING, ts: STRING>>, "
    "resolution STRUCT<text: STRING, category: STRING, note: STRING, human_agent: STRING, "
    "resolved_at: STRING, resolution_id: STRING>, "
    "retrieved_evidence ARRAY<STRUCT<pair_id: STRING, score: DOUBLE>>"
)

LIFECYCLE_EVENTS = (
    "conv_id BIGINT, seq BIGINT, ts TIMESTAMP, kind STRING, role STRING, text STRING, "
    "status STRING, reason STRING"
)
