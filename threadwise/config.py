"""Thresholds and policy switches. Operators take a ``Settings`` and hold no numbers of their own."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # The thresholds whose results must agree with published behaviour.
    resolution_similarity: float = 0.30
    verified_boost: float = 0.15
    conflict_query_similarity: float = 0.75
    conflict_resolution_similarity: float = 0.6
    dissatisfaction: float = 0.6
    high_dissatisfaction: float = 0.7
    repeat_jaccard: float = 0.5
    repeat_shared_words: int = 3
    second_thumbs_down_escalates: bool = True
    low_confidence: float = 0.55
    low_retrieval: float = 0.10
    frustration_markers: int = 2
    repeat_contact: int = 3
    override_bonus: int = 3
    context_window: int = 4
    negation_window: int = 3
    min_text: int = 5
    lsa_components: int = 200
    min_df: int = 2
    max_features: int = 20000

    # Physical sizes. They bound what one task or one broadcast holds and never change a result.
    chunk_rows: int = 4096
    broadcast_bytes: int = 64 * 1024 * 1024
    block_rows: int = 4096
    block_bytes: int = 64 * 1024 * 1024
