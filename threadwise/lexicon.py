"""Word lists as one parameter object. Operators read a ``Lexicon``; none of them holds words."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from threadwise import fixed_values as fixed


@dataclass(frozen=True)
class Lexicon:
    taxonomy: tuple[str, ...]
    keywords: Mapping[str, tuple[str, ...]]
    default_label: str
    override_label: str
    strong: tuple[str, ...] = ()
    ambiguous: Mapping[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)
    negations: tuple[str, ...] = ()
    naive: tuple[str, ...] = ()
    frustration: tuple[str, ...] = ()
    deflection: tuple[str, ...] = ()
    deflection_words: int = 30
    rejection: tuple[str, ...] = ()
    human_request: tuple[str, ...] = ()
    content_stop: tuple[str, ...] = ()
    promises: tuple[str, ...] = ()
    calm_words: tuple[str, ...] = fixed.CALM_WORDS
    opening: Mapping[str, str] = field(default_factory=lambda: dict(fixed.OPENING))
    next_step: Mapping[str, str] = field(default_factory=lambda: dict(fixed.NEXT_STEP))
    abbreviations: Mapping[str, str] = field(default_factory=lambda: dict(fixed.ABBREVIATIONS))


def support_lexicon(brand: str = "") -> Lexicon:
    """The ride-support word lists. ``brand`` adds the two brand-named food-service keywords."""
    keywords = {label: tuple(words) for label, words in fixed.KEYWORDS.items()}
    if brand:
        name = brand.lower()
        keywords["delivery_order"] = (f"{name}eats", f"{name} eats", *keywords["delivery_order"])
    return Lexicon(
        taxonomy=fixed.TAXONOMY,
        keywords=keywords,
        default_label="general_query",
        override_label="safety_incident",
        strong=fixed.STRONG_TERMS,
        ambiguous=fixed.AMBIGUOUS_TERMS,
        negations=fixed.NEGATIONS,
        naive=fixed.NAIVE_TERMS,
        frustration=fixed.FRUSTRATION,
        deflection=fixed.DEFLECTION,
        rejection=fixed.REJECTION_PATTERNS,
        human_request=fixed.HUMAN_PATTERNS,
        content_stop=fixed.CONTENT_STOP,
        promises=fixed.PROMISES,
    )
