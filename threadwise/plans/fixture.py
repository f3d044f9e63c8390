"""The word lists used on the sample tables, whose prose is invented."""

from __future__ import annotations

from threadwise.lexicon import Lexicon

STOP_WORDS = ("the", "of", "and", "in", "to", "a", "is")

FIXTURE = Lexicon(
    taxonomy=("alpha", "beta", "gamma", "delta", "other"),
    keywords={
        "alpha": ("tion", "was", "from"),
        "beta": ("ing", "with"),
        "gamma": ("this", "are "),
        "delta": ("that",),
    },
    default_label="other",
    override_label="delta",
    strong=("that",),
    ambiguous={
        "was": (("the", "of"), ("by",)),
        "for": ((), ("in",)),
        "it": (("and",), ()),
    },
    negations=("is", "be"),
    naive=("that", "was"),
    frustration=("from", "this", "with", "!!!"),
    deflection=("to ", "on "),
    deflection_words=60,
    rejection=(r"\bthat is\b", r"\bthat was\b", "with the"),
    human_request=(r"\bfrom the\b",),
    content_stop=STOP_WORDS,
    promises=("and the", "it was"),
    calm_words=("safe", "sorry", "the "),
)
