"""Text functions, ``Column -> Column``, all built from JVM expressions.

Regular expressions spell out ``[\\p{L}\\p{N}_]`` for a word character, so that results do not
depend on the JDK's reading of ``\\w`` and ``\\b``, and agree with Unicode-aware engines.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadwise import fixed_values as fixed

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squish(c: Column) -> Column:
    """Trim, and make every run of white space one blank. Null gives ''."""
    return F.trim(F.regexp_replace(text_or_empty(c), rf"(?U)[{SPACE}]+", " "))


def norm_key(c: Column) -> Column:
    """Identity form of a text: lower case, white space squished."""
    return squish(F.lower(c))


def collapse_repeats(c: Column, letters_only: bool = False) -> Column:
    """Three or more of one character in a row become one."""
    unit = r"(\p{L})" if letters_only else r"([^\n])"
    return F.regexp_replace(c, unit + r"\1\1+", "$1")


def expand(c: Column, abbreviations: Mapping[str, str]) -> Column:
    """Replace whole-word abbreviations, in the order of the mapping.

    One search decides whether a text holds any of them, so most texts skip the replacements.
    """
    changing = {short: full for short, full in abbreviations.items() if short != full}
    if not changing:
        return c
    any_short = rf"(?<![{WORD}])(?:{'|'.join(changing)})(?![{WORD}])"

    def replaced(t: Column) -> Column:
        done = t
        for short, full in changing.items():
            done = F.regexp_replace(done, rf"{short}(?<![{WORD}]{short})(?![{WORD}])", full)
        return F.when(t.rlike(any_short), done).otherwise(t)

    # the lambda names the text, which would otherwise be computed for the search and again after it
    return F.get(F.transform(F.array(c), replaced), 0)


def clean_text(
    c: Column,
    drop_handles: bool = True,
    abbreviations: Mapping[str, str] = fixed.ABBREVIATIONS,
    letters_only: bool = False,
) -> Column:
    """Light normal form used for matching: links masked, handles dropped, elongations collapsed,
    lower case, abbreviations expanded, stray symbols blanked, white space squished."""
    t = F.regexp_replace(text_or_empty(c), f"(?U){fixed.URL_TO_MASK}", " URL ")
    if drop_handles:
        t = F.regexp_replace(t, f"@[{WORD}]+", " ")
    t = expand(F.lower(collapse_repeats(t, letters_only)), abbreviations)
    # a run of stray symbols and white space becomes one blank
    return F.trim(F.regexp_replace(t, rf"[^{WORD}'#$/.,!?%-]+", " "))


def words(c: Column) -> Column:
    """Runs of a-z and apostrophe in the lowered text."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("([a-z']+)"), F.lit(1))


def word_count(c: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.filter(F.split(squish(c), " "), lambda t: t != ""))


def token_set(cleaned: Column) -> Column:
    """Distinct blank-separated tokens of a cleaned text."""
    return F.array_distinct(F.filter(F.split(cleaned, " "), lambda t: t != ""))


def content_words(cleaned: Column, stop: Sequence[str], min_len: int = 3) -> Column:
    """Distinct tokens long enough to carry meaning and not in the stop list."""
    keep = lambda t: (F.length(t) >= min_len) & ~t.isin(list(stop))
    return F.filter(token_set(cleaned), keep)


def set_jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two arrays of distinct tokens, 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Token Jaccard of two texts after cleaning."""
    return set_jaccard(token_set(clean_text(a)), token_set(clean_text(b)))


def shared_content(a: Column, b: Column, stop: Sequence[str], min_len: int = 3) -> Column:
    """Content words two texts have in common."""
    return F.array_intersect(
        content_words(clean_text(a), stop, min_len), content_words(clean_text(b), stop, min_len)
    )


def content_id(a: Column, b: Column) -> Column:
    """16 hex digits that identify a (query, resolution) content."""
    joined = F.concat(norm_key(a), F.lit(fixed.ID_SEPARATOR), norm_key(b))
    return F.substring(F.sha1(joined.cast("binary")), 1, 16)


def urls(c: Column) -> Column:
    return F.regexp_extract_all(
        text_or_empty(c), F.lit(f"(?U)({fixed.URL_TO_CHECK})"), F.lit(1)
    )


def contained(c: Column, needles: Sequence[str]) -> Column:
    """The needles that occur in the text as substrings, in list order."""
    if not needles:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(c, n))


def count_contained(c: Column, needles: Sequence[str]) -> Column:
    """How many needles occur. A sum of cases, which stays inside generated code."""
    total = F.lit(0)
    for needle in needles:
        total = total + F.when(F.contains(c, F.lit(needle)), 1).otherwise(0)
    return total


def any_contained(c: Column, needles: Sequence[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(c, F.lit(needle))
    return hit


def matches_any(c: Column, patterns: Sequence[str]) -> Column:
    """True when any pattern is found, ignoring case. Null is no match."""
    if not patterns:
        return F.lit(False)
    alternatives = "|".join(f"(?:{p})" for p in patterns)
    return text_or_empty(c).rlike(f"(?iu)(?:{alternatives})")


def is_deflection(c: Column, markers: Sequence[str], max_words: int) -> Column:
    """A short reply that only moves the customer to a private channel."""
    return any_contained(F.lower(text_or_empty(c)), markers) & (word_count(c) <= max_words)


def preview(c: Column, n: int) -> Column:
    """First n characters of a table cell, with the column separator replaced."""
    return F.substring(F.replace(text_or_empty(c), F.lit("|"), F.lit("/")), 1, n)

