"""Operator 1: quality rules by distribution divergence. DataFrame functions only, and no shuffle of texts.

A document's histogram of character classes and its histogram of common words are compared with references
of several languages by the Jensen-Shannon distance (base 2, 0 to 1); the nearest language counts. A
distance is judged only from a least number of characters or common words on; shorter texts pass it. The
references are the summed histograms of all documents of each language, so they cover the whole
corpus; they can be given instead. Base rules on length and repetition come first.

Defined cases: a null or empty text has no words and fails the base rules; a null or unknown language takes no part
in the references and is judged like any other; equal rows are judged alike; an empty table gives no
row; other columns are kept, and columns named like the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwise.llm.common import WORD
from threadwise.session import reliable

# Frequent function words by language.
COMMON_WORDS = {
    "en": "the of and to a in is that for it was on with be as by this are at from",
    "de": "der die und in den von zu das sich mit auf des für ist nicht im dem ein eine als",
    "fr": "de la le et les des en un du une que pour est qui dans par pas au sur avec",
    "es": "de la que el en y los se del las por un no con su una es para al lo",
}
CLASSES = ("lower", "upper", "digit", "white", "symbol", "foreign", "other")
SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    window: int = 8  # a power of two
    max_repeat_percent: int = 30
    min_chars: int = 500
    max_char_distance: float = 0.3
    min_common: int = 30
    max_word_distance: float = 0.7


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept")


def vocabulary() -> list[str]:
    return list(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words.split()))


def repeat_words(words: str, window: int) -> Column:
    """Words inside windows that occur twice or more in the array column ``words``; ``_h`` must hold
    the windows' hashes. Equal hashes are neighbours once sorted, so no window meets all others."""
    marked = "array_sort(transform(_h, (x, i) -> struct(x, i)))"
    again = f"transform(array({marked}), s -> sort_array(transform(filter(s, (y, j) -> coalesce(get(s, j - 1).x = y.x, false) OR coalesce(get(s, j + 1).x = y.x, false)), y -> y.i)))[0]"
    covered = f"transform(array({again}), p -> aggregate(transform(p, (v, j) -> CASE WHEN j = 0 THEN {window} ELSE least({window}, v - get(p, j - 1)) END), 0, (a, v) -> a + v))[0]"
    return F.expr(f"CASE WHEN size(array_distinct(_h)) < size(_h) THEN {covered} ELSE 0 END").cast("long")


def measured(docs: DataFrame, text_col: str, limits: Limits, with_text: bool = False) -> DataFrame:
    """The input, without its text if not wanted, and with counts, ``_classes`` and ``_common`` (arrays of counts)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keep = [c for c in docs.columns if c not in ADDED and (with_text or c != text_col)]
    rows = docs.select(*keep, text.alias("_t"))
    rows = rows.withColumn("_w", F.filter(F.split("_t", SPACE), lambda w: w != ""))
    rows = rows.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)))
    # Common words, sorted; where a run of equal ones ends; and from there the count of each.
    known = vocabulary()
    spelt = [*known, *{w.capitalize() for w in known}, *{w.upper() for w in known if len(w) > 1}]
    common = F.transform(F.filter("_w", lambda w: w.isin(spelt)), lambda w: F.lower(w))
    rows = rows.withColumn("_c", F.sort_array(common))
    rows = rows.withColumn("_ends", F.expr("filter(transform(_c, (w, i) -> struct(w, i + 1 AS e)), x -> x.e = size(_c) OR get(_c, x.e) <> x.w)"))
    # Windows by doubling: hashes of one word, then of 2, 4, ... neighbours.
    rows = rows.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    width = 1
    while width < limits.window:
        rows = rows.withColumn("_h", F.expr(f"CASE WHEN size(_h) > {width} THEN transform(slice(_h, 1, size(_h) - {width}), (x, i) -> xxhash64(x, get(_h, i + {width}))) ELSE array() END"))
        width *= 2
    without = lambda pattern: F.length(F.regexp_replace("_t", pattern, ""))
    rows = rows.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "n_chars_": F.length("_t"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeat_words("_w", limits.window),
            "_upper": without("[^A-Z]+"),
            "_digit": without("[^0-9]+"),
            "_foreign": without(r"[\x00-\x7F]+"),
            "_other": without(r"[a-zA-Z0-9\x20\x09-\x0D#*$%&|<>\x{80}-\x{10FFFF}]+"),
            "_common": F.expr("transform(_ends, (x, j) -> struct(x.w AS w, x.e - coalesce(get(_ends, j - 1).e, 0) AS n))"),
        }
    ).drop("_t", "_w", "_lines", "_c", "_ends", "_h")
    white = F.col("n_chars_") - F.col("word_chars")
    rest = [F.col("_upper"), F.col("_digit"), white, F.col("n_symbols"), F.col("_foreign"), F.col("_other")]
    lower = F.col("n_chars_") - sum(rest[1:], rest[0])
    rows = rows.withColumn("_classes", F.array(*[c.cast("int") for c in (lower, *rest)]))
    return rows.drop("_upper", "_digit", "_foreign", "_other", "n_chars_")


def learn_references(rows: DataFrame, lang_col: str, min_words: int) -> dict[str, tuple[list[float], dict[str, float]]]:
    """Shares of classes and of common words by language; as many as ``COMMON_WORDS`` has languages and words."""
    n = len(CLASSES)
    long = rows.where((F.col("n_words") >= min_words) & F.col(lang_col).isin(list(COMMON_WORDS)))
    classes = long.groupBy(lang_col).agg(*[F.sum(F.col("_classes")[i]).alias(f"c{i}") for i in range(n)]).collect()
    counts = long.select(lang_col, F.inline("_common")).groupBy(lang_col, "w").agg(F.sum("n").alias("n")).collect()
    words = {r[lang_col]: {} for r in classes}
    for r in counts:
        words[r[lang_col]][r.w] = r.n
    total = lambda values: max(1, sum(values))
    return {
        r[lang_col]: ([r[f"c{i}"] / total([r[f"c{k}"] for k in range(n)]) for i in range(n)], {w: c / total(words[r[lang_col]].values()) for w, c in words[r[lang_col]].items()})
        for r in classes
    }


def _half(x: Column, m: Column) -> Column:
    return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)


def _part(p: Column, r: Column) -> Column:
    return _half(p, (p + r) / 2) + _half(r, (p + r) / 2)


def class_distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of an array of counts to a list of shares; null without any count."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    terms = F.zip_with(counts, F.array(*[F.lit(float(r)) for r in reference]), lambda x, r: _part(x / total, r))
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2)))


def word_distance(common: Column, n_common: Column, reference: dict[str, float]) -> Column:
    """The same for (word, count) pairs. A word of the reference that the document lacks adds its share."""
    shares = F.create_map(*[F.lit(x) for w, r in sorted(reference.items()) for x in (w, float(r))]) if reference else F.create_map(F.lit(""), F.lit(0.0))
    share = lambda x: F.coalesce(F.try_element_at(shares, x["w"]), F.lit(0.0))
    pairs = F.transform(common, lambda x: F.struct((x["n"] / n_common).alias("p"), share(x).alias("r")))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, y: a + _part(y["p"], y["r"]) - y["r"])
    return F.when(n_common > 0, F.sqrt(F.greatest(F.lit(0.0), (total + 1) / 2)))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits(), references: dict | None = None, with_text: bool = False, judged_words: int | None = None) -> DataFrame:
    """The input, without its text if not wanted, with ``ADDED``. The measures are written once and read for both passes.

    With ``judged_words``, every text of so many words is judged by its words, however few are common; a text
    without any common word shares none with a reference, so its distance is 1."""
    rows = reliable(measured(docs, text_col, limits, with_text))
    if references is None:
        references = learn_references(rows, lang_col, limits.min_words) if lang_col in docs.columns else {}
    n_chars = F.aggregate("_classes", F.lit(0), lambda a, x: a + x)
    n_common = F.aggregate("_common", F.lit(0), lambda a, x: a + x["n"])
    nearest = lambda values: F.array_min(F.array(*values)) if values else F.lit(None).cast("double")
    rows = rows.withColumn("char_distance", nearest([class_distance(F.col("_classes"), r) for r, _ in references.values()]))
    rows = rows.withColumn("word_distance", nearest([word_distance(F.col("_common"), n_common, r) for _, r in references.values()]))
    long = n_common >= limits.min_common
    if judged_words is not None and references:
        rows = rows.withColumn("word_distance", F.coalesce("word_distance", F.lit(1.0)))
        long = long | (F.col("n_words") >= judged_words)
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    strange = (n_chars >= limits.min_chars) & (F.col("char_distance") > limits.max_char_distance)
    foreign = long & (F.col("word_distance") > limits.max_word_distance)
    rows = rows.withColumn("base_failed", failed)
    rows = rows.withColumn("kept", ~failed & ~F.coalesce(strange, F.lit(False)) & ~F.coalesce(foreign, F.lit(False)))
    return rows.drop("_classes", "_common")
