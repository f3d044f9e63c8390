"""Operator 5: document fingerprints by I-Match with randomised lexicons. DataFrame functions only.

The lexicon holds the terms whose document frequency, as a share of all documents, lies in a band, that is
whose inverse document frequency does. All of it is dealt by a seeded hash into ``SUBSETS`` random subsets, so that every term in the band
counts and an edit leaves some parts as they were. A
document's distinct terms in a subset are sorted and hashed to one part of its fingerprint; the likeness
of two documents is the share of equal parts among those that either has. A term in the band is in at
least ``MIN_SHARE`` of all documents, so there are at most (mean distinct terms of a document) /
``MIN_SHARE`` of them, however large the corpus is. The lexicon is broadcast up to ``BROADCAST_TERMS``
and joined by shuffle beyond.

Each document is also compared with its successor and with an edited text that takes its second half from
the successor. For that, documents go to ranges of ids, and the first document of each range is also
sent to the range before, so a successor is always in the same range.

Defined cases: a null text is empty; a null id comes last; equal ids follow one another by their text's
hash; the only document is its own successor; without a term in the lexicon all parts are the hash of the
distinct terms, without any term that of the text; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadwise.llm.common import partitions
from threadwise.session import reliable

SUBSETS = 64
MIN_SHARE = 0.001
MAX_SHARE = 0.1
MIN_DOCS = 2
SEED = 17
BROADCAST_TERMS = 500_000
EMPTY = "." * 8
LAST = (1 << 63) - 1


def terms_of(text: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def lexicon(docs: DataFrame, text_col: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """(term, subset, h) of the terms in the band, by the frequencies in all documents."""
    n = docs.count()
    counts = docs.select(F.explode(terms_of(F.col(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = counts.where((F.col("df") >= F.greatest(F.lit(MIN_DOCS), F.lit(min_share * n))) & (F.col("df") <= F.lit(max_share * n)))
    h = F.xxhash64(F.lit(SEED), "term")
    return reliable(band.select("term", F.pmod(h, F.lit(SUBSETS)).cast("int").alias("subset"), h.alias("h")))


def ranges(docs: DataFrame, key: str, n: int) -> list[int]:
    """Where ranges of the key begin: at most ``n`` values that the key takes, the least first."""
    share = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    row = docs.agg(F.min(key).alias("least"), F.percentile_approx(key, share, F.lit(10 * n)).alias("more")).head()
    return [] if row.least is None else sorted({row.least, *row.more})


def with_successor(docs: DataFrame, per_task: int = 8) -> DataFrame:
    """doc_id, text to the same with ``_b`` (range), ``_n`` (place in it), ``_ghost`` (sent from the next
    range) and ``_next`` (the successor's text)."""
    rows = docs.withColumn("_k", F.coalesce("doc_id", F.lit(LAST))).withColumn("_tie", F.xxhash64("text"))
    begin = ranges(rows, "_k", per_task * partitions(docs.sparkSession))
    bounds = F.array(*[F.lit(b).cast("long") for b in begin])
    rows = rows.withColumn("_b", F.greatest(F.lit(1), F.size(F.filter(bounds, lambda x: x <= F.col("_k")))) - 1)
    first = F.col("_k") == F.get(bounds, F.col("_b"))
    before = F.pmod(F.col("_b") - 1, F.lit(max(1, len(begin))))
    copies = F.array(F.struct(F.col("_b").alias("_b"), F.lit(False).alias("_ghost")), F.struct(before.alias("_b"), F.lit(True).alias("_ghost")))
    rows = rows.withColumn("_to", F.explode(F.when(first, copies).otherwise(F.slice(copies, 1, 1)))).drop("_b")
    rows = rows.select("doc_id", "text", "_k", "_tie", "_to._b", "_to._ghost")
    order = Window.partitionBy("_b").orderBy("_ghost", "_k", "_tie")
    return rows.select("doc_id", "text", "_b", "_ghost", F.row_number().over(order).alias("_n"), F.lead("text").over(order).alias("_next"))


def runs_of(found: str) -> Column:
    """A text's parts from its sorted (subset, h) pairs: for each subset with a term, its number in the upper
    and 32 bits of the hash of its terms in the lower half of a long. What each step reads again is bound once."""
    ends = f"filter(transform({found}, (y, i) -> struct(y.subset AS s, i + 1 AS e)), x -> x.e = size({found}) OR get({found}, x.e).subset <> x.s)"
    part = "shiftleft(cast(x.s AS bigint), 32) | (xxhash64(slice(z.hs, coalesce(get(z.ends, j - 1).e, 0) + 1, x.e - coalesce(get(z.ends, j - 1).e, 0))) & 4294967295)"
    return F.expr(f"transform(array(struct({ends} AS ends, transform({found}, y -> y.h) AS hs)), z -> transform(z.ends, (x, j) -> {part}))[0]")


def set_hash(terms: Column) -> Column:
    """A hash of distinct terms, whatever their order; null without terms."""
    return F.when(F.size(terms) > 0, F.aggregate(terms, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.xxhash64(F.lit(SEED), t))))


def or_whole(runs: Column, whole: Column) -> Column:
    """The parts, or where no term is in the lexicon those made from a hash of the whole."""
    part = lambda j: F.shiftleft(j.cast("long"), 32).bitwiseOR(F.xxhash64(whole, j).bitwiseAND(0xFFFFFFFF))
    return F.when(F.size(runs) > 0, runs).otherwise(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), part))


def written(runs: str) -> Column:
    """Eight hex digits per subset, ``EMPTY`` where it has no term."""
    gap = f"repeat('{EMPTY}', cast(shiftright(x, 32) - coalesce(shiftright(get({runs}, j - 1), 32), -1) - 1 AS int))"
    rest = f"repeat('{EMPTY}', cast({SUBSETS - 1} - shiftright(element_at({runs}, -1), 32) AS int))"
    return F.expr(f"concat(array_join(transform({runs}, (x, j) -> concat({gap}, lower(lpad(hex(x & 4294967295), 8, '0')))), ''), {rest})")


def likeness(a: str, b: str) -> Column:
    """Of the subsets of which either text has a term, the share in which their parts are equal."""
    subsets = lambda c: F.transform(c, lambda x: F.shiftright(x, 32))
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(subsets(a), subsets(b)))
    return F.size(F.array_intersect(a, b)) / either


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: DataFrame | None = None) -> DataFrame:
    """The id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = lexicon(docs) if words is None else words
    if words.count() <= BROADCAST_TERMS:
        words = F.broadcast(words)
    rows = with_successor(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half)))
    rows = rows.withColumns({"_t0": terms_of(F.col("text")), "_t1": terms_of(F.col("_edited"))})
    pair = lambda which: lambda t: F.struct(F.lit(which).alias("which"), t.alias("term"))
    mark = F.array(F.struct(F.lit(-1).alias("which"), F.lit("").alias("term")))  # keeps a document without terms
    # Texts end here: what is exploded carries the hashes and no text.
    terms = F.concat(mark, F.transform("_t0", pair(0)), F.transform("_t1", pair(1)))
    whole = lambda t, text: F.coalesce(set_hash(F.col(t)), F.xxhash64(F.lit(SEED), text))
    carried = ["_b", "_n", "_ghost", "doc_id", "n_chars", "edited_sha256", "_w0", "_w1"]
    rows = rows.withColumns({"edited_sha256": F.sha2("_edited", 256), "_w0": whole("_t0", "text"), "_w1": whole("_t1", "_edited")}).select(*carried, terms.alias("_terms"))
    hits = rows.select(*carried, F.inline("_terms")).join(words, "term", "left").where("which < 0 OR h IS NOT NULL")
    pairs = lambda which: F.sort_array(F.collect_list(F.when((F.col("which") == which) & F.col("h").isNotNull(), F.struct("subset", "h"))))
    found = hits.groupBy("_b", "_n").agg(*[F.first(c).alias(c) for c in carried[2:]], pairs(0).alias("_f0"), pairs(1).alias("_f1"))
    found = found.withColumns({"_own": runs_of("_f0"), "_new": runs_of("_f1")})
    found = found.withColumns({"_own": or_whole(F.col("_own"), F.col("_w0")), "_new": or_whole(F.col("_new"), F.col("_w1"))}).drop("_f0", "_f1", "_w0", "_w1")
    found = found.withColumn("_other", F.lead("_own").over(Window.partitionBy("_b").orderBy("_n"))).where("NOT _ghost").withColumn("_other", F.coalesce("_other", "_own"))
    return found.select(
        F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", written("_own").alias("fingerprint"), written("_new").alias("edited_fingerprint"),
        likeness("_own", "_new").alias("near_edited"), likeness("_own", "_other").alias("near_next"),
    )
