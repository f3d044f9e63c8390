"""Operator 11: periodic runs of words, by an online sparse dynamic programme over diagonals.

A run of period q is a stretch of words in which words q apart are equal, that no neighbouring word extends, of
at least ``max(MIN_WORDS, MIN_POWER * q)`` words; q is its smallest period. Words come one after another. Each
keeps the match lengths of the active lags: an earlier occurrence of the word at a lag adds one to
that lag's length, any other word ends it, and a lag that ends long enough emits its run at once.

What keeps the diagonals sparse, without losing a run:

* A run has at least ``MIN_MATCH`` matches in a row, so a lag begins only where the last ``MIN_MATCH`` words occur
  earlier in the text. Texts without such a place are done when that is known.
* A run of period q matches over more than q words in a row, so lag q need only begin at word numbers divisible
  by q. The earlier occurrences, or the divisors of the word number, whichever are fewer, give those lags.
  What matched before is found by going back, less than q words.
* Where an active lag p that divides q already covers q words, the stretch of q has period p and ends with it,
  so q is not begun.

Memory is a text's words and one number a word; the work on a text of n words is about n log n, also when all
words are equal.

Defined cases: a null text has no words, no runs and an empty ``collapsed``; equal rows get equal results; null
ids stay null; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwise.llm.common import WORD, as_bytes, narrow_batches

MIN_WORDS = 6
MIN_POWER = 4
#: Matches in a row of the shortest run: six words of period one.
MIN_MATCH = 5

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def needed(lag: int) -> int:
    """Matches in a row that make a run of this lag."""
    return max(MIN_WORDS, MIN_POWER * lag) - lag


def grams(ids: np.ndarray) -> np.ndarray:
    """A hash of the ``MIN_MATCH`` words that end at each word, from word ``MIN_MATCH - 1`` on."""
    n = len(ids) - MIN_MATCH + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(MIN_MATCH):
        h = (h ^ ids[k : k + n]) * FACTOR
        h ^= h >> np.uint64(31)
    return h


class Divisors:
    """Divisors of numbers from a table of smallest prime factors, which grows to the longest text."""

    def __init__(self) -> None:
        self.least = array("i")

    def upto(self, n: int) -> None:
        if n < len(self.least):
            return
        least = np.arange(max(n + 1, 1 << 12), dtype=np.int32)
        for p in range(2, int(len(least) ** 0.5) + 1):
            if least[p] == p:
                own = least[p * p :: p]
                own[own == np.arange(p * p, len(least), p)] = p
        self.least = array("i", least.tobytes())

    def of(self, n: int) -> list[int]:
        out = [1]
        while n > 1:
            p, power, more = self.least[n], 1, []
            while n % p == 0:
                n //= p
                power *= p
                more += [d * power for d in out]
            out += more
        return out


DIVISORS = Divisors()


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    n = len(ids)
    if n < MIN_WORDS:
        return []
    # Number of the last words' hash at each place, where that hash occurs more than once; -1 elsewhere.
    _, which, counts = np.unique(grams(ids), return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[which] > 1)
    if not len(again):
        return []
    gram = np.full(n, -1, dtype=np.int64)
    gram[again + MIN_MATCH - 1] = which[again]
    DIVISORS.upto(n)
    word, gram, again = ids.tolist(), gram.tolist(), (again + MIN_MATCH - 1).tolist()
    seen: dict[int, list[int]] = {}
    first: dict[int, int] = {}  # active lag -> word at which its matches began
    found: dict[tuple[int, int], int] = {}  # (start, length) -> smallest period

    def ended(lag: int, end: int) -> None:
        begun = first.pop(lag)
        if end - begun >= needed(lag):
            at = (begun - lag, end - begun + lag)
            found[at] = min(lag, found.get(at, lag))

    def begin(lag: int, i: int) -> None:
        oldest = next(iter(first), None)
        if oldest and lag % oldest == 0 and i - first[oldest] + 1 + oldest >= lag:
            return
        if any(p in first and i - first[p] + 1 + p >= lag for p in DIVISORS.of(lag)):
            return
        t = i
        while t > lag and word[t - 1] == word[t - 1 - lag]:
            t -= 1
        first[lag] = t

    places = iter(again)
    i = next(places)
    while True:
        for lag in [p for p in first if word[i] != word[i - p]]:
            ended(lag, i)
        if gram[i] >= 0:
            before = seen.setdefault(gram[i], [])
            if before:
                if len(before) <= 32:
                    lags = [i - j for j in reversed(before) if i % (i - j) == 0]
                else:
                    lags = sorted(d for d in DIVISORS.of(i) if gram[i - d] == gram[i])
                for lag in lags:
                    if lag not in first and MIN_POWER * lag <= n and word[i] == word[i - lag]:
                        begin(lag, i)
            before.append(i)
        if first:
            i += 1
            if i == n:
                break
        else:
            i = next((p for p in places if p > i), None)
            if i is None:
                break
    for lag in list(first):
        ended(lag, n)
    return sorted((start, length, lag) for (start, length), lag in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: all but those that lie in a run behind its first period."""
    step = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step)[:n] == 0


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.binary())])
    for batch in narrow_batches(batches, "text"):
        numbers: dict[bytes, int] = {}
        counts, runs, collapsed = [], [], []
        for text in as_bytes(batch.column(1)):
            words = text.split()
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.uint64, count=len(words))
            found = runs_of(ids)
            counts.append(len(words))
            runs.append(found)
            collapsed.append(b" ".join(itertools.compress(words, kept_words(len(words), found)) if found else words))
        flat = list(itertools.chain.from_iterable(runs))
        parts = [pa.array([r[k] for r in flat], type=pa.int64()) for k in range(3)]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), type=pa.int32())
        listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(run)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, type=pa.int64()), listed, pa.array(collapsed, type=pa.binary())], schema=schema)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``n_words``, ``runs`` (start, length, period; by start, then period) and
    ``collapsed`` (UTF-8 bytes), the words that stay when each run is cut to its first period, joined by a blank."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(_find, f"id long, n_words long, runs {RUNS}, collapsed binary")
    return found.withColumnRenamed("id", id_col)


def strongest(runs: str = "runs") -> Column:
    """The run of the greatest length over period; of equals the one that comes first."""
    better = "x.length * best.period > best.length * x.period"
    return F.expr(f"aggregate({runs}, get({runs}, 0), (best, x) -> if({better}, x, best))")


def made_periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The test texts: with h the CRC-32 of the decimal id and g = h div 10, a tenth of the documents (h divisible
    by 10) repeat, from word a = g % n on, the p = 1 + (n - a) div (3 + g % 8) words that begin there."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col), F.col(text_col), F.floor(h / 10).alias("_g"), (h % 10 == 0).alias("_made"))
    words = F.expr(f"if(_made, regexp_extract_all({text_col}, '{WORD}', 0), null)".replace("\\", "\\\\"))
    text = """transform(array(named_struct('w', _words, 'n', size(_words), 'a', _g % size(_words),
        'p', 1 + (size(_words) - _g % size(_words)) div (3 + _g % 8))),
        s -> array_join(transform(sequence(0, s.n - 1), i -> get(s.w, cast(if(i < s.a, i, s.a + (i - s.a) % s.p) as int))), ' '))[0]"""
    rows = rows.withColumn("_words", words)
    return rows.select(id_col, F.when(F.size("_words") > 0, F.expr(text)).otherwise(F.col(text_col)).alias(text_col))
