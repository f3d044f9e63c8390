"""Exact top-k over weighted postings without scoring all pairs: lists by rarity in tiles of documents.

A tile holds some thousand documents: for each term the documents that have it, and each document's own postings. Terms are
ranked by how many documents have them, and for the most frequent 8, 16, 32, ... a tile holds how long each document's
vector is in these alone. What frequent terms can add to a score is at most the product of that length and the query's
(Cauchy-Schwarz). Once k documents have reached a score, which a query carries from tile to tile, only the lists of its rarer
terms are added up; documents that can still reach the score, by what was added and the bound, are completed from their own
postings, and those that can reach it by the bound alone are looked up by length. Where the split lies is chosen per query and
tile by the number of postings and documents it takes. Tiles are built once and written; tasks only read them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwise.config import Settings
from threadwise.operators.blocks import meet
from threadwise.session import reliable

#: Documents of a tile, and their postings.
DOC_BLOCK, TILE_POSTINGS = 1 << 16, 1 << 21
#: Queries that are looked at together.
QUERIES = 64
#: The most frequent 2**i terms, for i from the first on.
LEVELS = range(3, 13)
#: Scores are compared after rounding to four digits; a bound is loosened by more than rounding can move it.
SLACK = 1.01e-4
DIGITS = 4
#: A first floor is looked for in so many lists and documents of each.
STRONGEST, HEAD = 4, 8
#: What the lists that are not added up may add to most documents, as a share of the floor.
SHARE = 0.9
#: Shorter lists of all queries are read at once, longer ones singly.
LONG = 256
#: Postings that completing a document counts for.
WHOLE = 8


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """So many numbers from each start on, one range after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


@dataclass
class Tile:
    """Postings of up to ``DOC_BLOCK`` documents: ``terms``, with ``starts`` of their lists (one more, the end) in ``docs`` and
    ``light`` (weights), by falling weight, the ``heaviest`` weight and the ``rank`` by length of each; ``own_terms`` and
    ``own_weights`` of each document from ``first`` on; and the ``norms`` of the documents, in no term and per level."""

    terms: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    light: np.ndarray
    heaviest: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    own_terms: np.ndarray
    own_weights: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, term_ids: list[np.ndarray], weights: list[np.ndarray]) -> Tile:
        sizes = np.fromiter(map(len, term_ids), dtype=np.int64, count=len(term_ids))
        own_terms = np.concatenate(term_ids).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
        own = np.concatenate(weights).astype(np.float64) if sizes.sum() else np.zeros(0)
        order = np.lexsort((-own, own_terms))
        terms, number = np.unique(own_terms, return_inverse=True)
        starts = np.append(0, np.cumsum(np.bincount(number, minlength=len(terms))))
        rank = np.empty(len(terms), np.int64)
        rank[np.argsort(-np.diff(starts), kind="stable")] = np.arange(len(terms))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        in_level, norms = rank[number], np.zeros((len(LEVELS) + 1, len(sizes)))
        for i, bits in enumerate(LEVELS, 1):
            few = in_level < 1 << bits
            norms[i] = np.sqrt(np.bincount(doc[few], own[few] ** 2, minlength=len(sizes)))
        heavy = own[order]
        return cls(terms, starts, doc[order], heavy.astype(np.float32), heavy[starts[:-1]], rank, np.append(0, np.cumsum(sizes)), own_terms, own, norms.astype(np.float32))

    def __post_init__(self):
        # each level's norms by size, one level after the other; no norm is over 1
        self.rising = (np.sort(self.norms[1:], axis=1) + 3.0 * np.arange(len(LEVELS))[:, None]).ravel()
        # the first level a term is in
        self.level = np.searchsorted([1 << bits for bits in LEVELS], self.rank, "right")

    def whole(self, asked: np.ndarray, rows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, int]:
        """Scores of documents that have postings, for the queries noted in these rows of ``asked``; and the products."""
        if not len(docs):
            return np.zeros(0), 0
        sizes = self.first[docs + 1] - self.first[docs]
        at = _ranges(self.first[docs], sizes)
        # terms that none of these queries has come to the last column, of zeros
        cells = np.repeat(rows * asked.shape[1], sizes) + np.minimum(self.own_terms[at], asked.shape[1] - 1)
        return np.add.reduceat(asked.ravel()[cells] * self.own_weights[at], np.append(0, np.cumsum(sizes)[:-1])), len(at)

    def best(
        self, asked: np.ndarray, sums: np.ndarray, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, floors: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(rows, document numbers, scores) of all that can be among a query's best k and reach its floor, and the products
        it took. ``rows``, ``terms`` and ``weights`` are the queries' postings by row; ``sums`` is room for a number per document."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        if not len(self.terms):
            return none
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        at, rows, weights = at[known], rows[known], weights[known]
        n, width = len(floors), len(self.first) - 1
        most = weights * self.heaviest[at]
        total = np.bincount(rows, most, minlength=n)
        can = (total >= floors - SLACK) & (total > 0)
        live = can[rows]
        if not live.any():
            return none
        at, rows, weights, most = at[live], rows[live], weights[live], most[live]
        starts, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        products = 0
        new = can & (floors <= 0)
        if new.any():
            # the documents that weigh most in the strongest lists give a floor to begin with
            order = np.lexsort((-most / sizes, rows))
            per = np.bincount(rows, minlength=n)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per)
            strong = order[(place < STRONGEST) & new[rows]]
            few = np.minimum(sizes[strong], HEAD)
            cells = np.unique(np.repeat(rows[strong] * width, few) + self.docs[_ranges(starts[strong], few)])
            got, products = self.whole(asked, cells // width, cells % width)
            floors = np.maximum(floors, _kth(cells // width, got, k, n))
        least = floors - SLACK
        # Per query and level: its length in the terms of the level, and what it takes to leave them out. The first column leaves out none.
        level, columns = self.level[at], len(LEVELS) + 2
        up_to = lambda x: np.cumsum(np.bincount(rows * columns + level + 1, x, minlength=n * columns).reshape(n, columns), axis=1)[:, :-1]
        length = np.sqrt(up_to(weights**2))
        cost = np.bincount(rows, sizes, minlength=n)[:, None] - up_to(sizes)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.fmin(SHARE * np.maximum(least, 0.0)[:, None] / length[:, 1:], 2.0)
        cost[:, 1:] += WHOLE * (np.arange(1, len(LEVELS) + 1) * width - np.searchsorted(self.rising, reach + 3.0 * np.arange(len(LEVELS))))
        split = cost.argmin(axis=1)
        length = length[np.arange(n), split].astype(np.float32)
        enough = np.maximum(least - 1e-5, 1e-30).astype(np.float32)  # of less than this nothing is asked, but that a list was met
        use = level >= split[rows]
        rows, weights, starts, sizes = rows[use], weights[use], starts[use], sizes[use]
        weights = weights.astype(np.float32)
        short = sizes < LONG
        met = _ranges(starts[short], sizes[short])
        met, adds = self.docs.take(met), self.light.take(met) * np.repeat(weights[short], sizes[short])
        products += int(sizes.sum())
        at = np.append(0, np.cumsum(np.bincount(rows[short], sizes[short], minlength=n).astype(np.int64))).tolist()
        long_ = np.searchsorted(rows[~short], np.arange(n + 1)).tolist()
        lists = list(zip(starts[~short].tolist(), (starts + sizes)[~short].tolist(), weights[~short]))
        cells = [np.zeros(0, np.int64)]
        for row in np.flatnonzero(can).tolist():
            np.multiply(self.norms[split[row]], length[row], out=sums)
            np.add.at(sums, met[at[row] : at[row + 1]], adds[at[row] : at[row + 1]])
            for low, high, weight in lists[long_[row] : long_[row + 1]]:  # a list has a document once
                sums[self.docs[low:high]] += self.light[low:high] * weight
            cells.append(np.flatnonzero(sums >= enough[row]) + row * width)
        cells = np.concatenate(cells)
        rows, docs = cells // width, cells % width
        got, more = self.whole(asked, rows, docs)
        keep = got >= np.maximum(least, _kth(rows, got, k, n) - SLACK)[rows]
        return rows[keep], docs[keep], got[keep], products + more


def _kth(rows: np.ndarray, scores: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th best score of each row, or less than any where there are fewer."""
    order = np.lexsort((-scores, rows))
    per = np.bincount(rows, minlength=n)
    full = per >= k
    out = np.full(n, -np.inf)
    out[full] = scores[order[(np.cumsum(per) - per)[full] + k - 1]]
    return out


class _Kept:
    """The best k (score to four digits, then id) per query so far."""

    def __init__(self, n: int, k: int, at_least: float):
        self.k, self.at_least, self.floors = k, at_least, np.full(n, at_least)
        self.rows, self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        scores = np.round(scores, DIGITS)
        if self.ids is None:
            self.ids = ids[:0]
        touched = np.zeros(len(self.floors), dtype=bool)
        touched[rows] = True
        old = touched[self.rows]
        row = np.concatenate([self.rows[old], rows])
        found, named = np.concatenate([self.scores[old], scores]), np.concatenate([self.ids[old], ids])
        order = np.lexsort((named, -found, row))
        row, found, named = row[order], found[order], named[order]
        per = np.bincount(row, minlength=len(self.floors))
        start = np.cumsum(per) - per
        full = per >= self.k
        self.floors[full] = np.maximum(self.at_least, found[start[full] + self.k - 1])
        top = np.arange(len(row)) - np.repeat(start, per) < self.k
        self.rows = np.concatenate([self.rows[~old], row[top]])
        self.scores = np.concatenate([self.scores[~old], found[top]])
        self.ids = np.concatenate([self.ids[~old], named[top]])


def _search(ours: pd.DataFrame, tiles: Iterable[tuple[object, Tile, np.ndarray]], query: str, doc: str, k: int, at_least: float) -> tuple[pd.DataFrame, int]:
    """The best k for each of ``ours`` in tiles of (value that must agree, postings, ids), and the products it took."""
    kept, products = _Kept(len(ours), k, at_least), 0
    sizes = ours["term_ids"].map(len).to_numpy(dtype=np.int64)
    first = np.append(0, np.cumsum(sizes))
    terms = np.concatenate(ours["term_ids"].to_numpy()).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    weights = np.concatenate(ours["weights"].to_numpy()).astype(np.float64) if sizes.sum() else np.zeros(0)
    any_, wanted = ours["_same"].isna().to_numpy(), ours["_same"].to_numpy()
    asked, sums = np.zeros((min(QUERIES, len(ours)), int(terms.max(initial=0)) + 2)), np.zeros(0, np.float32)
    for same, tile, ids in tiles:
        if len(sums) != len(ids):
            sums = np.zeros(len(ids), np.float32)
        own = np.flatnonzero(any_ if same is None else any_ | (wanted == same))
        for at in range(0, len(own), QUERIES):
            some = own[at : at + QUERIES]
            posts, rows = _ranges(first[some], sizes[some]), np.repeat(np.arange(len(some)), sizes[some])
            asked[rows, terms[posts]] = weights[posts]
            found, docs, scores, took = tile.best(asked, sums, rows, terms[posts], weights[posts], k, kept.floors[some])
            asked[rows, terms[posts]] = 0.0
            kept.add(some[found], scores, ids[docs])
            products += took
    order = np.argsort(kept.rows, kind="stable")
    ids = np.zeros(0, dtype=object) if kept.ids is None else kept.ids[order]
    return pd.DataFrame({query: ours[query].to_numpy()[kept.rows[order]], doc: ids, "score": kept.scores[order]}), products


def _tiles(parts: Iterable[pd.DataFrame], doc: str) -> Iterator[tuple[object, Tile, np.ndarray]]:
    """Tiles of packed rows: of stretches of rows that agree, of bounded numbers of documents and postings."""
    for part in parts:
        for same, rows in part.groupby("_same", dropna=False, sort=True):
            block = np.arange(len(rows)) // DOC_BLOCK
            some = np.cumsum(rows["term_ids"].map(len).to_numpy()) // TILE_POSTINGS
            cuts = np.append(np.flatnonzero((block[1:] != block[:-1]) | (some[1:] != some[:-1])) + 1, len(rows))
            for low, high in zip(np.append(0, cuts[:-1]), cuts):
                own = rows.iloc[low:high]
                yield None if pd.isna(same) else same, Tile.of(own["term_ids"].tolist(), own["weights"].tolist()), own[doc].to_numpy()


def best_in_blocks(ours: pd.DataFrame, theirs: pd.DataFrame | Iterable[pd.DataFrame], query: str, doc: str, k: int, at_least: float = 0.0) -> tuple[pd.DataFrame, int]:
    """The best k of ``theirs`` for each of ``ours`` (score to four digits, then id), and the products it took."""
    return _search(ours, _tiles([theirs] if isinstance(theirs, pd.DataFrame) else theirs, doc), query, doc, k, at_least)


def packed(postings: DataFrame, key: str, same: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per text: parallel arrays of term ids (ascending) and weights, and ``_same``, what must agree."""
    rows = postings.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("term_id", "weight"))).alias("_p"), *[F.first(c).alias(c) for c in same]
    )
    agree = F.concat(*[F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in same]) if same else F.lit(None).cast("string")
    return rows.select(
        key, F.transform("_p", lambda p: p["term_id"]).alias("term_ids"), F.transform("_p", lambda p: p["weight"]).alias("weights"), agree.alias("_same")
    )


#: How the parts of a tile are written.
KINDS = {
    "terms": np.int32, "starts": np.int32, "docs": np.int32, "light": np.float32, "heaviest": np.float64, "rank": np.int32,
    "first": np.int32, "own_terms": np.int32, "own_weights": np.float64, "norms": np.float32,
}


def tiles(corpus: DataFrame, doc: str) -> DataFrame:
    """Packed rows as tiles, a row each: ``_tile``, ``_same``, the ids of its documents, and its parts as bytes. The rows are
    dealt by what must agree and by document, about a tile to a task."""
    kind = f"_same string, ids array<{corpus.schema[doc].dataType.simpleString()}>, {', '.join(f'{c} binary' for c in KINDS)}"

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def whole(rows: list[pd.DataFrame]) -> pd.DataFrame:
            out = [[same, ids, *[np.ascontiguousarray(getattr(tile, c), dtype=t).tobytes() for c, t in KINDS.items()]] for same, tile, ids in _tiles([pd.concat(rows)], doc)]
            return pd.DataFrame(out, columns=["_same", "ids", *KINDS])

        held, n, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            n, postings = n + len(batch), postings + int(batch["term_ids"].map(len).sum())
            if n >= DOC_BLOCK or postings >= TILE_POSTINGS:
                yield whole(held)
                held, n, postings = [], 0, 0
        if n:
            yield whole(held)

    n, postings = corpus.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("term_ids")), F.lit(0))).first()
    parts = max(1, -(-n // DOC_BLOCK), -(-postings // TILE_POSTINGS))
    dealt = corpus.repartitionByRange(parts, "_same", doc).sortWithinPartitions("_same", doc)
    return reliable(dealt.mapInPandas(build, kind).withColumn("_tile", F.monotonically_increasing_id()))


def _read(parts: Iterable[pd.DataFrame]) -> Iterator[tuple[object, Tile, np.ndarray]]:
    whole = lambda x: x.astype(np.int64) if x.dtype == np.int32 else x
    for part in parts:
        for row in part.to_dict("records"):
            held = {c: whole(np.frombuffer(row[c], dtype=t)) for c, t in KINDS.items()}
            held["norms"] = held["norms"].reshape(-1, len(row["ids"]))
            yield row["_same"], Tile(**held), np.asarray(row["ids"])


def top_postings(
    queries: DataFrame, corpus: DataFrame, k: int, query: str, doc: str, same: tuple[str, ...] = (), settings: Settings = Settings(), at_least: float = 0.0
) -> DataFrame:
    """(query, doc, score): for each query the k best of each block of documents, from postings of unit vectors.

    The documents are written as tiles once; bounded blocks of queries meet them in the executors (``blocks.meet``), so what is
    shuffled is the postings and k rows per query; never a pair. The hits are written, as callers read them more than once. Only
    scores above zero and of ``at_least`` count. A null in a ``same`` column of a query agrees with everything.
    """
    ours, theirs = reliable(packed(queries, query, same)), tiles(reliable(packed(corpus, doc, same)), doc)
    kinds = f"{query} {queries.schema[query].dataType.simpleString()}, {doc} {corpus.schema[doc].dataType.simpleString()}, score double"
    score = lambda a, b: _search(a, _read(b), query, doc, k, at_least)[0]
    met = meet(ours, query, theirs, "_tile", score, kinds, settings, right_rows=1)
    return reliable(met.where(F.col("score") > 0))
