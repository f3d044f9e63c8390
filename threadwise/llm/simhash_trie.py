"""Operator 4: SimHash near-duplicates by a self-join of a binary trie.

Fingerprints: A-Z lower-cased, word shingles joined by a blank, XXH64 with seed 42; a bit is 1 if set in over
half the hashes. Fewer words than a shingle make one shingle, no words the fingerprint zero.

The trie over the distinct fingerprints is cut at its top bits. Every pair of top nodes whose prefixes
differ in no more bits than the budget is one task; inside, pairs of nodes are traversed together, the
differing bits add up, and a pair beyond the budget is dropped with all below it. Small pairs of nodes are
compared outright. A task sends a star per local component, never its pairs. The budget is deepened
(1, 2, ... bits); pairs of nodes that already lie in one component are passed over, so a dense ball of
fingerprints is not compared pair by pair.

Defined cases: a null text has no words; a null id never names a component but its row is returned; equal
rows share everything; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwise.llm.common import as_bytes, narrow_batches, partitions
from threadwise.llm.components import components
from threadwise.session import reliable

SHINGLE = 3
SEED = 42
BUDGET = 3
NODE_ROWS = 20_000
SMALL_NODE = 500
LEAF_PAIRS = 32
FRONTIER = 1 << 18
PIECE = 1 << 19


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, in arrays of at most ``PIECE``."""
    from xxhash import xxh64_intdigest

    if len(words) <= size:
        if words:
            yield np.array([xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
        return
    for at in range(0, len(words) - size + 1, PIECE):
        own = words[at : at + PIECE + size - 1]
        joined = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1)
        starts = np.concatenate([[0], ends[:-size]]).tolist()
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]
        yield np.array(hashes, dtype=np.uint64)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, for runs of hashes that begin at ``starts``.

    Eight bits are counted at once in the bytes of a word, at most 255 hashes at a time."""
    ends = np.append(starts[1:], len(hashes))
    blocks = -(-(ends - starts) // 255)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    at = np.repeat(starts - 255 * first, blocks) + 255 * np.arange(blocks.sum())
    out = np.zeros((len(starts), 64), dtype=np.int64)
    for k in range(8):
        lanes = (hashes >> np.uint64(k)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(lanes, at).astype("<u8").view(np.uint8).reshape(-1, 8)
        out[:, k::8] = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
    return out


def fingerprints(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Fingerprints of whole texts as uint64."""
    out = np.zeros(len(texts), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    held, owner, total = [], [], 0

    def settle() -> None:
        if held:
            starts = np.concatenate([[0], np.cumsum([len(h) for h in held])[:-1]])
            counts = bit_counts(np.concatenate(held), starts)
            own, at = np.unique(owner, return_index=True)
            counts = np.add.reduceat(counts, at, axis=0)
            sizes = np.add.reduceat([len(h) for h in held], at)
            out[own] = ((2 * counts > sizes[:, None]) * weights).sum(axis=1, dtype=np.uint64)

    for i, text in enumerate(texts):
        for h in shingle_hashes(text.lower().split(), size):
            held.append(h)
            owner.append(i)
            total += len(h)
        if total > PIECE:
            settle()
            held, owner, total = [], [], 0
    settle()
    return out


def _fingerprint_batches(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in narrow_batches(batches, "text"):
            fps = fingerprints(as_bytes(batch.column(1)), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=schema)

    return run


# ---------------------------------------------------------------- trie self-join


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the components of i and j pairwise; a label is the smallest index of its component."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


def _expand(fps: np.ndarray, chunk: tuple, depth: int, budget: int) -> tuple:
    """Pairs of nodes one bit further down."""
    xl, xh, yl, yh, err = chunk
    bit = np.uint64(1 << (63 - depth))
    above = np.uint64(~((1 << (64 - depth)) - 1) & 0xFFFFFFFFFFFFFFFF)
    xm = np.clip(np.searchsorted(fps, (fps[xl] & above) | bit), xl, xh)
    ym = np.clip(np.searchsorted(fps, (fps[yl] & above) | bit), yl, yh)
    twin = xl == yl
    parts = ((xl, xm, yl, ym, err), (xm, xh, ym, yh, err), (xl, xm, ym, yh, err + 1), (xm, xh, yl, ym, np.where(twin, budget + 1, err + 1)))
    out = [np.concatenate(c) for c in zip(*parts)]
    keep = (out[0] < out[1]) & (out[2] < out[3]) & (out[4] <= budget)
    return tuple(c[keep] for c in out)


def _compare(fps: np.ndarray, chunk: tuple, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside small pairs of nodes that are within the budget."""
    xl, xh, yl, yh, _ = chunk
    n = (xh - xl) * (yh - yl)
    which = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = (yh - yl)[which]
    i, j = xl[which] + inside // wide, yl[which] + inside % wide
    near = (np.bitwise_count(fps[i] ^ fps[j]) <= budget) & (i != j)
    return i[near], j[near]


def trie_links(fps: np.ndarray, left: slice, right: slice, budget: int = BUDGET) -> np.ndarray:
    """Labels of the components that links between ``left`` and ``right`` of sorted fingerprints make."""
    label = np.arange(len(fps))
    for most in range(1, budget + 1):
        start = tuple(np.array([v], dtype=np.int64) for v in (left.start, left.stop, right.start, right.stop, 0))
        stack = [(start, 0)]
        while stack:
            chunk, depth = stack.pop()
            change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            xl, xh, yl, yh, _ = chunk
            one = (change[xl] == change[xh - 1]) & (change[yl] == change[yh - 1]) & (label[xl] == label[yl])
            small = ~one & ((xh - xl) * (yh - yl) <= LEAF_PAIRS)
            if small.any():
                i, j = _compare(fps, tuple(c[small] for c in chunk), most)
                label = merge_labels(label, i, j)
            rest = ~one & ~small
            if depth < 64 and rest.any():
                below = _expand(fps, tuple(c[rest] for c in chunk), depth, most)
                for at in range(0, len(below[0]), FRONTIER):
                    stack.append((tuple(c[at : at + FRONTIER] for c in below), depth + 1))
    return label


def _join_nodes(bits: int, budget: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        fps = np.unique(group["fp"].to_numpy().view(np.uint64))
        a, b = group["a"][0].as_py(), group["b"][0].as_py()
        top = fps >> np.uint64(64 - bits) if bits else np.zeros(len(fps), dtype=np.uint64)
        cut = lambda p: slice(int(np.searchsorted(top, np.uint64(p))), int(np.searchsorted(top, np.uint64(p), side="right")))
        left, right = cut(a), cut(b)
        if left.start == left.stop or right.start == right.stop:
            return schema.empty_table()
        label = trie_links(fps, left, right, budget)
        hung = np.flatnonzero(label != np.arange(len(label)))
        signed = fps.view(np.int64)
        return pa.table([pa.array(signed[hung]), pa.array(signed[label[hung]])], schema=schema)

    return run


def near_links(distinct: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (u, v) that connect just the fingerprints connected by pairs within the budget. A task holds the
    distinct fingerprints of two top nodes, 8 bytes each; the cut is chosen for ``node_rows`` in a node,
    and for as many pairs of nodes as there are tasks, unless nodes get small."""
    n, tasks, bits = distinct.count(), partitions(distinct.sparkSession), 0
    near = lambda bits: [x for x in range(1 << bits) if x.bit_count() <= budget]
    while bits < 14 and (n >> bits > node_rows or (n >> bits > SMALL_NODE and len(near(bits)) << bits < 2 * tasks)):
        bits += 1
    flips = near(bits)
    top = F.shiftrightunsigned(F.col("fp"), 64 - bits) if bits else F.lit(0).cast("long")
    rows = distinct.select("fp", top.alias("t"), F.explode(F.array(*[F.lit(x).cast("long") for x in flips])).alias("flip"))
    other = F.col("t").bitwiseXOR(F.col("flip"))
    rows = rows.select("fp", F.least("t", other).alias("a"), F.greatest("t", other).alias("b"))
    return rows.groupBy("a", "b").applyInArrow(_join_nodes(bits, budget), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row per document: the id, ``fingerprint`` (hex) and ``component_id``, the smallest id reachable."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = reliable(rows.mapInArrow(_fingerprint_batches(size), "doc_id long, fp long"))
    distinct = reliable(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(distinct.select("fp"), budget))
    linked = distinct.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = reliable(linked.select("fp", "root").join(least, "root").select("fp", "component_id"))
    classes = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    classes = reliable(classes)
    out = marked.join(classes, "fp")
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
