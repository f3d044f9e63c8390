"""Sets of tokens that are alike, met in blocks: per new set, the earliest set of the same kind with a Jaccard similarity of
its tokens that is large enough, and one of its answers that is not.

Every set is written once, dealt to files by kind and size; what it holds are 64-bit hashes of its tokens, rarest first. How
often tokens occur is counted in a table of ``SLOTS`` slots, whatever the vocabulary; tokens that share a slot are ordered
by their hashes, and any order that all sets follow is exact. Sets that are alike share a token among the first quarter or so
of either (a prefix filter). A task indexes these heads of some files and passes over the heads of the files whose kinds
and sizes can meet them. No word and no pair is shuffled: beside the files, only counts of slots and one row per set found are. The places
of the token in common and sketches of ``64 * SKETCH`` bits bound what two sets share before they are compared as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwise.session import shared_folder

#: Slots of the table of counts, and words of 64 bits in the sketch of a set.
SLOTS, SKETCH = 1 << 20, 8
#: Rows and tokens of a file, files that are indexed together, tokens of an index, files that a task passes over, and places in common
#: that are looked at together.
FILE_ROWS, FILE_TOKENS, LEFT, POSTS, RIGHT, MET = 4096, 1 << 21, 8, 1 << 22, 16, 1 << 20
KINDS = 16
TASKS = 64

_SET = pa.schema([
    ("num", pa.int64()), ("kind", pa.int64()), ("at", pa.int64()), ("last", pa.int64()), ("rid", pa.int64()), ("n", pa.int32()), ("b", pa.int32()),
    *[(f"s{i}", pa.int64()) for i in range(SKETCH)], ("r", pa.list_(pa.int64())), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64())),
])
_SPARK = "num long, kind long, at long, last long, rid long, n int, b int, " + "".join(f"s{i} long, " for i in range(SKETCH)) + "r array<long>, head array<long>, tail array<long>"


def _upto(n: np.ndarray, share: float) -> np.ndarray:
    """So many of the first tokens of a set of n are enough to meet all that share so much."""
    return n - np.ceil(n * share - 1e-9).astype(np.int64) + 1


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _ordered(table: np.ndarray, least: float):
    """num, kind, at, last, rid, r, b, h to rows of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                h, ends = _lists(batch.column("h"))
                n = np.diff(ends)
                row = np.repeat(np.arange(len(n)), n)
                h = h[np.lexsort((h, table[h & (SLOTS - 1)], row))]
                bits = np.bincount(row * 64 * SKETCH + ((h >> 40) & (64 * SKETCH - 1)), minlength=len(n) * 64 * SKETCH) & 1
                sketch = np.packbits(bits.astype(np.uint8).reshape(len(n), -1), axis=1).view(np.int64)
                first = np.arange(len(h)) - ends[row] < _upto(n, least)[row]
                cut = lambda keep: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(n)))]).astype(np.int32), pa.array(h[keep]))  # noqa: B023, E731
                held = {c: batch.column(c) for c in ("num", "kind", "at", "last", "rid", "b", "r")}
                held |= {"n": pa.array(n.astype(np.int32)), "head": cut(first), "tail": cut(~first)} | {f"s{i}": pa.array(sketch[:, i].copy()) for i in range(SKETCH)}
                yield pa.RecordBatch.from_arrays([held[f.name].cast(f.type) for f in _SET], schema=_SET)

    return run


class _Rows:
    """Some sets of a file; the tails of their tokens are read only where they are asked for."""

    def __init__(self, file, group: int):
        self.file, self.group = file, group
        got = file.read_row_group(group, columns=[f.name for f in _SET if f.name != "tail"])
        self.num, self.kind, self.at, self.rid = (got.column(c).to_numpy() for c in ("num", "kind", "at", "rid"))
        self.n = got.column("n").to_numpy().astype(np.int64)
        # nothing new: nothing is asked
        self.last = got.column("last").combine_chunks().fill_null(-(2**63)).to_numpy()
        self.sketch = np.stack([got.column(f"s{i}").to_numpy() for i in range(SKETCH)], axis=1).view(np.uint64)
        self.r, self.head, self.tail = _lists(got.column("r")), _lists(got.column("head")), None

    def tokens(self, i: int) -> np.ndarray:
        if self.tail is None:
            self.tail = _lists(self.file.read_row_group(self.group, columns=["tail"]).column("tail"))
        return np.concatenate([v[e[i] : e[i + 1]] for v, e in (self.head, self.tail)])

    def answers(self, i: int) -> frozenset[int]:
        v, e = self.r
        return frozenset(v[e[i] : e[i + 1]].tolist())

    def posts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, row, place from 1) of the rows' heads."""
        v, e = self.head
        row = np.repeat(np.arange(len(self.n)), np.diff(e))
        keep = rows[row]
        place = np.arange(len(v)) - e[row] + 1
        return v[keep], row[keep], place[keep]


def _open(uri: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    return pq.ParquetFile(system.open_input_file(path))


def _groups(files: list[str]) -> Iterator[_Rows]:
    for uri in files:
        file = _open(uri)
        for group in range(file.metadata.num_row_groups):
            yield _Rows(file, group)


class _Index:
    """The heads of some sets by token."""

    def __init__(self, parts: list[tuple[_Rows, np.ndarray]]):
        self.parts = [p for p, _ in parts]
        self.start = np.cumsum([0, *[len(p.n) for p in self.parts]])
        every = lambda name: np.concatenate([getattr(p, name) for p in self.parts])
        self.num, self.kind, self.rid, self.n, self.sketch = (every(c) for c in ("num", "kind", "rid", "n", "sketch"))
        self.until = every("last").copy()
        posts = [(t, row + at, place) for (p, rows), at in zip(parts, self.start) for t, row, place in [p.posts(rows)]]
        token, row, place = (np.concatenate(x) for x in zip(*posts))
        order = np.argsort(token, kind="stable")
        self.token, self.row, self.place = token[order], row[order], place[order]
        self.found = np.zeros(len(self.num), dtype=bool)

    def part(self, i: int) -> tuple[_Rows, int]:
        k = int(np.searchsorted(self.start, i, side="right")) - 1
        return self.parts[k], i - int(self.start[k])


def _indexes(files: list[str]) -> Iterator[_Index]:
    """The rows of files that hold something new, in indexes of a bounded number of tokens."""
    held, n = [], 0
    for part in _groups(files):
        new = part.last > -(2**63)
        size = np.where(new, np.diff(part.head[1]), 0).cumsum()
        for turn in range(int(size[-1]) // POSTS + 1 if len(size) else 0):
            rows = new & (size // POSTS == turn)
            more = int(np.diff(part.head[1])[rows].sum())
            if held and n + more > POSTS:
                yield _Index(held)
                held, n = [], 0
            if more:
                held.append((part, rows))
                n += more
    if held:
        yield _Index(held)


def _meet(index: _Index, other: _Rows, least: float, most: float, clash: dict[tuple[int, int], bool]) -> None:
    """Note in ``index.until`` the earliest of ``other`` that conflicts."""
    token, row, place = other.posts(np.ones(len(other.n), dtype=bool))
    order = np.argsort(token, kind="stable")
    token, row, place = token[order], row[order], place[order]
    lo = np.searchsorted(index.token, token, side="left")
    count = np.searchsorted(index.token, token, side="right") - lo
    some = np.flatnonzero(count)
    row, place, lo, count = row[some], place[some], lo[some], count[some]
    ends = np.cumsum(count)
    short = lambda n, place: place <= _upto(n, 2 * least / (1 + least))
    start = 0
    while start < len(row):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + MET, side="right")))
        c = count[start:stop]
        them = np.repeat(np.arange(start, stop), c)
        me = np.arange(len(them)) + np.repeat(lo[start:stop] - (np.cumsum(c) - c), c)
        x, y = index.row[me], row[them]
        nx, ny = index.n[x], other.n[y]
        ok = np.flatnonzero((np.minimum(nx, ny) >= least * np.maximum(nx, ny)) & (other.at[y] < index.until[x]))
        me, them, x, y, nx, ny = me[ok], them[ok], x[ok], y[ok], nx[ok], ny[ok]
        px, py = index.place[me], place[them]
        # what follows the first token in common must be enough, and the smaller set is met by its shorter head
        ok = np.minimum(nx - px, ny - py) + 1 >= (nx + ny) * (least / (1 + least)) - 1e-9
        sx, sy = short(nx, px), short(ny, py)
        ok &= np.where(nx < ny, sx, np.where(nx > ny, sy, sx | sy))
        pairs = np.unique(x[ok] * len(other.n) + y[ok])
        _compare(index, other, pairs // len(other.n), pairs % len(other.n), least, most, clash)
        start = stop


def _compare(index: _Index, other: _Rows, x: np.ndarray, y: np.ndarray, least: float, most: float, clash: dict[tuple[int, int], bool]) -> None:
    # equal answers are no conflict, unless there are none
    none = np.diff(other.r[1])[y] == 0
    ok = (index.num[x] != other.num[y]) & (index.kind[x] == other.kind[y]) & ((index.rid[x] != other.rid[y]) | none)
    x, y = x[ok], y[ok]
    apart = np.bitwise_count(index.sketch[x] ^ other.sketch[y]).sum(axis=1, dtype=np.int64)
    ok = apart <= (index.n[x] + other.n[y]) * ((1 - least) / (1 + least)) + 1e-9
    x, y = x[ok], y[ok]
    order = np.argsort(other.at[y], kind="stable")
    for i, j in zip(x[order].tolist(), y[order].tolist()):
        if other.at[j] >= index.until[i]:
            continue
        part, k = index.part(i)
        key = (int(index.rid[i]), int(other.rid[j]))
        if key not in clash:
            if len(clash) > 1 << 16:
                clash.clear()
            a, b = part.answers(k), other.answers(j)
            clash[key] = (len(a & b) / len(a | b) if a | b else 0.0) < most
        if not clash[key]:
            continue
        both = len(np.intersect1d(part.tokens(k), other.tokens(j), assume_unique=True))
        if both / (index.n[i] + other.n[j] - both) >= least:
            index.until[i], index.found[i] = other.at[j], True


def first_conflicts(sets: DataFrame, least: float, most: float) -> DataFrame:
    """(num, first) of the sets that hold something new, where ``first`` is before ``last``: the least ``at`` of another set of
    the same kind whose tokens are alike by ``least`` and whose answers are alike by less than ``most``.

    ``sets`` holds num, kind, q and r (distinct tokens and answers, joined by blanks; at least one token), at, last (null where
    nothing is new).
    """
    spark = sets.sparkSession
    hashes = lambda c, *seed: F.transform(F.split(c, " "), lambda t: F.xxhash64(*seed, t))
    h = hashes("q", F.col("kind")).alias("h")
    r = F.when(F.col("r") == "", F.array().cast("array<long>")).otherwise(F.array_sort(hashes("r")))
    n, tokens = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.split("q", " "))), F.lit(0))).first()
    slot = F.col("t").bitwiseAND(F.lit(SLOTS - 1).cast("long")).alias("slot")
    counted = sets.select(h).select(F.explode("h").alias("t")).groupBy(slot).agg(F.count(F.lit(1)).alias("c")).toArrow()
    table = np.zeros(SLOTS, dtype=np.int32)
    table[counted.column("slot").to_numpy()] = np.minimum(counted.column("c").to_numpy(), 2**31 - 1)
    path = shared_folder(spark, "sets")
    rows = sets.withColumn("b", F.pmod(F.xxhash64("kind"), F.lit(KINDS)).cast("int")).withColumn("n", F.size(F.split("q", " ")))
    # texts are dealt, which compress; hashes do not
    dealt = rows.repartitionByRange(max(math.ceil(n / FILE_ROWS), math.ceil(tokens / FILE_TOKENS), 1), "b", "n", "num")
    # hashed before ``kind`` is, as the table of counts was made of the same hashes
    hashed = dealt.select("num", "kind", "at", "last", "r", "b", h, r.alias("_r"))
    hashed = hashed.select("num", F.xxhash64("kind").alias("kind"), "at", "last", F.xxhash64("_r").alias("rid"), F.col("_r").alias("r"), "b", "h")
    hashed.mapInArrow(_ordered(table, least), _SPARK).write.parquet(path)
    held = spark.read.schema(_SPARK).parquet(path).groupBy(F.input_file_name().alias("file"))
    size = [f(c).alias(f"{o}_{c}") for c in ("b", "n") for o, f in (("min", F.min), ("max", F.max))]
    files = held.agg(*size, F.count("last").alias("new")).orderBy("min_b", "min_n", "file").collect()  # names and bounds only
    mine = [f for f in files if f.new]
    left = max(1, min(LEFT, len(mine) // 8))
    meets = lambda f, g: f.min_b <= g.max_b and g.min_b <= f.max_b and f.max_n >= least * g.min_n and g.max_n >= least * f.min_n
    groups = [mine[i : i + left] for i in range(0, len(mine), left)]
    theirs = [[g.file for g in files if any(meets(f, g) for f in group)] for group in groups]
    each = max(1, min(RIGHT, math.ceil(sum(map(len, theirs)) / TASKS)))
    tasks = [([f.file for f in group], other[i : i + each]) for group, other in zip(groups, theirs) for i in range(0, len(other), each)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                own, others = tasks[number]
                for index in _indexes(own):
                    clash: dict[tuple[int, int], bool] = {}
                    for other in _groups(others):
                        _meet(index, other, least, most, clash)
                    yield pa.RecordBatch.from_arrays([pa.array(index.num[index.found]), pa.array(index.until[index.found])], names=["num", "first"])

    # a task for each: comparing is far more work than the numbers weigh
    found = spark.range(0, len(tasks), 1, max(len(tasks), 1)).mapInArrow(run, "num long, first long")
    return found.groupBy("num").agg(F.min("first").alias("first"))
