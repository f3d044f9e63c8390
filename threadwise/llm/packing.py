"""Operator 3: packing token sequences by bounded-space online best fit.

Each input partition keeps a fixed number of open windows. Whole windows are cut off a long document
first. What remains goes into the open window that it fills best; when it fits none, the fullest window
is emitted and a new one begun. Windows still open when a partition ends are merged with those of other
partitions, as units, by the same rule.

Defined cases: a null text has no ids but the end id, as an empty one; equal rows are packed each for
itself; an empty table gives no piece; other columns of the input are left out; a null document id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwise.llm.common import as_bytes, narrow_batches
from threadwise.llm.tokens import word_encoder
from threadwise.session import reliable

WINDOW = 4096
OPEN = 64
MERGED_TOGETHER = 64

PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, leftover boolean"


class OpenWindows:
    """At most ``limit`` open windows; ``place`` gives (window, offset)."""

    def __init__(self, size: int, limit: int, first: int):
        self.size, self.limit, self.next = size, limit, first
        self.fill: dict[int, int] = {}

    def whole(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, n: int) -> tuple[int, int]:
        fits = [(used, -w) for w, used in self.fill.items() if used + n <= self.size]
        if fits:
            used, w = max(fits)
            w = -w
        else:
            if len(self.fill) >= self.limit:
                del self.fill[max(self.fill, key=lambda w: (self.fill[w], -w))]
            w, used = self.whole(), 0
        self.fill[w] = used + n
        if self.fill[w] == self.size:
            del self.fill[w]
        return w, used


def _pack_partition(path: str, end_id: int, size: int, limit: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, windows = word_encoder(path), OpenWindows(size, limit, TaskContext.get().partitionId() << 33)
        late: dict[int, list[tuple]] = {}  # pieces of open windows
        for batch in narrow_batches(batches, "text"):
            ids, counts = encoder.encode(as_bytes(batch.column(1)))
            out, at = [], 0
            for doc_id, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                for start in range(0, n + 1, size):
                    piece = own[start : start + size]
                    w, offset = (windows.whole(), 0) if len(piece) == size else windows.place(len(piece))
                    row = (doc_id, start, len(piece), piece.tobytes(), n + 1, w, offset)
                    (out if len(piece) == size else late.setdefault(w, [])).append((*row, False))
            for w in [w for w in late if w not in windows.fill]:
                out += late.pop(w)
            yield _rows(out, schema)
        for w in list(late):
            yield _rows([(*r[:-1], True) for r in late.pop(w)], schema)

    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _merge_windows(size: int, limit: int):
    schema = pa.schema([("sequence_id", pa.int64()), ("into", pa.int64()), ("shift", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill: dict[int, int] = {}
        for batch in batches:
            for w, used in zip(*(c.to_pylist() for c in batch.columns)):
                fits = [(-u, v) for v, u in fill.items() if u + used <= size]
                into = min(fits)[1] if fits else w
                shift = fill.get(into, 0)
                if not fits and len(fill) >= limit:
                    del fill[max(fill, key=lambda v: (fill[v], -v))]
                fill[into] = shift + used
                if fill[into] == size:
                    del fill[into]
                yield _rows([(w, into, shift)], schema)

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, open_windows: int = OPEN) -> DataFrame:
    """One row per piece: the id column, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Memory per task: ``open_windows`` windows and one batch. The windows left open are at most
    ``open_windows`` per partition; they are merged as (window, used) rows, about 4,096 in a task.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, {PIECES}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    placed = reliable(rows.mapInArrow(_pack_partition(vocabulary, end_id, size, open_windows, to_arrow_schema(StructType.fromDDL(ddl))), ddl))
    open_ = placed.where("leftover").groupBy("sequence_id").agg(F.sum("length").alias("used"))
    groups = F.shiftright(F.col("sequence_id"), 33)
    n = -(-max(1, placed.where("leftover").select(groups.alias("g")).distinct().count()) // MERGED_TOGETHER)
    dealt = open_.repartition(n, F.pmod(F.xxhash64("sequence_id"), F.lit(n))).sortWithinPartitions(F.desc("used"), "sequence_id")
    moved = reliable(dealt.mapInArrow(_merge_windows(size, open_windows * MERGED_TOGETHER), "sequence_id long, into long, shift long"))
    late = placed.where("leftover").join(moved, "sequence_id").withColumn("sequence_id", F.col("into")).withColumn("offset", F.col("offset") + F.col("shift"))
    columns = [c for c in placed.columns if c != "leftover"]
    return placed.where("NOT leftover").select(columns).unionByName(late.select(columns))
