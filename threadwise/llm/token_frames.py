"""Operator 6: token ids in files of independent zstandard frames with a trailing seek table.

A file holds documents in ascending id order: data frames (whole documents, ids as little-endian
unsigned integers), then one index frame (ids of the documents and how many tokens and which frame
each has), then a skippable frame with the seek table: for every frame its compressed size, plain size
and checksum (low 32 bits of the plain bytes' XXH64), the number of frames, flags and a magic number.
A reader fetches the tail, the index frame and only the frames that hold the documents it wants.

Defined cases: a null text has the end id alone, as an empty one; a null id sorts first; equal ids
follow one another in the order of their texts' hash; an empty table gives no file and no row; other
columns are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadwise.llm.common import as_bytes, narrow_batches, partitions
from threadwise.llm.files import new_file, read_random
from threadwise.llm.tokens import word_encoder
from threadwise.session import reliable, shared_folder

FRAME_BYTES = 256 << 10
FILE_BYTES = 64 << 20
# Magic numbers and flag of the seekable zstandard format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

MANIFEST = "part long, seq long, path string, n_docs long, n_tokens long"
DOCS = "path string, doc_id long, start long, n_tokens long, ids binary"


def _check(plain: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class FrameWriter:
    """Writes one file. ``width``: bytes of an id, 2 or 4."""

    def __init__(self, out, width: int, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.buffer: list[bytes] = []
        self.size, self.written, self.table = 0, 0, []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.frame_of: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        plain = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.frame_of.append(len(self.table))
        self.buffer.append(plain)
        self.size += len(plain)
        if self.size >= self.frame_bytes:
            self._frame(b"".join(self.buffer))
            self.buffer, self.size = [], 0

    def _frame(self, plain: bytes) -> None:
        packed = self.zstd.compress(plain)
        self.out.write(packed)
        self.written += len(packed)
        self.table.append((len(packed), len(plain), _check(plain)))

    def close(self) -> None:
        if self.buffer:
            self._frame(b"".join(self.buffer))
        n = len(self.doc_ids)
        known = np.array([d is not None for d in self.doc_ids], dtype="u1")
        ids = np.array([d or 0 for d in self.doc_ids], dtype="<i8")
        head = struct.pack("<QQ", n, self.width)
        self._frame(head + known.tobytes() + ids.tobytes() + np.array(self.counts, "<u8").tobytes() + np.array(self.frame_of, "<u4").tobytes())
        rows = b"".join(struct.pack("<III", *r) for r in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE))


class FrameReader:
    """Reads documents of one file by random access."""

    def __init__(self, file):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        size = file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        raw = self._at(size - 9 - 12 * n, 12 * n)
        self.table = [struct.unpack_from("<III", raw, 12 * i) for i in range(n)]
        self.begin = np.concatenate([[0], np.cumsum([t[0] for t in self.table])]).tolist()
        index = self.frame(n - 1)
        n, self.width = struct.unpack_from("<QQ", index)
        self.known = np.frombuffer(index, "u1", n, 16).astype(bool)
        self.doc_ids = np.frombuffer(index, "<i8", n, 16 + n)
        self.counts = np.frombuffer(index, "<u8", n, 16 + 9 * n).astype(np.int64)
        self.frame_of = np.frombuffer(index, "<u4", n, 16 + 17 * n)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, i: int) -> bytes:
        packed, size, check = self.table[i]
        plain = self.zstd.decompress(self._at(self.begin[i], packed), max_output_size=size)
        if len(plain) != size or _check(plain) != check:
            raise ValueError(f"frame {i} is damaged")
        return plain

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, ids before it in this file, ids) of the wanted documents, or of all."""
        keep = np.ones(len(self.counts), bool) if wanted is None else self.known & np.isin(self.doc_ids, list(wanted))
        kind = "<u2" if self.width == 2 else "<u4"
        for f in np.unique(self.frame_of[keep]).tolist():
            plain = np.frombuffer(self.frame(f), kind)
            here = np.flatnonzero(self.frame_of == f)
            first = self.starts[here[0]]
            for i in here[keep[here]].tolist():
                a = int(self.starts[i] - first)
                yield (int(self.doc_ids[i]) if self.known[i] else None), int(self.starts[i]), plain[a : a + int(self.counts[i])].astype("<u4")


def _write_partition(vocabulary: str, end_id: int, folder: str, file_bytes: int):
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seq = word_encoder(vocabulary), TaskContext.get().partitionId(), 0
        width = 2 if max(encoder.tokenizer.get_vocab_size(True), end_id + 1) <= 1 << 16 else 4

        def rows():
            for batch in narrow_batches(batches, "text"):
                ids, counts = encoder.encode(as_bytes(batch.column(1)))
                at = 0
                for doc_id, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                    yield doc_id, np.append(ids[at : at + n], np.uint32(end_id))
                    at += n

        pending = rows()
        row = next(pending, None)
        while row is not None:
            with new_file(folder, f"tokens-{part:06d}-{seq:04d}", ".zst") as (out, uri):
                writer = FrameWriter(out, width)
                while row is not None and writer.written < file_bytes:
                    writer.add(*row)
                    row = next(pending, None)
                writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, seq, uri, len(writer.counts), sum(writer.counts))], schema=schema)
            seq += 1

    return run


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode the documents, write the files, and return their manifest with ``base``: the ids in all
    files before. Files follow the document ids; one shuffle carries the texts, a range of ids to each task."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("tie"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    files = reliable(dealt.mapInArrow(_write_partition(vocabulary, end_id, shared_folder(spark, "tokens"), file_bytes), MANIFEST))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read_files(wanted: set[int] | None):
    schema = pa.schema([("path", pa.string()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                rows, size = [], 0
                with read_random(path) as file:
                    for doc_id, start, ids in FrameReader(file).documents(wanted):
                        rows.append((path, doc_id, base + start, len(ids), ids.tobytes()))
                        size += 4 * len(ids)
                        if size > 4 << 20:
                            yield _batch(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_tokens(spark: SparkSession, manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of the files in ``manifest``: path, doc_id, start over all files, n_tokens, ids (uint32)."""
    files = manifest.select("path", "base").repartition(partitions(spark), "path")
    return files.mapInArrow(_read_files(set(doc_ids) if doc_ids is not None else None), DOCS)
