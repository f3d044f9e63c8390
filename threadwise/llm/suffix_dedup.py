"""Operator 2: removal of repeated passages by a sparse distributed suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (in a smaller document, or before
it in the same one). Every such string holds at least one *anchor*: of its ``LEAD``-byte substrings the one
with the smallest mixed hash, the leftmost of equal ones. Equal strings have the same anchor, so only
suffixes that start at anchors are compared, about one position in 40. A *segment* is the run of strings
that share an anchor, with all their bytes.

1. Suffixes are range-partitioned by their leading bytes, then by hashes (splitters from a bounded sample of
   documents). A task first folds its own equal segments, so a passage sends one row per task however hot it
   is. A bucket sorts by multikey quicksort (leading bytes, hash of the anchor, hash of the segment,
   position). Of equal neighbours all but the first are repeats as a whole. Equal segments never lie on two
   sides of a boundary.
2. Where segments with one anchor differ, the first of each kind has to be looked at string by string. Usually
   the bytes of these segments meet in the bucket of their anchor. An anchor that a splitter cuts, so whose
   segments lie on both sides of a boundary, may have any number of them: their single strings are folded,
   range-partitioned, sorted and compared as suffixes of their own.
3. The repeated runs of a document meet its text, and the covered bytes are cut out.

Hashes are 64-bit polynomial ones over a seeded byte table; whole texts are read, nothing is capped.

Defined cases: a null text is empty; rows with an equal id are ordered by their text's hash, and rows equal
in id and text count as one document, changed alike; null ids come last; texts shorter than ``LENGTH`` stay;
an empty table gives no row; other columns are kept, and columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwise.llm.common import narrow_batches, partitions
from threadwise.session import reliable

LENGTH = 100
LEAD = 24
SAMPLE_DOCS = 4000
SAMPLE_SUFFIXES = 64
BUCKETS_PER_TASK = 4
BLOCK = 2 << 20
FOLD_ROWS = 3_000_000
BYTES_HELD = 32 << 20
AT_ONCE = 256  # segments taken apart together
ADDED = ("n_bytes", "n_removed", "n_spans", "kept")
BASE = 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1
#: Kinds of rows: suffixes or whole segments to compare, repeated runs found, and segments to look at by anchor or by string.
SUFFIXES, SEGMENTS, RUNS, BY_ANCHOR, BY_STRING = range(5)

ROWS = "bucket int, kind int, key long, payload binary"
ROW_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("payload", pa.binary())])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes of all substrings of one length, from running sums of byte codes times powers of a base."""

    def __init__(self, size: int):
        codes = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64)
        self.codes = codes * np.uint64(2) + np.uint64(1)
        self.powers, self.inverse = self._powers(BASE, size + 1), self._powers(pow(BASE, -1, 1 << 64), size + 1)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out, done = np.ones(n, dtype=np.uint64), 1
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        return out

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.codes[data] * self.powers[: len(data)], out=out[1:])
        return out

    def all(self, sums: np.ndarray, k: int) -> np.ndarray:
        n = len(sums) - k
        return (sums[k:] - sums[:n]) * self.inverse[:n]

    def some(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.inverse[start]


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as big-endian numbers; ``data`` has eight bytes to spare."""
    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | data[at + i].astype(np.uint64)
    return out


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k neighbours: of the tail of one block of k and the head of the next."""
    n = len(x)
    blocks = np.append(x, np.full(-n % k, M64, dtype=np.uint64)).reshape(-1, k)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - k + 1], head[k - 1 : n])


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order by several keys: sort by the first, then only the runs of equal ones by the next, and so on."""
    order = np.argsort(columns[0], kind="stable")
    first = columns[0][order]
    new = np.append(True, first[1:] != first[:-1])
    for column in columns[1:]:
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        run = np.cumsum(new)[tied]
        order[tied] = order[tied][np.lexsort((column[order[tied]], run))]
        value = column[order[tied]]
        new[tied] |= np.append(True, (value[1:] != value[:-1]) | (run[1:] != run[:-1]))
    return order


def changes(columns: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


# ---------------------------------------------------------------- tables of suffixes as numpy columns

#: lead: first eight bytes; more: hash of the anchor (or 0); whole: hash of all bytes compared; key, at: where the
#: strings start; n: how many strings.
COLUMNS = (("lead", "<u8"), ("more", "<u4"), ("whole", "<u8"), ("key", "<i8"), ("at", "<u4"), ("n", "u1"))


def packed(table: list[np.ndarray]) -> bytes:
    """Columns by byte planes, compressed; keys as numbers into the list of distinct keys."""
    import zstandard

    keys, which = np.unique(table[3], return_inverse=True)
    parts = [np.array([len(table[0]), len(keys)], "<u8").tobytes()]
    for values, kind in ((keys, "<i8"), (which, "<u4"), *((table[i], COLUMNS[i][1]) for i in (0, 1, 2, 4, 5))):
        plain = np.ascontiguousarray(values.astype(kind))
        parts.append(plain.view(np.uint8).reshape(len(plain), -1).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress(data)
    n, n_keys = np.frombuffer(plain, "<u8", 2).tolist()
    at, out = 16, []
    for rows, kind in ((n_keys, "<i8"), (n, "<u4"), *((n, COLUMNS[i][1]) for i in (0, 1, 2, 4, 5))):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(plain, np.uint8, rows * width, at).reshape(width, rows)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(rows))
        at += rows * width
    keys, which, lead, more, whole, start, count = out
    return [lead, more, whole, keys[which], start, count]


def by_key(table: list[np.ndarray], kind: int, bucket: int) -> Iterator[tuple]:
    """(bucket, kind, key, payload) rows: the starts and numbers of strings of each document."""
    if not len(table[0]):
        return
    order = np.lexsort((table[4], table[3]))
    lead, more, _, key, at, n = pick(table, order)
    first = np.flatnonzero(changes([key]))
    for a, b in zip(first.tolist(), np.append(first[1:], len(key)).tolist()):
        payload = at[a:b].astype("<u4").tobytes() + n[a:b].astype("u1").tobytes()
        if kind != RUNS:
            payload += lead[a:b].astype("<u8").tobytes() + more[a:b].astype("<u4").tobytes()
        yield bucket, kind, int(key[a]), payload


def runs_of(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(payload) // 5
    return np.frombuffer(payload, "<u4", n), np.frombuffer(payload, "u1", n, 4 * n)


def requests_of(payload: bytes) -> tuple[np.ndarray, ...]:
    """(starts, numbers of strings, leading bytes and hashes of the anchors)."""
    n = len(payload) // 17
    return np.frombuffer(payload, "<u4", n), np.frombuffer(payload, "u1", n, 4 * n), np.frombuffer(payload, "<u8", n, 5 * n), np.frombuffer(payload, "<u4", n, 13 * n)


class Splitters:
    """Boundaries of the buckets: (leading bytes, hash of the anchor and of the segment), ascending."""

    def __init__(self, cuts: list[tuple[int, int]]):
        self.lead = np.array([c[0] for c in cuts], dtype=np.uint64)
        self.rest = np.array([c[1] for c in cuts], dtype=np.uint64)
        self.anchors = {(c[0], c[1] >> 32) for c in cuts}

    def bucket(self, lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.lead, lead, side="left")
        high = np.searchsorted(self.lead, lead, side="right")
        tied = np.flatnonzero(high > low)
        out = low.copy()
        for at in np.unique(low[tied]).tolist():
            own = tied[low[tied] == at]
            out[own] += np.searchsorted(self.rest[at : high[own[0]]], rest[own], side="right")
        return out


def rest_of(more: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return (more.astype(np.uint64) << np.uint64(32)) | (whole >> np.uint64(32))


def pick(table: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
    return [c[rows] for c in table]


def joined(tables: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*tables)] if tables else [np.empty(0, kind) for _, kind in COLUMNS]


def ordered(table: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted, and each place once (rows equal in id and text are one document)."""
    table = pick(table, multikey_order(table[:5]))
    return pick(table, changes(table[:5]))


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + 64
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ROW_SCHEMA)], schema=ROW_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ROW_SCHEMA)], schema=ROW_SCHEMA)


class Folder:
    """Holds a task's suffixes; folds equal ones and deals the rest to the buckets."""

    def __init__(self, splitters: Splitters):
        self.splitters, self.tables, self.rows = splitters, [], 0

    def add(self, table: list[np.ndarray]) -> Iterator[tuple]:
        self.tables.append(table)
        self.rows += len(table[0])
        if self.rows >= FOLD_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        table = ordered(joined(self.tables))
        self.tables, self.rows = [], 0
        first = changes(table[:3])
        yield from by_key(pick(table, ~first), RUNS, -1)
        table = pick(table, first)
        bucket = self.splitters.bucket(table[0], rest_of(table[1], table[2]))
        edges = np.append(np.flatnonzero(changes([bucket])), len(bucket)).tolist()
        for a, b in zip(edges[:-1], edges[1:]):
            yield int(bucket[a]), SUFFIXES, 0, packed(pick(table, slice(a, b)))


def segments(hasher: Hasher, keys: list[int], bases: list[int], texts: list[bytes]) -> list[np.ndarray]:
    """The suffix table of some texts; ``bases``: where each text starts in its document."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    n, end = int(size.sum()), np.cumsum(size)
    if n < LENGTH:
        return joined([])
    data = np.frombuffer(b"".join(texts) + b"\0" * 8, dtype=np.uint8)
    sums = hasher.sums(data[:n])
    grams = mixed(hasher.all(sums, LEAD))
    low = np.uint64((1 << 24) - 1)
    anchor = (sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), LENGTH - LEAD + 1) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), size)[: n - LENGTH + 1]
    p = np.flatnonzero(np.arange(n - LENGTH + 1) + LENGTH <= end[doc])
    a = anchor[p]
    new = np.append(True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1))[: len(p)]
    first = np.flatnonzero(new)
    p0, a0, count = p[first], a[first], np.diff(np.append(first, len(p)))
    whole = mixed(hasher.some(sums, p0, p0 + count + LENGTH - 1) + count.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + (a0 - p0).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    at = p0 - (end - size)[doc[p0]] + np.array(bases, dtype=np.int64)[doc[p0]]
    return [leading(data, a0), (grams[a0] >> np.uint64(32)).astype("<u4"), whole, np.array(keys, dtype=np.int64)[doc[p0]], at.astype("<u4"), count.astype("u1")]


def blocks(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in blocks of about ``BLOCK`` bytes; a longer text in pieces that overlap by a string less a byte."""
    keys, bases, texts, size = [], [], [], 0
    for key, text in rows:
        for base in range(0, max(1, len(text) - LENGTH + 1), BLOCK):
            piece = text[base : base + BLOCK + LENGTH - 1]
            if size + len(piece) > BLOCK + LENGTH and texts:
                yield keys, bases, texts
                keys, bases, texts, size = [], [], [], 0
            keys.append(key)
            bases.append(base)
            texts.append(piece)
            size += len(piece)
    if texts:
        yield keys, bases, texts


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in narrow_batches(batches, "_text"):
        yield from zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())


class Bytes:
    """Holds the bytes of segments and deals them to the buckets of their anchors."""

    def __init__(self, splitters: Splitters):
        self.splitters, self.size = splitters, 0
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.cuts: list[bytes] = []

    def add(self, key: int, text: bytes, at: np.ndarray, n: np.ndarray, lead: np.ndarray, more: np.ndarray) -> Iterator[tuple]:
        self.rows.append((np.full(len(at), key, "<i8"), at, n, lead, more))
        own = [text[a : a + c + LENGTH - 1] for a, c in zip(at.tolist(), n.tolist())]
        self.cuts += own
        self.size += sum(map(len, own))
        if self.size > BYTES_HELD:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        import zstandard

        if not self.rows:
            return
        key, at, n, lead, more = (np.concatenate(c) for c in zip(*self.rows))
        bucket = self.splitters.bucket(lead, more.astype(np.uint64) << np.uint64(32))
        order = np.lexsort((more, lead, bucket))  # like segments side by side, for the compression
        edges = np.append(np.flatnonzero(changes([bucket[order]])), len(order)).tolist()
        for a, b in zip(edges[:-1], edges[1:]):
            own = order[a:b]
            plain = np.array([len(own)], "<u8").tobytes() + key[own].tobytes() + at[own].tobytes() + n[own].tobytes() + b"".join([self.cuts[i] for i in own.tolist()])
            yield int(bucket[own[0]]), SEGMENTS, 0, zstandard.ZstdCompressor(level=3).compress(plain)
        self.rows, self.cuts, self.size = [], [], 0


def strings_of(hasher: Hasher, payload: bytes) -> list[np.ndarray]:
    """The suffix table of the single strings of packed segments."""
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress(payload)
    (m,) = np.frombuffer(plain, "<u8", 1).tolist()
    key, at, n = np.frombuffer(plain, "<i8", m, 8), np.frombuffer(plain, "<u4", m, 8 + 8 * m), np.frombuffer(plain, "u1", m, 8 + 12 * m)
    tables, place = [], 8 + 13 * m
    for i in range(0, m, AT_ONCE):
        own = slice(i, i + AT_ONCE)
        size = int(n[own].astype(np.int64).sum()) + len(n[own]) * (LENGTH - 1)
        tables.append(strings(hasher, plain[place : place + size], key[own], at[own], n[own]))
        place += size
    return joined(tables)


def _find_segments(cuts: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, folder = Hasher(BLOCK + 2 * LENGTH), Folder(Splitters(cuts))

        def rows() -> Iterator[tuple]:
            for block in blocks(_texts(batches)):
                yield from folder.add(segments(hasher, *block))
            yield from folder.flush()

        yield from _batches(rows())

    return run


def strings(hasher: Hasher, text: bytes, key: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The suffix table of single strings; ``text``: the bytes of the segments side by side."""
    n = n.astype(np.int64)
    size = n + LENGTH - 1
    data = np.frombuffer(text + b"\0" * 8, dtype=np.uint8)
    sums = hasher.sums(data[:-8])
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    p = np.repeat(np.cumsum(size) - size, n) + inside
    whole = mixed(hasher.some(sums, p, p + LENGTH))
    return [leading(data, p), (whole >> np.uint64(32)).astype("<u4"), whole, np.repeat(key, n), (np.repeat(at.astype(np.int64), n) + inside).astype("<u4"), np.ones(len(p), "u1")]


def _look_closer(cuts: list[tuple[int, int]]):
    """Send the asked segments of each document: their bytes, or their single strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, splitters = Hasher(AT_ONCE * (2 * LENGTH + 56)), Splitters(cuts)
        folder, held = Folder(splitters), Bytes(splitters)

        def rows() -> Iterator[tuple]:
            for batch in narrow_batches(batches, "_text"):
                for key, text, by_anchor, by_string in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), *(batch.column(i).to_pylist() for i in (2, 3))):
                    for payload in by_anchor:
                        yield from held.add(key, text, *requests_of(payload))
                    for payload in by_string:
                        at, n, _, _ = requests_of(payload)
                        for i in range(0, len(at), AT_ONCE):
                            own = slice(i, i + AT_ONCE)
                            cut = b"".join([text[a : a + c + LENGTH - 1] for a, c in zip(at[own].tolist(), n[own].tolist())])
                            yield from folder.add(strings(hasher, cut, np.full(len(at[own]), key, "<i8"), at[own], n[own]))
            yield from held.flush()
            yield from folder.flush()

        yield from _batches(rows())

    return run


def _compare(cuts: list[tuple[int, int]], deeper: bool):
    """Sort each bucket and compare neighbours. Equal ones but the first are runs; with ``deeper`` the first
    ones of segments whose anchor has several kinds, here or beyond a boundary, are asked for."""

    def settle(bucket: int, tables: list, splitters: Splitters) -> Iterator[tuple]:
        table = ordered(joined(tables))
        first = changes(table[:3])
        yield from by_key(pick(table, ~first), RUNS, bucket)
        if deeper and len(table[0]):
            table = pick(table, first)
            group = np.cumsum(changes(table[:2])) - 1
            cut = np.zeros(len(group), bool)
            for at in (0, -1):  # only the first and the last anchor can go on beyond a boundary
                if (int(table[0][at]), int(table[1][at])) in splitters.anchors:
                    cut |= group == group[at]
            yield from by_key(pick(table, cut), BY_STRING, bucket)
            yield from by_key(pick(table, ~cut & (np.bincount(group)[group] > 1)), BY_ANCHOR, bucket)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, tables = None, []
        hasher, splitters = Hasher(AT_ONCE * (2 * LENGTH + 56)), Splitters(cuts)
        for batch in batches:
            for bucket, kind, key, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == RUNS:
                    yield bucket, kind, key, payload
                    continue
                if bucket != now:
                    if tables:
                        yield from settle(now, tables, splitters)
                    now, tables = bucket, []
                tables.append(unpacked(payload) if kind == SUFFIXES else strings_of(hasher, payload))
        if tables:
            yield from settle(now, tables, splitters)

    return lambda batches: _batches(rows(batches))


def _sample_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(BLOCK + 2 * LENGTH)
    for block in blocks(_texts(batches)):
        table = segments(hasher, *block)
        key, rest = table[3], rest_of(table[1], table[2])
        order = np.random.default_rng(len(key)).permutation(len(key))
        order = order[np.lexsort((np.arange(len(key)), key[order]))]  # at random within each document
        first = np.flatnonzero(changes([key[order]]))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        own = order[rank < SAMPLE_SUFFIXES]
        yield pa.RecordBatch.from_arrays([pa.array(table[0][own].view(np.int64)), pa.array(rest[own].view(np.int64))], names=["lead", "rest"])


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Only characters all of whose bytes are gone."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(starts) or starts[0]:
        return gone
    return np.repeat(np.logical_and.reduceat(gone, starts), np.diff(np.append(starts, len(data))))


def _cut(names: list[str], schema: pa.Schema, characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in narrow_batches(batches, "_text"):
            sizes, removed, spans, kept = [], [], [], []
            for text, payloads in zip(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("_runs").to_pylist()):
                data, gone = np.frombuffer(text, np.uint8), np.zeros(0, bool)
                if payloads:
                    at, n = (np.concatenate(c) for c in zip(*map(runs_of, payloads)))
                    step = np.bincount(at, minlength=len(data) + 1) - np.bincount(at.astype(np.int64) + n + LENGTH - 1, minlength=len(data) + 1)
                    gone = np.cumsum(step[:-1]) > 0
                    gone = whole_characters(data, gone) if characters else gone
                sizes.append(len(data))
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()) if len(gone) else 0)
                kept.append(data[~gone].tobytes() if payloads else text)
            added = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
            own = [batch.column(n).cast(schema.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*own, *added], schema=schema)

    return run


# ---------------------------------------------------------------- operator


def keyed(docs: DataFrame, id_col: str) -> DataFrame:
    """With ``_key``, a long in the order of the documents: the id itself where ids are unique."""
    rows = docs.agg(F.count(F.lit(1)), F.count_distinct(id_col)).head()
    if rows[0] == rows[1]:
        return docs.withColumn("_key", F.col(id_col).cast("long"))
    named = docs.withColumn("_tie", F.xxhash64("_text"))
    keys = named.select(F.col(id_col).alias("_id"), F.col("_tie").alias("_t")).distinct()
    keys = keys.repartitionByRange(partitions(docs.sparkSession), F.col("_id").asc_nulls_last(), "_t").sortWithinPartitions(F.col("_id").asc_nulls_last(), "_t")
    keys = reliable(keys.withColumn("_key", F.monotonically_increasing_id()))
    return named.join(keys, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_t"))).drop("_tie", "_id", "_t")


def sampled_cuts(rows: DataFrame, n: int) -> list[tuple[int, int]]:
    """n - 1 boundaries that cut the suffixes of a bounded sample of documents into equal shares."""
    count = max(1, rows.count())
    sample = rows.sample(fraction=min(1.0, SAMPLE_DOCS / count), seed=5)
    found = sorted((r.lead & M64, r.rest & M64) for r in sample.mapInArrow(_sample_suffixes, "lead long, rest long").collect())
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", characters: bool = False) -> DataFrame:
    """The input's columns but the text, and ``ADDED``: ``kept`` holds the bytes that stay. With
    ``characters`` a character that is cut only in part stays, so that ``kept`` is UTF-8."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    names = [c for c in docs.columns if c not in (*ADDED, text_col)]
    docs = keyed(docs.select(*names, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")), id_col)
    texts = docs.select("_key", "_text")
    cuts = sampled_cuts(texts, BUCKETS_PER_TASK * n)

    def compared(found: DataFrame, deeper: bool) -> DataFrame:
        place = F.when(F.col("bucket") < 0, F.xxhash64("key")).otherwise(F.col("bucket").cast("long"))
        return reliable(found.repartition(n, place).sortWithinPartitions("bucket").mapInArrow(_compare(cuts, deeper), ROWS))

    first = compared(texts.mapInArrow(_find_segments(cuts), ROWS), True)
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("payload")))
    asked = first.where(F.col("kind") != RUNS).groupBy("key").agg(of(BY_ANCHOR).alias("_by_anchor"), of(BY_STRING).alias("_by_string"))
    near = texts.join(asked, F.col("_key") == F.col("key")).select("_key", "_text", "_by_anchor", "_by_string")
    second = compared(near.mapInArrow(_look_closer(cuts), ROWS), False)
    runs = first.where(F.col("kind") == RUNS).unionByName(second).groupBy("key").agg(F.collect_list("payload").alias("_runs"))
    whole = docs.join(runs, F.col("_key") == F.col("key"), "left").select(*names, "_text", "_runs")

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    kinds = StructType([*(whole.schema[c] for c in names), *(StructField(c, LongType()) for c in ADDED[:3]), StructField("kept", BinaryType())])
    return whole.mapInArrow(_cut(names, to_arrow_schema(kinds), characters), kinds)
