"""Operator 13: exact top-k by inner product, as a Voronoi join.

Vectors of whole numbers are grouped by their nearest pivot, queries and data alike; pivots are up to ``MAX_PIVOTS``
data vectors. Let p be the pivot of a query group of radius r. For every query q of the group and any x
in the cell of pivot s, at distance f from s, the product q.x lies within

    p.s +- (r |s| + (|p| + r) f)

and, when x itself is looked at, within p.x +- r |x|. The summary of a cell (rows, greatest distance, the k + 1
least distances) gives each group a score that k + 1 rows reach whatever the query: its bound. A cell whose
greatest distance cannot reach the bound is not sent to the group, nor is a row that cannot. What is sent meets
the group in parts of at most ``PART_ROWS`` rows and ``GROUP_ROWS`` queries, and the best k + 1 per query and
part are merged. All products are of whole numbers, so scores and ties are exact.

Copies fold before anything meets: of rows with one vector only the k + 1 smallest ids can be among the best k of
a query, and queries of one vector are answered once. So a vector that a third of all rows share is one row here.

What the driver holds: the pivots, their cells' summaries and a table of (group, cell), all bounded by ``MAX_PIVOTS``.

Defined cases: a vector that is null or holds a null takes no part; a shorter vector counts as ending in
zeros; rows equal in id and vector count once; a null id comes last among ties and asks nothing; without queries or data there is no row; other columns are left out. Scores have to
fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadwise.llm.common import partitions
from threadwise.session import reliable

K = 20
MIN_PIVOTS = 8
MAX_PIVOTS = 256
GROUP_ROWS = 2048
PART_ROWS = 1 << 14
BLOCK = 2048
EXACT = float(1 << 53)
#: The id that a null stands for while ids are compared.
LAST = (1 << 63) - 1


def whole(vector: Column, scale: int) -> Column:
    """Each component times ``scale``, rounded down; null if the vector holds a null, an infinity or no number."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.when(~F.exists(vector, odd), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


# ---------------------------------------------------------------- geometry


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of whole numbers; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(ends)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat[ends[0] : ends[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    inside = np.arange(width) < sizes[:, None]
    out[inside] = flat[ends[0] : ends[-1]]
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (a, b))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b; in floating point only where that is exact."""
    a, b = same_width(a, b)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < EXACT else a @ b.T


def nearest(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest pivot, distance to it, rounded up)."""
    rows, pivots = (m.astype(np.float64) for m in same_width(rows, pivots))
    squares = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * (rows @ pivots.T)
    cell = squares.argmin(axis=1)
    return cell, _up(np.sqrt(((rows - pivots[cell]) ** 2).sum(axis=1)))


def _up(x: np.ndarray) -> np.ndarray:
    """A little more, so that no rounding makes a bound too small."""
    return x * (1 + 1e-9) + 1e-9


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))


@dataclass(frozen=True)
class Plan:
    """What tasks need to know of the groups: bounded by the number of pivots."""

    pivots: np.ndarray
    radius: np.ndarray  # of each group; negative where it has no query
    bound: np.ndarray  # score that the best k + 1 of each query of the group reach
    needs: np.ndarray  # (group, cell): whether the cell can hold a row that a query of the group needs


def plan(pivots: np.ndarray, radius: np.ndarray, farthest: np.ndarray, least: list[np.ndarray], want: int) -> Plan:
    """Bounds from the summaries of cells: ``farthest`` distance (negative: no row) and ``least`` distances."""
    among, size = products(pivots, pivots).astype(np.float64), _up(_norms(pivots))
    groups = np.flatnonzero(radius >= 0)
    bound, needs = np.full(len(pivots), -np.inf), np.zeros((len(pivots), len(pivots)), dtype=bool)
    for g in groups:
        slack = lambda f, c: radius[g] * size[c] + (size[g] + radius[g]) * f
        low = np.concatenate([among[g, c] - _up(slack(least[c], c)) for c in range(len(pivots))])
        if len(low) >= want:
            bound[g] = np.partition(low, -want)[-want]
        for c in np.flatnonzero(farthest >= 0):
            needs[g, c] = among[g, c] + _up(slack(farthest[c], c)) >= bound[g]
    return Plan(pivots, radius, bound, needs)


# ---------------------------------------------------------------- tasks

KEYED = "k1 long, k2 long, vec array<long>"


def _assign(pivots: np.ndarray, schema: pa.Schema):
    """Adds the cell and the distance to its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, far = nearest(matrix(batch.column("vec")), pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], schema=schema)

    return run


def _send(plan: Plan, schema: pa.Schema):
    """Each row once for every group that can need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = np.flatnonzero(plan.radius >= 0)
        for batch in batches:
            if not batch.num_rows or not len(groups):
                continue
            rows = matrix(batch.column("vec"))
            cell = batch.column("cell").to_numpy()
            high = products(rows, plan.pivots[groups]) + _up(_norms(rows)[:, None] * plan.radius[groups])
            at, which = np.nonzero((high >= plan.bound[groups]) & plan.needs[groups][:, cell].T)
            for k in range(0, len(at), BLOCK):
                sent = batch.take(pa.array(at[k : k + BLOCK]))
                group = pa.array(groups[which[k : k + BLOCK]].astype(np.int32))
                yield pa.RecordBatch.from_arrays([group, sent.column("cell"), sent.column("salt"), sent.column("vec"), sent.column("ids")], schema=schema)

    return run


def best_of(queries: np.ndarray, rows: np.ndarray, ids: list[list[int]], want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, id) of the ``want`` best ids of each query: greatest score, then smallest id."""
    counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    starts = np.concatenate([[0], np.cumsum(counts)])
    flat = np.fromiter((i for own in ids for i in own), dtype=np.int64, count=int(starts[-1]))
    reached = np.full(len(queries), np.iinfo(np.int64).min)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(0, len(rows), BLOCK):
        score = products(queries, rows[k : k + BLOCK])
        if score.shape[1] >= want:
            reached = np.maximum(reached, np.partition(score, -want, axis=1)[:, -want])
        q, r = np.nonzero(score >= reached[:, None])
        n = counts[k + r]
        at = np.repeat(starts[k + r], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        held.append((np.repeat(q, n), np.repeat(score[q, r], n), flat[at]))
        if len(held) > 1:
            held = [_rank(held, want)]
    return _rank(held, want)


def _rank(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, score, ident = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((ident, -score, q))
    q, score, ident = q[order], score[order], ident[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < want
    return q[keep], score[keep], ident[keep]


def _solve(want: int):
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])

    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        q, score, ident = best_of(matrix(queries["vec"]), matrix(rows["vec"]), rows["ids"].to_pylist(), want)
        keys = [queries[c].to_numpy()[q] for c in ("k1", "k2")]
        return pa.table([pa.array(c) for c in (*keys, score, ident)], schema=schema)

    return run


# ---------------------------------------------------------------- the join


def _keyed(rows: DataFrame) -> DataFrame:
    """A 128-bit key of the vector."""
    return rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), F.reverse("vec"))})


def top_k(queries: DataFrame, data: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    """``queries`` and ``data``: an id and an array of whole numbers. Returns query_id, rank, vec_id, score: the k
    best rows of other ids for each query, greatest score first, ties by smaller id; all if there are fewer."""
    spark, want = queries.sparkSession, k + 1
    clean = lambda df: _keyed(
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<long>").alias("vec"))
        .where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))
    )
    data = clean(data).withColumn("vec_id", F.coalesce("vec_id", F.lit(LAST))).dropDuplicates(["k1", "k2", "vec_id"])
    few = data.withColumn("_n", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(F.col("_n") <= want)
    folded = reliable(few.groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = reliable(clean(queries).where("vec_id IS NOT NULL").dropDuplicates(["k1", "k2", "vec_id"]))
    questions = reliable(asked.groupBy("k1", "k2").agg(F.first("vec").alias("vec")))
    n_questions, n_rows = questions.count(), folded.count()
    n_pivots = min(MAX_PIVOTS, max(MIN_PIVOTS, n_questions // GROUP_ROWS))
    seeds = [r.vec for r in folded.orderBy("k1", "k2").limit(n_pivots).collect()]
    if not seeds or not n_questions:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = np.zeros((len(seeds), max(map(len, seeds))), dtype=np.int64)
    for row, seed in zip(pivots, seeds):
        row[: len(seed)] = seed

    marked = _marked(questions, pivots, "k1 long, k2 long, vec array<long>")
    placed = _marked(folded, pivots, "k1 long, k2 long, vec array<long>, ids array<long>")
    asks = {r.cell: r for r in marked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    near = placed.withColumn("_n", F.row_number().over(Window.partitionBy("cell").orderBy("far"))).where(F.col("_n") <= want)
    least = {r.cell: np.array(r.far) for r in near.groupBy("cell").agg(F.collect_list("far").alias("far")).collect()}
    held = {r.cell: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    cells = range(len(pivots))
    of = lambda found: np.array([found[c].far if c in found else -1.0 for c in cells])
    joined = plan(pivots, of(asks), of(held), [least.get(c, np.zeros(0)) for c in cells], want)

    # Parts of a cell and of a group: bounded rows meet bounded queries.
    parts = {c: -(-held[c].n // PART_ROWS) for c in held}
    shares = {g: -(-asks[g].n // GROUP_ROWS) for g in asks}
    salt = lambda n: F.pmod(F.xxhash64("k1", "k2"), F.get(F.array(*[F.lit(n.get(c, 1)) for c in cells]), "cell")).cast("int")
    schema = pa.schema([("group", pa.int32()), ("cell", pa.int32()), ("salt", pa.int32()), ("vec", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])
    sent = placed.withColumn("salt", salt(parts)).mapInArrow(_send(joined, schema), "group int, cell int, salt int, vec array<long>, ids array<long>")
    share = F.explode(F.sequence(F.lit(0), F.get(F.array(*[F.lit(shares.get(g, 1)) for g in cells]), "group") - 1))
    sent = sent.withColumn("share", share)
    meets = spark.createDataFrame([(int(g), int(c), s) for g in asks for c in np.flatnonzero(joined.needs[g]) for s in range(parts[c])], "group int, cell int, salt int")
    mine = marked.withColumn("share", salt(shares)).withColumnRenamed("cell", "group").join(F.broadcast(meets), "group")
    keys = ["group", "share", "cell", "salt"]
    tasks = max(partitions(spark), 1)
    best = mine.repartition(tasks, *keys).groupBy(*keys).cogroup(sent.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(_solve(want), "k1 long, k2 long, score long, vec_id long")
    order = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    best = reliable(best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= want).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("best")))
    # A query's own row: the first of its id whose score is the vector's product with itself.
    square = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("square")
    rows = asked.select(F.col("vec_id").alias("query_id"), square, "k1", "k2").join(best, ["k1", "k2"])
    rows = rows.withColumn("_own", F.expr("array_position(transform(best, x -> x.vec_id = query_id AND x.score = square), true)"))
    others = F.expr("filter(best, (x, i) -> i + 1 <> _own)")
    rows = rows.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("_at", "x"))
    return rows.select("query_id", (F.col("_at") + 1).alias("rank"), F.nullif("x.vec_id", F.lit(LAST)).alias("vec_id"), F.col("x.score").alias("score"))


def _marked(rows: DataFrame, pivots: np.ndarray, columns: str) -> DataFrame:
    fields = [("k1", pa.int64()), ("k2", pa.int64()), ("vec", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))]
    schema = pa.schema([*fields[: len(rows.columns)], ("cell", pa.int32()), ("far", pa.float64())])
    return reliable(rows.mapInArrow(_assign(pivots, schema), f"{columns}, cell int, far double"))
