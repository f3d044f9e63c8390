import math
import random

import numpy as np
from pyspark.sql import functions as F

from threadwise.llm import voronoi_join as v

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, every=1, k=20, scale=64):
    """(query, rank, id, score); a row counts once."""
    odd = lambda x: x is None or not math.isfinite(x)
    vecs = sorted({(i, tuple(math.floor(scale * x) for x in e)) for i, e in rows if e is not None and not any(map(odd, e))}, key=lambda r: (r[0] is None, r))
    for q, own in vecs:
        if q is not None and q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(own, e)), i is None, i) for i, e in vecs if (i, e) != (q, own))
            yield from ((q, n + 1, i, -s) for n, (s, _, i) in enumerate(best[:k]))


def run(spark, rows, every=1, k=20):
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], ROWS).withColumn("vec", v.whole(F.col("embedding"), 64))
    got = v.top_k(df.where(F.col("vec_id") % every == 0), df, k)
    return sorted(map(tuple, got.collect()), key=repr)


def unit(rng, dim=8):
    x = np.array([rng.gauss(0, 1) for _ in range(dim)])
    return [float(np.float32(c)) for c in x / np.linalg.norm(x)]


def clusters(rng, n=600, dim=8):
    centres = [unit(rng, dim) for _ in range(12)]
    near = lambda c: [float(np.float32(x + rng.gauss(0, 0.02))) for x in c]
    return [(i, near(rng.choice(centres))) for i in range(n)]


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, unit(rng, 3)) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000, rows[7][1]), (2000, rows[7][1]), (2000, rows[8][1])]
    rows += [(None, rows[9][1]), (None, None), (3000, None), (3005, [1.0, None, 0.0]), (3010, [math.nan, 0.0, 0.0]), (3015, [math.inf, 0.0, 0.0])]
    rows += [(4000, [0.5, -0.5]), (4005, []), (4010, [-0.0, 0.0, 0.0])]
    assert run(spark, rows, 5) == sorted(brute(rows, 5), key=repr)


def test_groups_parts_and_bounds(spark, monkeypatch):
    monkeypatch.setattr(v, "GROUP_ROWS", 30)
    monkeypatch.setattr(v, "PART_ROWS", 40)
    monkeypatch.setattr(v, "BLOCK", 16)
    rows = clusters(random.Random(5))
    assert run(spark, rows, 2, 3) == sorted(brute(rows, 2, 3), key=repr)


def test_bounds_leave_out_cells_and_rows():
    rng = random.Random(6)
    rows = np.array([[math.floor(64 * x) for x in e] for _, e in clusters(rng)], dtype=np.int64)
    pivots = rows[::40]
    cell, far = v.nearest(rows, pivots)
    of = lambda f: np.array([f(far[cell == c]) if (cell == c).any() else -1.0 for c in range(len(pivots))])
    plan = v.plan(pivots, of(np.max), of(np.max), [np.sort(far[cell == c])[:4] for c in range(len(pivots))], 4)
    assert plan.needs.mean() < 0.6
    score = v.products(rows, rows)
    for i in range(len(rows)):
        best = np.partition(score[i], -4)[-4]
        assert plan.bound[cell[i]] <= best
        assert plan.needs[cell[i], cell[score[i] >= best]].all()


def test_no_queries_no_data_and_fewer_than_k(spark):
    assert run(spark, []) == [] and run(spark, [(1, [0.5]), (2, [0.1])], 5) == []
    assert run(spark, [(5, [0.5]), (2, [0.1])], 5) == [(5, 1, 2, 32 * 6)]


def test_large_numbers_stay_exact(spark):
    df = spark.createDataFrame([(1, [2**31 + 1, 3]), (2, [2**30, 5]), (3, [2**30, 4])], "vec_id long, vec array<long>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in v.top_k(df, df, 2).collect()}
    assert got[1, 1] == (2, (2**31 + 1) * 2**30 + 15) and got[1, 2] == (3, (2**31 + 1) * 2**30 + 12)
