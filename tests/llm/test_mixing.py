import random

import pytest

from tests.llm import brute
from threadwise.llm import mixing as m


def water(sizes: dict) -> dict:
    """Targets by repeated resharing of the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            free.remove(s)


def made(rng, n=300):
    names = ["a", "b", "B", "é", None, "z", "zz"]
    return [(i, " ".join(["w"] * rng.randint(0, 90)), "en", names[min(6, int(rng.expovariate(0.6)))], 1) for i in range(n)]


def test_targets_and_taken(spark, monkeypatch):
    rows = made(random.Random(8))
    df = spark.createDataFrame(rows, brute.DOCS)
    got = m.mix(df, block=16, rows_per_bucket=20).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    want = water(sizes)
    assert len(got) == len(rows)
    taken: dict = {}
    for r in got:
        assert r.size == len(r.text.split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    again = m.mix(df.repartition(7), block=16, rows_per_bucket=1000).collect()
    assert sorted((r.doc_id, r.taken, r.first_slot) for r in got) == sorted((r.doc_id, r.taken, r.first_slot) for r in again)


def test_schedule_is_even(spark):
    """Every stretch of the schedule holds each source close to its share."""
    sizes = spark.createDataFrame([("sa", 40_000), ("sb", 30_000), ("sc", 30_000)], "_src string, source_size long")
    goals = m.targets(sizes)
    share = {r._src: r.goal for r in goals.collect()}
    slots = [r._src for r in m.schedule(goals, 100).orderBy("slot").collect()]
    total = sum(share.values())
    for s, goal in share.items():
        assert abs(slots.count(s) - goal / 100) <= 1
        for at in range(0, len(slots) - 100, 50):
            assert abs(slots[at : at + 100].count(s) - 100 * goal / total) <= 6
    ranks = {}
    for r in m.schedule(goals, 100).collect():
        ranks.setdefault(r._src, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())


def test_odd_rows(spark):
    got = m.mix(spark.createDataFrame(brute.ODD, brute.DOCS)).collect()
    assert len(got) == len(brute.ODD)
    assert all(r.taken == 0 for r in got if not (r.text or "").split())
    assert m.mix(spark.createDataFrame([], brute.DOCS)).collect() == []
    assert all(r.target == 0 for r in m.mix(spark.createDataFrame(brute.ODD[:3], brute.DOCS)).collect())
    clash = spark.createDataFrame([(1, "a b", "s", "old")], "doc_id long, text string, source string, taken string")
    (r,) = m.mix(clash).collect()
    assert r.taken == 3 and r.size == 2
