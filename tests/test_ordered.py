import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadwise.operators import ordered as O


def hot_rows(spark, n=900):
    rng = random.Random(7)
    rows, turns = [], {}
    for _ in range(n):
        key = 1 if rng.random() < 0.5 else rng.randrange(2, 12)
        turns[key] = turns.get(key, -1) + rng.choice([1, 1, 2])
        rows.append((key, turns[key], rng.choice("ab"), rng.randrange(5)))
    return spark.createDataFrame(rows, "k long, t long, v string, x long").repartition(5)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_neighbours_equal_plain_windows(spark):
    df = hot_rows(spark)
    w = Window.partitionBy("k").orderBy("t")
    for step, fn in ((-1, F.lag), (1, F.lead)):
        got = O.with_neighbour(df, ["k"], ["t"], O.int_chunk("t", 16), ["v", "x"], "n", step)
        want = df.withColumn("n", fn(F.struct("v", "x")).over(w))
        same(got.select("k", "t", "n"), want.select("k", "t", "n"))


def test_running_sums_equal_plain_windows(spark):
    df = hot_rows(spark)
    for inclusive, last in ((True, 0), (False, -1)):
        w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, last)
        got = O.with_running(df, ["k"], ["t"], O.int_chunk("t", 16), {"s": F.col("x") - 2}, inclusive)
        want = df.withColumn("s", F.coalesce(F.sum(F.col("x") - 2).over(w), F.lit(0)))
        same(got.select("k", "t", "s"), want.select("k", "t", "s"))


def test_tails_equal_plain_windows_across_chunks(spark):
    df = hot_rows(spark)
    for n in (1, 3, 40):
        w = Window.partitionBy("k").orderBy("t").rowsBetween(-n, -1)
        got = O.with_tail(df, ["k"], ["t"], O.int_chunk("t", 16), "v", n, "h")
        want = df.withColumn("h", F.collect_list("v").over(w))
        same(got.select("k", "t", "h"), want.select("k", "t", "h"))


def test_only_hot_keys_are_cut_and_by_rows(spark, monkeypatch):
    """One key holds half of the rows within one hour; no chunk has more than the stated rows and a second's."""
    df = hot_rows(spark).withColumn("ts", F.timestamp_seconds(F.col("t")))
    for most in (O.CUT_ROWS, 10):  # cuts broadcast, and joined
        monkeypatch.setattr(O, "CUT_ROWS", most)
        marked, cut = O.hot_time_chunk(df, "k", "ts", hot_rows=60)
        sizes = marked.withColumn("c", cut).groupBy("k", "c").agg(F.count(F.lit(1)).alias("n")).collect()
        assert max(r.n for r in sizes) <= 61
        assert len([r for r in sizes if r.k == 1]) >= 6
        w = Window.partitionBy("k").orderBy("ts")
        got = O.with_neighbour(marked, ["k"], ["ts"], cut, ["v"], "n").select("k", "t", "n")
        same(got, df.withColumn("n", F.lag(F.struct("v")).over(w)).select("k", "t", "n"))
    cold, cut = O.hot_time_chunk(df, "k", "ts", hot_rows=2000)
    assert cold.select(cut.alias("c")).distinct().collect() == [(0,)]


def test_no_window_over_a_whole_key(spark):
    df = hot_rows(spark)
    plan = O.with_running(df, ["k"], ["t"], O.int_chunk("t"), {"s": F.col("x")})._jdf.queryExecution().executedPlan().toString()
    data = [line for line in plan.splitlines() if "Exchange hashpartitioning(k" in line and "_chunk" not in line]
    sums = [line for line in plan.splitlines() if "partial_sum" in line or "HashAggregate" in line]
    assert len(data) <= 1 and sums  # the only exchange on the bare key carries chunk totals
