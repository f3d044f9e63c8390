import csv
import random
import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadwise import schemas
from threadwise.operators import sampling as S
from threadwise.operators import threads as T
from threadwise.sources import tables as io


@pytest.fixture(scope="module")
def msgs(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [
        (1, "c1", True, at(1), "my  card was\ncharged", None),
        (2, "brand", False, at(2), "ok", 1),
        (3, "brand", False, at(3), "We can  look into it", 1),
        (4, "brand", False, at(4), "A later reply", 1),
        (5, "other", False, at(5), "not the brand", 1),
        (6, "brand", False, at(6), "no parent at all", None),
        (7, "brand", False, at(7), "unknown parent", 99),
        (8, "brand", False, at(8), "parent is outbound", 5),
        (9, "c2", True, at(9), "hey", None),
        (10, "brand", False, at(10), "parent too short", 9),
        (11, "c3", True, at(11), "first of a repeated id", None),
        (11, "c3", True, at(12), "second of a repeated id", None),
        (12, "brand", False, at(13), "answer to the repeated id", 11),
        (13, "c4", True, at(14), None, None),
        (14, "brand", False, at(15), "parent has no text", 13),
    ]
    return spark.createDataFrame(rows, schemas.MESSAGES)


def test_pairs(msgs):
    got = {r.pair_id: (r.customer_msg, r.brand_reply) for r in T.reconstruct_pairs(msgs, "brand").collect()}
    assert got == {
        "uc_1": ("my card was charged", "We can look into it"),
        "uc_11": ("first of a repeated id", "answer to the repeated id"),
    }


def test_pairs_step_by_step_agree(msgs):
    steps = T.first_reply(T.filter_pairs(T.reply_parent_join(msgs, "brand")), ["_reply_created_at", "_reply_text"])
    whole = T.reconstruct_pairs(msgs, "brand")
    pick = lambda d: sorted(map(tuple, d.select("customer_tweet_id", "customer_msg", "brand_reply").collect()))
    assert pick(steps) == pick(whole)


def test_first_reply_limits_before_the_shuffle(msgs):
    plan = T.reconstruct_pairs(msgs, "brand")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "CartesianProduct" not in plan and "Python" not in plan


def test_mentions_and_volume(msgs):
    assert [r.tweet_id for r in T.mentions(msgs, ["CARD", "zzz"]).collect()] == [1]
    assert [tuple(r) for r in T.volume_by_author(msgs, 1).collect()] == [("brand", 9)]


def test_turn_pairs_skip_other_roles(spark):
    rows = [(1, 0, "user", "q one"), (1, 1, "system", "s"), (1, 2, "assistant", "a"), (2, 0, "user", "q two"), (2, 1, "assistant", "b")]
    got = T.pair_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.pair_id, r.brand_reply) for r in got] == [("uc_2_0", "b")]


def test_hash_rank_is_exact_and_partition_free(spark):
    df = spark.range(5000)
    ranked = {r.id: r.rank for r in S.hash_rank(df, "id", 9).collect()}
    assert sorted(ranked.values()) == list(range(5000))
    again = {r.id: r.rank for r in S.hash_rank(df.repartition(7), "id", 9, upto=100).collect()}
    assert again == {k: v for k, v in ranked.items() if v < 100}


def test_split_is_disjoint_and_sized(spark):
    rows = S.disjoint_split(spark.range(300), "id", {"pool": 50, "corpus": 100}).collect()
    assert len({r.id for r in rows}) == 150
    assert sum(r.split == "pool" for r in rows) == 50


def test_stratified_split_keeps_shares_and_skips_unknown(spark):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") < 700, "a").when(F.col("id") < 999, "b").otherwise("z"))
    got = {(r.y, r.split): r["count"] for r in S.stratified_split(df, "id", "y", ("a", "b"), 0.15).groupBy("y", "split").count().collect()}
    assert got == {("a", "val"): 105, ("a", "train"): 595, ("b", "val"): 45, ("b", "train"): 254}


def test_small_class_may_get_no_validation_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, y string")
    got = S.stratified_split(df, "id", "y", ("a", "b"), 0.15).collect()
    assert len(got) == 3 and {r.split for r in got} == {"train"}


def test_class_weights_fill_missing(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "y string")
    got = {r.y: r.weight for r in S.class_weights(df, "y", ["a", "b", "c"]).collect()}
    assert got == {"a": 0.5, "b": 1.0, "c": 1.0}


def test_leakage(spark):
    a, b = spark.range(10).withColumnRenamed("id", "k"), spark.range(8, 20).withColumnRenamed("id", "k")
    assert tuple(S.leakage(a, b, "k").first()) == (2, 8, False)
    assert S.without_leakage(a, b, "k").count() == 8


def test_upsert_takes_the_newest(spark):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 5, "keep")], "k string, updated_at long, v string")
    new = spark.createDataFrame([("a", 2, "new"), ("b", 4, "stale"), ("c", 1, "add")], base.schema)
    got = {r.k: r.v for r in io.upsert_latest(new, base, "k").collect()}
    assert got == {"a": "new", "b": "keep", "c": "add"}


def test_csv_log_and_missing_path(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        "tweet_id,author_id,inbound,created_at,text,in_response_to_tweet_id\n"
        '1,c1,True,Tue Oct 31 22:10:47 +0000 2017,"two\nlines, ""quoted""",\n'
        "2,brand,False,Tue Oct 31 22:11:47 +0000 2017,hi there,1\n"
    )
    rows = io.read_messages(spark, str(path)).orderBy("tweet_id").collect()
    assert rows[0].text == 'two\nlines, "quoted"' and rows[0].in_response_to_tweet_id is None
    assert rows[1].in_response_to_tweet_id == 1 and rows[0].created_at.year == 2017
    with pytest.raises(Exception):
        io.read_messages(spark, str(tmp_path / "none.csv")).count()


def test_json_documents_skip_corrupt(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.json").write_text(
        '{\n"conversation_id": "a", "status": "RESOLVED", "resolution": null,\n"messages": [{"message_id": "m1", "role": "customer", "text": "hi"}],'
        '"feedback": {"m1": {"feedback": "helpful", "ts": "t"}}}'
    )
    (folder / "b.json").write_text('{"conversation_id": "b", "messa')
    (folder / "c.tmp").write_text("{}")
    docs = io.read_conversations(spark, str(folder))
    assert [r.conversation_id for r in docs.collect()] == ["a"]
    assert [(r.turn, r.text) for r in io.conversation_messages(docs).collect()] == [(0, "hi")]
    assert [r.feedback for r in io.conversation_feedback(docs).collect()] == ["helpful"]


def test_log_absent_blank_and_append(spark, tmp_path):
    path = str(tmp_path / "log")
    assert io.read_log(spark, path, "a long").count() == 0
    io.append_log(spark.range(2).withColumnRenamed("id", "a"), path)
    (tmp_path / "log" / "part-x.json").write_text('\n{"a": 7}\n\n')
    assert sorted(r.a for r in io.read_log(spark, path, "a long").collect()) == [0, 1, 7]


def test_quoted_csv_is_read_by_several_tasks_as_by_one(spark, tmp_path):
    rng = random.Random(3)
    bits = ["plain", "a, b", 'say "hi"', "two\nlines", "\n\n", "", '"', "three\nmore\nlines, really", "x" * 60]
    want = []
    for n in range(3):
        with open(tmp_path / f"{n}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(["author_id", "text", "tweet_id"])
            for i in range(80):
                row = (f"u{i}", rng.choice(bits) + rng.choice(bits) + ".", 100 * n + i)
                want.append((row[2], row[0], row[1]))
                w.writerow(row)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 9
        got = io.read_quoted_csv(spark, str(tmp_path), "tweet_id BIGINT, author_id STRING, text STRING").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_parent_with_a_third_of_the_replies_is_dealt_over_parts(spark):
    rows = [(i, "c", True, i, f"question {i}", None) for i in range(20)]
    rows += [(100 + i, "b", False, 100 + i, f"answer {i}", 3 if i % 3 == 0 else i % 20) for i in range(300)]
    kind = "tweet_id long, author_id string, inbound boolean, created_at long, text string, in_response_to_tweet_id long"
    msgs = spark.createDataFrame(rows, kind)
    whole, cut = T.reply_parent_join(msgs, "b"), T.reply_parent_join(msgs, "b", hot_replies=10)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect())) and whole.count() == 300
    replies = msgs.where("author_id = 'b'").select(F.col("in_response_to_tweet_id").alias("k"), F.col("tweet_id").alias("u"))
    dealt, copied = T._dealt(replies, replies.select("k").distinct(), "k", "u", 10)
    assert dealt.groupBy("k", "_part").count().agg(F.max("count")).first()[0] < 30
    assert copied.groupBy("k", "_part").count().agg(F.max("count")).first()[0] == 1
