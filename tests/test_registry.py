import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck
from threadwise.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(QUERIES) <= set(queries)
    assert set(QUERIES) - set(SQL) == {"e11_learned_classifier", "f4_topk_lsa", "f5_topk_hybrid", "i2_conflicts", "i2_conflicts_in_batch"}


@needs_data
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["intent", "decision", "n_messages", "mean_confidence"]
    assert df.count() > 0


@needs_data
@pytest.mark.parametrize(
    "name", ["b5_pair_id", "c5_stratified_split", "e14_is_repeat", "h3_apply_feedback", "i1_ingest_resolutions", "j2_replay_log", "l2_stream_states"]
)
def test_query_equals_its_sql(spark, name):
    ok, note = compare(spark, duck(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note


@needs_data
def test_stream_equals_batch_states(spark):
    q = entry.queries()
    rows = lambda n: sorted(map(tuple, q[n](spark, SF).collect()))
    assert rows("l2_stream_states") == rows("j1_replay_states")


@needs_data
def test_learned_classifier_learns_its_weak_labels(spark):
    rows = entry.queries()["e11_learned_classifier"](spark, SF).collect()
    common = max(sum(r.label == t for r in rows) for t in {r.label for r in rows})
    assert sum(r.label == r.prediction for r in rows) > common
