import random

from pyspark.sql import functions as F

from tests.llm import brute
from threadwise.llm import suffix_dedup as s


def made(rng):
    lex = brute.lexicon(rng)
    base, docs = brute.mixed_text(rng, 700, lex), []
    for i in range(50):
        a = rng.randint(0, 2500)
        text = base[a : a + rng.randint(50, 900)]
        for _ in range(rng.randint(0, 4)):
            p = rng.randrange(len(text))
            text = text[:p] + rng.choice("xyzéß") + text[p + rng.randint(0, 2) :]
        docs.append((i * 3, text + brute.mixed_text(rng, rng.randint(0, 80), lex)))
    return docs + [(1000, "a" * 700), (1001, "ab" * 300), (1002, "a" * 99), (1003, ""), (1004, "a" * 100), (1005, base * 2), (1006, None)]


def result(df, **kw):
    rows = s.remove_repeats(df, **kw).withColumn("sha", F.sha2("kept", 256)).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in rows}, rows


def test_equal_to_brute_force(spark):
    docs = made(random.Random(4))
    got, rows = result(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert len(rows) == len(docs) and got == brute.repeats(docs)


def test_small_blocks_and_folds_change_nothing(spark, monkeypatch):
    docs = made(random.Random(5))
    monkeypatch.setattr(s, "BLOCK", 700)
    monkeypatch.setattr(s, "FOLD_ROWS", 50)
    assert result(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))[0] == brute.repeats(docs)


def test_anchors_cut_by_a_boundary_are_compared_by_string(spark, monkeypatch):
    """Many boundaries among few suffixes: nearly every anchor is cut."""
    docs = made(random.Random(6))
    monkeypatch.setattr(s, "BUCKETS_PER_TASK", 400)
    kinds = []
    plain = s.reliable
    monkeypatch.setattr(s, "reliable", lambda df: kinds.append(plain(df)) or kinds[-1])
    assert result(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))[0] == brute.repeats(docs)
    asked = {r.kind for r in kinds[0].select("kind").distinct().collect()}
    assert s.BY_STRING in asked


def test_multikey_order_is_the_sorted_order():
    import numpy as np

    rng = np.random.default_rng(1)
    columns = [rng.integers(0, k, 5000) for k in (3, 5, 50, 4)]
    order = s.multikey_order(columns)
    assert [tuple(c[i] for c in columns) for i in order] == sorted(zip(*columns))


def test_odd_rows(spark):
    text = "a passage of text that is surely longer than one hundred bytes, so that its second copy goes away as a whole, or not"
    rows = [*brute.ODD, (9, text, "en", "s", 1), (9, text, "en", "s", 1), (10, text, "en", "s", 1), (None, text, "en", "s", 1)]
    _, got = result(spark.createDataFrame(rows, brute.DOCS))
    assert len(got) == len(rows)
    removed = sorted((r.doc_id is None, r.doc_id, r.n_removed) for r in got if r.n_bytes == len(text))
    # Rows equal in id and text are one document and stay; the null id comes last.
    assert removed == [(False, 9, 0), (False, 9, 0), (False, 10, len(text)), (True, None, len(text))]
    (long,) = [r for r in got if r.doc_id == 5]
    assert long.n_removed == 150_000 - 5


def test_whole_characters_leave_utf8(spark):
    text = "é" * 200
    _, got = result(spark.createDataFrame([(1, "x" + text), (2, "y" + text[:150] + "ö" * 80), (3, "z" + text)], "doc_id long, text string"), characters=True)
    for r in got:
        r.kept.decode()
    assert sum(r.n_removed for r in got) > 0


def test_empty_table_and_clashing_names(spark):
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    (r,) = s.remove_repeats(spark.createDataFrame([(1, "abc", 7, "x")], "doc_id long, text string, n_bytes int, kept string")).collect()
    assert r.n_bytes == 3 and bytes(r.kept) == b"abc"
