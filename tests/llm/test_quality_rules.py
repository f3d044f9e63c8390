import random

import pytest

from tests.llm import brute
from threadwise.llm import quality_rules as q


def counted(text):
    words = brute.WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), brute.repeat_words(words))


def test_counts_equal_brute_force(spark):
    rng = random.Random(1)
    lex = brute.lexicon(rng, 6) + ["#", "a&b"]
    rows = [*brute.ODD[:5], *brute.ODD[6:]]
    for i in range(40):
        lines = [brute.mixed_text(rng, rng.randint(0, 14), lex) for _ in range(rng.randint(1, 9))]
        rows.append((100 + i, "\n".join(lines + lines[: rng.randint(0, 3)]), "en", "s", 1))
    got = q.judge(spark.createDataFrame(rows, brute.DOCS), with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        want = counted(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_distances_equal_brute_force(spark):
    from math import log2, sqrt

    counts, ref = [3, 0, 5, 2], [0.25, 0.25, 0.5, 0.0]
    p = [c / 10 for c in counts]
    half = lambda x, m: x * log2(x / m) if x else 0.0
    want = sqrt(sum(half(a, (a + b) / 2) + half(b, (a + b) / 2) for a, b in zip(p, ref)) / 2)
    df = spark.sql("SELECT array(3, 0, 5, 2) AS c, array(named_struct('w', 'x', 'n', 3), named_struct('w', 'y', 'n', 5), named_struct('w', 'z', 'n', 2)) AS d")
    from pyspark.sql import functions as F

    got = df.select(q.class_distance(F.col("c"), ref), q.word_distance(F.col("d"), F.lit(10), {"x": 0.25, "o": 0.25, "y": 0.5})).head()
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(want)


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice(q.COMMON_WORDS["en"].split() + brute.lexicon(rng, 20)) for _ in range(200))
    rows = [(i, prose(), "en", "s", 1) for i in range(20)]
    rows += [(50, " ".join(w.upper() + "!!" for w in prose().split()), "en", "s", 1), (51, " ".join(w + "$$%%" for w in prose().split()), "en", "s", 1)]
    got = {r.doc_id: r.kept for r in q.judge(spark.createDataFrame(rows, brute.DOCS)).collect()}
    assert all(got[i] for i in range(20)) and not got[50] and not got[51]


def test_long_text_empty_table_and_clashing_names(spark):
    (r,) = q.judge(spark.createDataFrame([brute.ODD[5]], brute.DOCS)).collect()
    assert (r.n_words, r.n_repeat_words, r.base_failed) == (30_000, 30_000, True)
    assert q.judge(spark.createDataFrame([], brute.DOCS)).collect() == []
    clash = spark.createDataFrame([(1, "a b", "x", True)], "doc_id long, text string, n_words string, kept boolean")
    (r,) = q.judge(clash).collect()
    assert r.n_words == 2 and r.kept is False


def test_no_python_in_the_plan(spark):
    df = q.judge(spark.createDataFrame([(1, "a", "en", "s", 1)], brute.DOCS))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_long_texts_without_common_words_go_in_the_stage(spark):
    import corpus_pipeline

    rng = random.Random(3)
    prose = lambda: " ".join(rng.choice(q.COMMON_WORDS["en"].split() + brute.lexicon(rng, 20)) for _ in range(200))
    junk = lambda n: " ".join("x" + "".join(rng.choice("aeioungkt") for _ in range(7)) for _ in range(n))
    rows = [(i, prose(), "en", "s", 1) for i in range(20)] + [(50, junk(300), "en", "s", 1), (51, junk(40), "en", "s", 1)]
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, spark.createDataFrame(rows, brute.DOCS), "").collect()}
    assert kept == {*range(20), 51}
