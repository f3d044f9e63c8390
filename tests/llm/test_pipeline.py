import random

import corpus_pipeline as p
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_near_copies import classes as near_classes
from threadwise.llm import quality_rules
from threadwise.session import reliable


def corpus(rng):
    lex = brute.lexicon(rng, 500) + quality_rules.COMMON_WORDS["en"].split() * 20
    prose = lambda n: brute.mixed_text(rng, n, lex)
    passage = prose(60)
    rows = [(i, prose(rng.randint(60, 200)), "en", rng.choice(["a", "b", "c", None]), 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "a", 0) for i in range(5)]  # exact copies
    rows += [(200 + i, prose(80) + "\n" + passage + "\n" + prose(40), "en", "b", 0) for i in range(6)]
    rows += [(400 + i, f"{rows[i][1]} and one more", "en", "b", 0) for i in range(5)]  # edited copies
    rows += [(300, "too short", "en", "a", 0), (301, None, None, None, None)]
    return [(*r[:4], len(r[1] or "")) for r in rows], passage


def test_stages_against_plain_versions(spark):
    rows, passage = corpus(random.Random(6))
    docs = spark.createDataFrame(rows, brute.DOCS)
    kept = reliable(p.quality(spark, docs, ""))
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == {r[0] for r in rows} - {300, 301}

    single = reliable(p.near_duplicates(spark, kept, ""))
    roots = near_classes(texts)
    left = {r.doc_id: r.text for r in single.collect()}
    assert set(left) == {d for d in texts if roots[d] == d} and not set(left) & {*range(100, 105), *range(400, 405)}

    cut = reliable(p.repeated_passages(spark, single, ""))
    want = brute.repeats(sorted(left.items()))
    got = {r.doc_id: r for r in cut.collect()}
    assert {d: len(r.text.encode()) for d, r in got.items()} == {d: want[d][0] - want[d][1] for d in got}
    assert sum(passage in r.text for r in got.values()) == 1
    assert all(r.n_chars == len(r.text) for r in got.values())

    mixed = reliable(p.mixture(spark, cut, ""))
    assert mixed.columns == docs.columns
    words = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(p.count_words(F.col("text"))).alias("n")).collect()}
    from tests.llm.test_mixing import water

    want = water(words(cut))
    assert {s: abs(n - want[s]) <= 0.5 for s, n in words(mixed).items()} == {s: True for s in words(mixed)}

    pieces = p.packed(spark, mixed, "").collect()
    t = brute.tokenizer("word_bpe_49k.json")
    total = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert sum(r.length for r in pieces) == total


def test_run_equals_its_stages_on_odd_rows(spark, tmp_path):
    rows, _ = corpus(random.Random(7))
    spark.createDataFrame([*rows, *brute.ODD], brute.DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = p.run(spark, str(tmp_path)).collect()
    docs = p.table(spark, str(tmp_path), "documents")
    for _, stage in p.STAGES:
        docs = reliable(stage(spark, docs, str(tmp_path)))
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in got) == sorted((r.doc_id, r.start, r.ids_crc32) for r in docs.collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], brute.DOCS)
    for _, stage in p.STAGES:
        docs = reliable(stage(spark, docs, ""))
    assert docs.count() == 0
