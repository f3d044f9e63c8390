import random

import numpy as np
import pandas as pd
import pytest

from threadwise.config import Settings
from threadwise.operators import impact as I


def rows(rng, key, n, terms=12, same=None):
    out = []
    for i in range(n):
        picked = sorted({min(int(rng.expovariate(0.06)), 199) for _ in range(rng.randint(0, terms))})
        w = np.array([rng.random() ** 3 * (1 + t / 40) for t in picked])
        out.append((f"{key}{i:03d}", np.array(picked, dtype=int), w / np.linalg.norm(w) if len(w) else w, same and rng.choice(same)))
    return pd.DataFrame(out, columns=[key, "term_ids", "weights", "_same"])


def brute(ours, theirs, k, at_least=0.0):
    out = []
    for _, q in ours.iterrows():
        own = dict(zip(q.term_ids, q.weights))
        scored = []
        for _, d in theirs.iterrows():
            s = round(sum(own.get(t, 0) * w for t, w in zip(d.term_ids, d.weights)), 4)
            if s > 0 and s >= at_least and (q._same is None or q._same == d._same):
                scored.append((-s, d["d"]))
        out += [(q["q"], d, -s) for s, d in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("at_least", [0.0, 0.3])
def test_equals_brute_force_and_skips(monkeypatch, at_least):
    monkeypatch.setattr(I, "DOC_BLOCK", 50)
    rng = random.Random(3)
    ours, theirs = rows(rng, "q", 40, same=["a", "b", None]), rows(rng, "d", 400, same=["a", "b", None])
    got, _ = I.best_in_blocks(ours, theirs, "q", "d", 3, at_least)
    got = got[(got.score > 0) & (got.score >= at_least)]
    want = brute(ours, theirs, 3, at_least)
    assert [(a, b) for a, b, _ in got.itertuples(index=False)] == [(a, b) for a, b, _ in want]
    assert np.allclose(got.score, [s for _, _, s in want])


def test_products_before_and_after():
    rng = random.Random(5)
    ours, theirs = rows(rng, "q", 60), rows(rng, "d", 6000, 20)
    theirs = theirs.assign(_same=None)
    spread = pd.Series(np.concatenate(theirs.term_ids.tolist())).value_counts()
    every = sum(int(spread.get(t, 0)) for terms in ours.term_ids for t in terms)
    _, products = I.best_in_blocks(ours, theirs, "q", "d", 3)
    assert products < 0.5 * every


def test_frequent_terms_are_bounded_by_length_and_not_added_up():
    # every document has a few of eight common terms and some rare ones; what a query adds up is its rare lists
    rng = random.Random(7)

    def made(key, n):
        out = []
        for i in range(n):
            terms = sorted(set(rng.sample(range(8), 5)) | {8 + rng.randrange(3000) for _ in range(12)})
            w = np.array([rng.uniform(0.5, 1.5) if t < 8 else rng.uniform(4, 6) for t in terms])
            out.append((f"{key}{i:05d}", np.array(terms), w / np.linalg.norm(w), None))
        return pd.DataFrame(out, columns=[key, "term_ids", "weights", "_same"])

    ours, theirs = made("q", 30), made("d", 4000)
    got, products = I.best_in_blocks(ours, theirs, "q", "d", 3)
    want = brute(ours, theirs, 3)
    assert [tuple(r) for r in got[["q", "d"]].to_numpy()] == [(a, b) for a, b, _ in want]
    spread = pd.Series(np.concatenate(theirs.term_ids.tolist())).value_counts()
    every = sum(int(spread.get(t, 0)) for terms in ours.term_ids for t in terms)
    assert products < 0.1 * every


def test_tiles_are_built_once_and_read_by_every_block_of_questions(spark, monkeypatch):
    docs = [(f"d{i}", t, 0.6 if t else 0.8, "x" if i % 2 else None) for i in range(30) for t in (0, i + 1)]
    corpus = I.packed(spark.createDataFrame(docs, "d string, term_id int, weight double, s string"), "d", ["s"])
    written = I.tiles(corpus, "d").collect()
    assert sum(len(r.ids) for r in written) == 30 and {r._same for r in written} == {None, "1:x"}
    back = [(same, list(ids), tile) for same, tile, ids in I._read([pd.DataFrame([r.asDict() for r in written])])]
    assert sorted(i for _, ids, _ in back for i in ids) == sorted({d[0] for d in docs})
    assert all(len(tile.own_terms) == 2 * len(ids) == len(tile.docs) and np.allclose(tile.norms[-1], 1) for _, ids, tile in back)
    built = []
    monkeypatch.setattr(I.Tile, "of", classmethod(lambda *a: built.append(1)))
    assert len(list(I._read([pd.DataFrame([r.asDict() for r in written])]))) == len(written) and not built


def test_copies_empty_texts_and_no_rows(spark):
    docs = [("d1", 1, 1.0), ("d2", 1, 1.0), ("d3", 1, 0.6), ("d3", 2, 0.8), ("d4", 9, 1.0)]
    corpus = spark.createDataFrame(docs, "d string, term_id int, weight double")
    asked = spark.createDataFrame([("q1", 1, 1.0), ("q2", 7, 1.0)], "q string, term_id int, weight double")
    got = I.top_postings(asked, corpus, 2, "q", "d", settings=Settings())
    assert sorted(map(tuple, got.collect())) == [("q1", "d1", 1.0), ("q1", "d2", 1.0)]
    assert I.top_postings(asked.limit(0), corpus, 2, "q", "d").count() == 0
    assert I.top_postings(asked, corpus.limit(0), 2, "q", "d").count() == 0


def test_right_side_is_read_and_not_copied_for_every_left_block(spark):
    from threadwise.operators.blocks import meet

    def pairs(mine, theirs):
        return pd.DataFrame([(i, j) for block in theirs for i in mine["a"] for j in block["b"]], columns=["a", "b"])

    ours, theirs = spark.range(300).withColumnRenamed("id", "a"), spark.range(90).withColumnRenamed("id", "b")
    met = meet(ours, "a", theirs, "b", pairs, "a long, b long", rows=20, right_rows=40)
    assert "CoGroup" not in met._jdf.queryExecution().toString()
    assert met.count() == met.distinct().count() == 300 * 90
    assert meet(ours, "a", theirs.limit(0), "b", pairs, "a long, b long").count() == 0
