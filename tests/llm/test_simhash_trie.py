import random

import numpy as np

from tests.llm import brute
from threadwise.llm import components as component_rounds
from threadwise.llm import simhash_trie as s
from threadwise.llm.components import components
from threadwise.session import reliable


def test_equal_to_brute_force(spark, monkeypatch):
    monkeypatch.setattr(s, "NODE_ROWS", 20)
    rng = random.Random(9)
    lex = brute.lexicon(rng)
    docs = []
    for i in range(150):
        words = brute.mixed_text(rng, rng.choice([0, 1, 2, 3, 60, 300]), lex).split()
        docs.append((i, " ".join(words)))
        if words:
            words[rng.randrange(len(words))] = "EDIT"
            docs += [(1000 + i, "\n".join(words)), (2000 + i, " ".join(words).upper())]
    got = {r.doc_id: r for r in s.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), budget=s.BUDGET).collect()}
    fps = {d: brute.simhash(t) for d, t in docs}
    roots = brute.classes(fps)
    assert {d: (f"{fps[d]:016x}", roots[d]) for d in fps} == {d: (r.fingerprint, r.component_id) for d, r in got.items()}


def test_cut_trie_equals_whole_comparison(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    fps = np.unique(np.concatenate([base, base ^ flip() ^ flip(), base[0] ^ flip() ^ flip(), base ^ flip() ^ flip() ^ flip() ^ flip()]))
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = [(r.u, r.v) for r in s.near_links(rows, node_rows=30).collect()]
    want = brute.classes({int(x): int(x) for x in fps})
    root = {k: k for k in want}
    find = lambda k: k if root[k] == k else find(root[k])
    for u, v in links:
        x, y = find(u % 2**64), find(v % 2**64)
        root[max(x, y)] = min(x, y)
    assert {k: find(k) for k in want} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300), (7, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 500: 0}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_odd_rows(spark):
    rows = s.near_duplicates(spark.createDataFrame(brute.ODD, brute.DOCS)).collect()
    assert len(rows) == len(brute.ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16 and by[3].component_id == 1
    assert by[7].component_id == 6 and by[None].component_id is None
    assert s.near_duplicates(spark.createDataFrame([], "doc_id long, text string, fingerprint string")).collect() == []


def test_a_round_of_components_is_written_in_short_plans(spark, monkeypatch):
    shuffles = []

    def noted(df):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return reliable(df)

    monkeypatch.setattr(component_rounds, "reliable", noted)
    links = [(i, i + 1) for i in range(1, 30)] + [(50, i) for i in range(60, 90)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {i: 50 for i in (50, *range(60, 90))}
    assert max(shuffles) <= 3
