import math
import random
import re
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from threadwise import Settings, support_lexicon
from threadwise.operators import dense as D
from threadwise.operators import drafts as G
from threadwise.operators import retrieval as R

LEX = support_lexicon()
STOP = ("the", "a")


def corpus_rows(n=60, seed=2):
    rng = random.Random(seed)
    vocab = "refund card trip late the app broken driver order food wait pay login code price".split()
    return [(f"p{i:03d}", " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 9)))) for i in range(n)]


def plain_terms(text):
    kept = [t for t in re.findall(r"\w\w+", text.lower()) if t not in STOP]
    return kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])]


class Plain:
    """TF-IDF by the book, dense."""

    def __init__(self, texts):
        docs = [plain_terms(t) for t in texts]
        df = {}
        for d in docs:
            for t in set(d):
                df[t] = df.get(t, 0) + 1
        self.vocab = sorted(t for t, n in df.items() if n >= 2)
        self.idf = np.array([math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in self.vocab])

    def matrix(self, texts):
        m = np.array([[plain_terms(x).count(t) for t in self.vocab] for x in texts]) * self.idf
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def setup(spark, settings=Settings()):
    docs, asks = corpus_rows(), [(f"q{i}", t) for i, (_, t) in enumerate(corpus_rows(20, 9))] + [("q98", "zzz yyy"), ("q99", "")]
    corpus = spark.createDataFrame(docs, "pair_id string, customer_msg string").withColumn("brand_reply", F.lit("Send us a DM"))
    queries = spark.createDataFrame(asks, "query_id string, text string")
    model = R.fit_tfidf(corpus, "pair_id", "customer_msg", STOP, settings=settings)
    return docs, asks, corpus, queries, model


def ranked(scores, ids, k):
    order = sorted(range(len(ids)), key=lambda i: (-round(scores[i], 4), ids[i]))[:k]
    return [(ids[i], round(scores[i], 4)) for i in order]


def collect_hits(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.pair_id, r.score))
    return out


def test_lexical_equals_dense_tfidf_on_both_sides_of_the_bound(spark):
    docs, asks, corpus, queries, model = setup(spark)
    plain, ids = Plain([t for _, t in docs]), [i for i, _ in docs]
    sims = plain.matrix([t for _, t in asks]) @ plain.matrix([t for _, t in docs]).T
    for m in (model, replace(model, settings=replace(Settings(), broadcast_bytes=0))):
        got = collect_hits(R.topk_lexical(m, queries, corpus, 3, pad=True))
        for row, (q, _) in enumerate(asks):
            want = ranked(sims[row], ids, 3)
            assert [s for _, s in got[q]] == [s for _, s in want]
            assert got[q] == want
    assert "q99" not in collect_hits(R.topk_lexical(model, queries, corpus, 3))


def test_vocabulary_is_cut_by_frequency_then_name(spark):
    *_, model = setup(spark, replace(Settings(), max_features=5))
    assert model.vocab.count() == 5


def test_dense_in_one_and_many_blocks(spark):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, size=(80, 6)).astype(float)  # many ties, some zero vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>").repartition(4)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    want = {i: ranked((unit @ unit[i]).tolist(), list(range(80)), 5) for i in range(80)}
    for settings in (Settings(), replace(Settings(), block_rows=30)):
        hits = D.topk_dense(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "pair_id"), 5, settings=settings)
        got = collect_hits(hits)
        assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in want.items()}


def test_lsa_subspace_and_hybrid_equal_numpy(spark):
    settings = replace(Settings(), lsa_components=8)
    docs, asks, corpus, queries, model = setup(spark, settings)
    lsa = D.fit_lsa(model, corpus, "pair_id", "customer_msg")
    plain, ids = Plain([t for _, t in docs]), [i for i, _ in docs]
    a, q = plain.matrix([t for _, t in docs]), plain.matrix([t for _, t in asks])
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(lsa.singular_values, s[:8], atol=1e-6)
    assert np.allclose(lsa.basis @ lsa.basis.T, vt[:8].T @ vt[:8], atol=1e-5)

    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 1e-12)
    latent = unit(q @ vt[:8].T) @ unit(a @ vt[:8].T).T
    scale = lambda x: (x - x.min()) / (x.max() - x.min()) if x.max() > x.min() else np.zeros_like(x)
    lexical = q @ a.T
    got = collect_hits(D.topk_hybrid(lsa, queries, corpus, 3))
    for row, (name, text) in enumerate(asks):
        fused = np.round(0.5 * scale(lexical[row]) + 0.5 * scale(latent[row]), 4)
        cand = [ids.index(i) for i, _ in ranked(fused, ids, 12)]
        tok = set(text.split())
        jac = lambda i: len(tok & set(docs[i][1].split())) / len(tok | set(docs[i][1].split()))
        best = sorted((0.7 * fused[i] + 0.3 * jac(i) for i in cand), reverse=True)[:3]
        mine = [0.7 * s + 0.3 * jac(ids.index(i)) for i, s in got[name]]
        assert np.allclose(mine, best, atol=2e-4)
    many = collect_hits(D.topk_lsa(lsa, queries, corpus, 3))
    assert all(len(v) == 3 for v in many.values())


def test_verified_layer_gates_and_merge_keeps_order_without_hits(spark):
    docs, asks, corpus, queries, model = setup(spark)
    memory = spark.createDataFrame(
        [("r1", "refund card trip", "late", "x", True, False), ("r2", "refund card trip", "late", "y", True, False), ("r3", "refund card trip", "late", "x", None, False)],
        "resolution_id string, original_query string, human_resolution string, intent string, human_verified boolean, conflict_flag boolean",
    )
    ask = spark.createDataFrame([("a", "refund card trip", "x"), ("b", "login code", "x"), ("c", "refund card trip", None)], "query_id string, text string, intent string")
    hits = R.retrieve_verified(model, ask, memory, 3)
    assert sorted((r.query_id, r.pair_id) for r in hits.collect()) == [("a", "res_r1"), ("c", "res_r1"), ("c", "res_r2")]
    hist = R.attach_texts(R.topk_lexical(model, ask, corpus, 3), corpus)
    merged = R.merge_layers(hist, hits, 3)
    assert collect_hits(merged)["b"] == collect_hits(hist)["b"]
    top = [r for r in merged.collect() if r.query_id == "a" and r.pair_id == "res_r1"][0]
    assert top.score == round([r.score for r in hits.collect() if r.query_id == "a"][0] + 0.15, 4)


def test_drafts(spark):
    hits = spark.createDataFrame(
        [("a", "p1", "Please DM us", 1, 0.9), ("a", "p2", "See https://h.example/x", 2, 0.8), ("a", "p3", "send us a note", 3, 0.7)],
        "query_id string, pair_id string, brand_reply string, rank int, score double",
    )
    df = spark.createDataFrame([("a", "billing_payment"), ("b", "trip_issue")], "query_id string, intent string")
    out = {r.query_id: r for r in G.draft_from_templates(df, hits, LEX).collect()}
    assert "If you DM us" in out["a"].draft and out["a"].cited_example_id == "p1" and "(p1, p2, p3)" in out["a"].justification
    assert (out["b"].draft, out["b"].method) == ("", "none")
    texts = [
        ("we have refunded you today already", "billing_payment"), ("look at HTTPS://h.example/x for the steps", "billing_payment"),
        ("look at https://bad.example/x for the steps", "billing_payment"), ("too short", "billing_payment"),
        ("please dm us your email", "safety_incident"), ("our team is so sorry, tell us more", "safety_incident"),
    ]
    rows = spark.createDataFrame([("a", i, t, n) for n, (t, i) in enumerate(texts)], "query_id string, intent string, draft string, attempt int")
    got = {r.attempt: (r.ok, r.issues) for r in G.verify_drafts(rows, hits, LEX).collect()}
    assert got[0] == (False, ["unsupported_promise:we have refunded"])
    assert got[1] == (True, [])
    assert got[2] == (False, ["invented_url:https://bad.example/x"])
    assert got[3] == (False, ["empty_or_too_short"])
    assert got[4] == (True, ["dm_deflection_soft", "safety_tone_missing_soft"])
    assert got[5] == (True, [])
    checked = G.verify_drafts(rows, hits, LEX).withColumn("method", F.lit("model")).select("query_id", "attempt", "draft", "ok", "issues", "method")
    assert G.choose_draft(checked).first().draft == texts[1][0]


def test_threshold_scores_fewer_pairs_and_loses_none(spark):
    import random

    from threadwise.operators import retrieval as ops

    rng = random.Random(3)

    def postings(key, n, terms):
        rows = []
        for i in range(n):
            picked = {min(int(rng.expovariate(0.15)), 59) for _ in range(terms)}
            raw = {t: rng.random() * (1 + t / 10) for t in picked}
            norm = sum(w * w for w in raw.values()) ** 0.5
            rows += [(f"{key}{i}", t, w / norm) for t, w in raw.items()]
        return spark.createDataFrame(rows, f"{key} string, term_id int, weight double")

    asked, docs = postings("q", 40, 6), postings("d", 120, 8)
    every = ops.cosine_pairs(asked, docs, "q", "d")
    some = ops.cosine_pairs(asked, docs, "q", "d", at_least=0.6)
    high = lambda df: {(r.q, r.d, r.score) for r in df.collect() if r.score >= 0.6}
    assert high(some) == high(every) and high(every)
    assert some.count() < 0.6 * every.count()
    joined = ops.cosine_pairs(asked, docs, "q", "d", settings=replace(Settings(), broadcast_bytes=0))
    assert {(r.q, r.d, r.score) for r in joined.collect()} == {(r.q, r.d, r.score) for r in every.collect()}


def clustered(rng, n, dim=12, centres=20):
    near = rng.standard_normal((centres, dim))
    return near[rng.integers(0, centres, n)] + 0.15 * rng.standard_normal((n, dim))


def test_cells_are_exact_skip_and_find_most_with_few_probes(spark):
    rng = np.random.default_rng(6)
    vectors = np.vstack([clustered(rng, 600), np.zeros((2, 12)), rng.standard_normal((40, 12))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>").repartition(4)
    ask, docs = df.where("id % 7 = 0 OR id >= 595").withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "pair_id")
    settings = replace(Settings(), block_rows=6)
    index = D.fit_cells(docs, "pair_id", cells=24, sample=300, settings=settings)
    assert index.rows.count() == len(vectors) and index.parts.max() > 1
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    got = collect_hits(D.topk_cells(index, ask, 5, settings=settings))
    want = {r.query_id: ranked((unit @ unit[r.query_id]).tolist(), list(range(len(unit))), 5) for r in ask.collect()}
    assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in want.items()}
    few = collect_hits(D.topk_cells(index, ask, 5, probes=4, settings=settings))
    found = sum(len({d for d, _ in few[q]} & {d for d, _ in want[q]}) for q in want)
    assert found >= 0.9 * 5 * len(want)

    batch = ask.where("query_id < 595").toPandas().rename(columns={"embedding": "_v"})
    visited = D._reaching(index)(batch.assign(_bound=[want[q][-1][1] for q in batch["query_id"]]))
    assert sum(map(len, visited)) < 0.3 * len(batch) * (index.radius >= 0).sum()


def test_cells_without_rows(spark):
    none = spark.createDataFrame([], "pair_id long, embedding array<double>")
    index = D.fit_cells(none, "pair_id")
    ask = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert D.topk_cells(index, ask).count() == 0


def test_projection_of_many_texts_holds_few_at_a_time():
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(5)
    basis = rng.standard_normal((500, 50))
    sizes = [*rng.integers(0, 40, 8000), D.NONZEROS + 7, 0, 3]
    terms, weights = pd.Series([rng.integers(0, 500, n) for n in sizes]), pd.Series([rng.random(n) for n in sizes])
    tracemalloc.start()
    got = D._project(terms, weights, basis)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, [w @ basis[t] for t, w in zip(terms, weights)])
    assert peak < got.nbytes + 3 * 8 * 50 * D.NONZEROS
    assert D._project(terms[:0], weights[:0], basis).shape == (0, 50)


def test_scores_from_basis_hold_a_row_per_text(spark, tmp_path, monkeypatch):
    from threadwise.plans.registry import search

    rng = random.Random(7)
    words = [f"word{i}" for i in range(30)]
    say = lambda: " ".join(rng.choices(words, k=8))
    rows = [(c, t, "assistant" if t % 2 else "user", "?" if c == 5 and t == 0 else say()) for c in range(25) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    written, reliable = [], search.reliable

    def noted(df):
        out = reliable(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(search, "reliable", noted)
    got = search.f4_scores_from_basis(spark, str(tmp_path)).collect()
    assert len(got) == 50 and all(r.n == r.n_agree == 3 for r in got)
    assert all(n <= 3 * 50 for columns, n in written if {"query_id", "pair_id"} & set(columns))
