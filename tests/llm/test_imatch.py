import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from threadwise.llm import imatch


def edited(docs):
    texts = [t or "" for _, t in docs]
    for i, t in enumerate(texts):
        half = len(t) // 2
        yield t[: len(t) - half] + texts[(i + 1) % len(texts)][:half]


def test_successors_across_ranges(spark):
    rng = random.Random(5)
    lex = brute.lexicon(rng, 80)
    docs = [(i * 7 % 1000, brute.mixed_text(rng, rng.randint(0, 60), lex)) for i in range(200)]
    docs += [(5000, docs[0][1]), (5001, docs[0][1]), (5002, None), (5003, "🙂é日本")]
    got = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    docs.sort()
    assert len(got) == len(docs)
    for (d, t), e in zip(docs, edited(docs)):
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t or ""), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[5000].fingerprint == got[5001].fingerprint == got[docs[0][0]].fingerprint
    assert got[5000].near_next == 1
    parts = lambda f: [f[i : i + 8] for i in range(0, len(f), 8)]
    for (d, _), (n, _) in zip(docs, docs[1:]):
        a, b = parts(got[d].fingerprint), parts(got[n].fingerprint)
        some = sum(x != imatch.EMPTY or y != imatch.EMPTY for x, y in zip(a, b))
        same = sum(x == y != imatch.EMPTY for x, y in zip(a, b))
        assert got[d].near_next == (same / some if some else 1.0)


def test_parts_depend_on_the_set_of_terms_in_the_band(spark):
    docs = [(1, "alpha beta gamma"), (2, "gamma, BETA alpha alpha"), (3, "alpha beta delta")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    words = spark.createDataFrame([("alpha", 0, 11), ("beta", 0, 12), ("gamma", 3, 13), ("delta", 3, 14)], "term string, subset int, h long")
    got = {r.doc_id: r.fingerprint for r in imatch.fingerprints(df, words=words).collect()}
    assert got[1] == got[2] != got[3] and got[1][:8] == got[3][:8] and got[1][24:32] != got[3][24:32]
    assert got[1][8:16] == imatch.EMPTY


def test_lexicon_is_the_band(spark):
    docs = [(i, " ".join(f"t{k}" for k in range(200) if i % (k + 1) == 0)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.term for r in imatch.lexicon(df, min_share=0.05, max_share=0.3).collect()}
    want = {f"t{k}" for k in range(200) if 10 <= len(range(0, 200, k + 1)) <= 60}
    assert got == want


def test_odd_rows(spark):
    got = imatch.fingerprints(spark.createDataFrame(brute.ODD, brute.DOCS)).collect()
    assert len(got) == len(brute.ODD)
    assert imatch.fingerprints(spark.createDataFrame([], "doc_id long, text string, fingerprint int")).collect() == []
    (only,) = imatch.fingerprints(spark.createDataFrame([(None, "abcd")], "doc_id long, text string")).collect()
    assert only.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_no_python_in_the_plan(spark):
    df = imatch.fingerprints(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_every_term_in_the_band_counts_and_texts_without_one_differ(spark):
    band = [f"t{k}" for k in range(40)]
    docs = [(2 * k + i, t) for k, t in enumerate(band) for i in (0, 1)]  # each term in 2 of some 100 documents
    docs += [(200, "rare words"), (201, "WORDS, rare"), (202, "other ones"), (203, ""), (204, "!!")] + [(300 + i, f"z{i}") for i in range(20)]
    got = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len({got[2 * k].fingerprint for k in range(40)}) == 40
    assert got[200].fingerprint == got[201].fingerprint and got[200].near_next == 1
    assert len({got[i].fingerprint for i in (200, 202, 203, 204)}) == 4
    assert got[201].near_next == got[202].near_next == got[203].near_next == 0


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def test_fingerprints_equal_a_plain_version(spark):
    """Band, deal, sort and hash once more; only the 64-bit hashes of single terms and lists are Spark's."""
    rng = random.Random(9)
    lex = brute.lexicon(rng, 400)
    docs = [(i, " ".join(lex[min(399, int(rng.expovariate(1 / 60)))].title() for _ in range(rng.randint(0, 120)))) for i in range(200)]
    docs += [(1000, "only rare words here"), (1001, "RARE here, words only!"), (1002, None), (1003, "?!"), (1004, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in imatch.fingerprints(df.repartition(3)).collect()}

    terms = lambda t: {w for w in re.split(r"[\W_]+", (t or "").lower()) if w}
    texts = [t or "" for _, t in docs]
    news = list(edited(docs))
    n, every = len(docs), sorted(set().union(*map(terms, texts + news)))
    df_of = {t: sum(t in terms(x) for x in texts) for t in every}
    band = {t for t in every if max(imatch.MIN_DOCS, imatch.MIN_SHARE * n) <= df_of[t] <= imatch.MAX_SHARE * n}
    hashed = spark.createDataFrame([(t,) for t in every], "t string").select("t", F.xxhash64(F.lit(imatch.SEED), "t").alias("h"))
    h = {r.t: r.h for r in hashed.collect()}

    def lists(text):
        own = {}
        for t in terms(text) & band:
            own.setdefault(h[t] % imatch.SUBSETS, []).append(h[t])
        if own:
            return [(k, sorted(v)) for k, v in sorted(own.items())]
        whole = signed(int(np.bitwise_xor.reduce([np.uint64(h[t] & (1 << 64) - 1) for t in terms(text)]))) if terms(text) else text
        return whole

    known = [lists(t) for t in (*texts, *news)]
    flat = [(i, k, v) for i, own in enumerate(known) if isinstance(own, list) for k, v in own]
    flat_rows = spark.createDataFrame(flat, "i long, k int, v array<long>").select("i", "k", F.xxhash64("v").alias("x"))
    parts = {(r.i, r.k): r.x & 0xFFFFFFFF for r in flat_rows.collect()}
    alone = [(i, w if isinstance(w, int) else None, w if isinstance(w, str) else None) for i, w in enumerate(known) if not isinstance(w, list)]
    lone = spark.createDataFrame(alone, "i long, w long, t string").withColumn("w", F.coalesce("w", F.xxhash64(F.lit(imatch.SEED), "t")))
    lone = lone.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(imatch.SUBSETS - 1))))
    parts |= {(r.i, r.k): r.x & 0xFFFFFFFF for r in lone.select("i", "k", F.xxhash64("w", "k").alias("x")).collect()}
    own = [{k: parts[i, k] for k in range(imatch.SUBSETS) if (i, k) in parts} for i in range(2 * n)]
    spelt = lambda p: "".join(f"{p[k]:08x}" if k in p else imatch.EMPTY for k in range(imatch.SUBSETS))
    like = lambda a, b: sum(a[k] == b[k] for k in a.keys() & b.keys()) / len(a.keys() | b.keys())
    for i, (key, _) in enumerate(docs):
        r = got[key]
        assert (r.fingerprint, r.edited_fingerprint) == (spelt(own[i]), spelt(own[n + i])), key
        assert r.near_edited == like(own[i], own[n + i]) and r.near_next == like(own[i], own[(i + 1) % n])
    assert got[1000].fingerprint == got[1001].fingerprint and got[1004].fingerprint == got[3].fingerprint
