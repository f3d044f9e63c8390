import hashlib
import random
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from threadwise.llm import periodic_runs as p
from threadwise.llm import queries


def runs(words):
    """All runs, by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def made(key, words):
    h, n = zlib.crc32(str(key).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % period] for i in range(n)]


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_sequences_of_few_words_equal_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        k, words = rng.choice([1, 2, 2, 3, 4]), []
        while len(words) < rng.randint(0, 60):
            words += [rng.randrange(k) for _ in range(rng.randint(1, 6))] * rng.choice([1, rng.randint(1, 8)])
        got = p.runs_of(np.array(words, dtype=np.uint64))
        assert got == runs(words), words


def test_long_repetitive_texts_take_no_square_of_their_length():
    began = time.process_time()
    for words in ([0] * 100_000, [0, 1] * 50_000, list(range(9000)) * 11):
        assert len(p.runs_of(np.array(words, dtype=np.uint64))) == 1
    assert time.process_time() - began < 60


def texts(rng):
    lex = brute.lexicon(rng, 40)
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += brute.mixed_text(rng, rng.randint(1, 9), lex).split() * rng.choice([1, 1, 4, 5, 7])
        yield 1000 + i, rng.choice([" ", "\n", " \t "]).join(words)


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t)) for i, t in texts(random.Random(2))]
    rows += [r for r in brute.ODD if r[0] != 7]
    spark.createDataFrame(rows, brute.DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for key, text, *_ in rows:
        words = made(key, brute.WORD.findall(text or "")) if key is not None else brute.WORD.findall(text or "")
        want = runs(words) if len(words) < 20_000 else p.runs_of(np.unique(words, return_inverse=True)[1].astype(np.uint64))
        best = max(want, key=lambda r: (r[1] / r[2], -r[0]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in want)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[key]
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best), (key, text)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == sha(lines) and r.collapsed_sha256 == sha(collapsed(words, want))


def test_operator_rows(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c", 5), (1, "a b a b a b a b c", 5), (2, None, 6), (None, "x " * 6, 7)], "doc_id long, text string, runs int")
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in p.find_runs(df).collect())
    assert got == [(0, 6, [(0, 6, 1)], b"x"), (1, 9, [(0, 8, 2)], b"a b c"), (1, 9, [(0, 8, 2)], b"a b c"), (2, 0, [], b"")]
    assert p.find_runs(df.where(F.lit(False))).count() == 0
