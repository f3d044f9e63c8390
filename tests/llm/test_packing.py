import random

import numpy as np

from tests.llm import brute
from threadwise.llm import packing

VOCAB = brute.path("word_bpe_49k.json")


def check(rows, docs, size=packing.WINDOW):
    t = brute.tokenizer("word_bpe_49k.json")
    want = sorted([(d is not None, d or 0, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for d, x in docs])
    by_doc: dict = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.length > 0
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
    windows: dict[int, list] = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= size
    total = sum(len(i) for _, _, i in want)
    assert sum(r.length for r in rows) == total
    return by_doc, want, windows, total


def test_every_id_once_and_gapless(spark):
    rng = random.Random(7)
    lex = brute.lexicon(rng)
    docs = [(i, brute.mixed_text(rng, rng.choice([0, 1, 30, 400, 5000]), lex)) for i in range(150)] + [(200, None)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), VOCAB, end_id=2).collect()
    by_doc, want, windows, total = check(rows, docs)
    for _, d, ids in want:
        pieces = sorted(by_doc[(d, len(ids))])
        assert [i for _, p in pieces for i in p] == ids
        assert [s for s, _ in pieces] == [sum(len(p) for _, p in pieces[:k]) for k in range(len(pieces))]
    assert len(windows) <= total / packing.WINDOW * 1.03 + 2


def test_odd_rows(spark):
    rows = packing.pack(spark.createDataFrame(brute.ODD, brute.DOCS), VOCAB, end_id=2).collect()
    check(rows, [(r[0], r[1]) for r in brute.ODD])
    assert sum(r.doc_id is None for r in rows) == 1 and sum(r.doc_id == 7 for r in rows) == 2


def test_empty_table_and_clashing_names(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), VOCAB, end_id=2).collect() == []
    (r,) = packing.pack(spark.createDataFrame([(1, "a", "b", 3)], "doc_id long, text string, ids string, offset int"), VOCAB, end_id=2).collect()
    assert (r.length, r.offset) == (2, 0)


def test_bounded_windows_emit_the_fullest():
    open_ = packing.OpenWindows(10, 2, 0)
    assert open_.place(6) == (0, 0) and open_.place(7) == (1, 0)
    assert open_.place(3) == (1, 7)  # best fit, and full
    assert open_.place(5) == (2, 0) and open_.place(8) == (3, 0)  # 0 was the fullest
    assert open_.fill == {2: 5, 3: 8}
