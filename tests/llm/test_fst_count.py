import random

import pytest

from tests.llm import brute
from threadwise.llm import fst_count as f

VOCAB = brute.path("byte_bpe_50k.json")
HARD = [
    "", " ", "  ", "a", "'", "''s", "it's", "'re", "'r", "'rx", "'ve's", " 're", "\n're", "a  b", "a \n b", "\n\n", "x\t\ty", "foo bar   z",
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endo", "１２ ½ x²", "日本語テキスト", "été à la", "I'LL i'll 'l 'll", "!!'s", "\x1c x \x85y",
    "a" * 300, "0123456789" * 20, " " * 50 + "x", "　​a", "🙂🙂 🙂", "'d'm't", "x 's", "don't.'s\"'t", "one two  three <|endoftext|>  four ",
]


@pytest.fixture(scope="module")
def machine():
    return f.Transducer(VOCAB)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    letters = "aeisrtnlv'  \n\tABZ09.,!-é ß日🙂"
    out = HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(32, 126)])) for _ in range(30)) for _ in range(200)]
    t = brute.tokenizer("byte_bpe_50k.json")
    return [(x, len(t.encode(x, add_special_tokens=False).ids)) for x in out]


def test_counts_equal_the_library(machine, texts):
    assert [x for x, n in texts if machine.count(x.encode()) != n] == []


def test_transitions_by_bytes_equal_the_library(machine, texts):
    assert [x for x, n in texts if "<|" not in x and machine._run(machine.start, x.encode())[1] != n] == []


@pytest.mark.parametrize("size", [1, 3, 17])
def test_maps_compose(machine, texts, size):
    for x, n in texts[:250]:
        maps = [machine.state_map(c) for c in f.chunks(x.encode(), size, machine.bpe.special)]
        assert machine.total(maps) == n, x
        if len(maps) > 3:  # in any order
            a, b, c = maps[0], machine.compose(maps[1], maps[2]), maps[3:]
            assert machine.total([machine.compose(a, b), *c]) == n


def test_full_tables_begin_anew(texts):
    small = f.Transducer(VOCAB, max_states=40, max_words=5)
    assert [x for x, n in texts[:200] if small.count(x.encode()) != n] == []


def test_long_documents_are_cut(spark):
    rng = random.Random(2)
    lex = brute.lexicon(rng) + ["été", "'s", "日本", "\n", ""]
    rows = [*brute.ODD, (50, brute.mixed_text(rng, 400, lex), "en", "s", 1), (51, "x" * 5000, "en", "s", 1), (52, "ab<|endoftext|>" * 300, "en", "s", 1)]
    t = brute.tokenizer("byte_bpe_50k.json")
    want = sorted((r[0] is not None, r[0] or 0, len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    for chunk in (256, f.CHUNK):
        got = f.count_tokens(spark.createDataFrame(rows, brute.DOCS), VOCAB, chunk=chunk).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want


def test_empty_table_and_clashing_names(spark):
    assert f.count_tokens(spark.createDataFrame([], "doc_id long, text string"), VOCAB).collect() == []
    (r,) = f.count_tokens(spark.createDataFrame([(1, "a b", 9)], "doc_id long, text string, n_tokens int"), VOCAB).collect()
    assert r.n_tokens == 2
