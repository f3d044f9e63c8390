import random

import numpy as np
import pytest

from tests.llm import brute
from threadwise.llm import token_frames as f
from threadwise.llm.files import read_random

VOCAB = brute.path("word_bpe_49k.json")


def wanted(docs):
    t, start, out = brute.tokenizer("word_bpe_49k.json"), 0, []
    for d, x in docs:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        out.append((d, start, ids))
        start += len(ids)
    return out


def test_round_trip_in_order(spark):
    rng = random.Random(3)
    lex = brute.lexicon(rng)
    docs = [(i * 3 - 50, brute.mixed_text(rng, rng.choice([0, 1, 50, 900]), lex)) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    manifest = f.write_tokens(df, VOCAB, end_id=1, file_bytes=4000)
    rows = sorted(f.read_tokens(spark, manifest).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows] == wanted(docs)
    assert manifest.count() > 1
    some = f.read_tokens(spark, manifest, doc_ids=[docs[7][0], docs[90][0], 10**9]).collect()
    assert sorted(r.doc_id for r in some) == [docs[7][0], docs[90][0]]


def test_reader_touches_only_the_frames_it_needs(tmp_path):
    with f.new_file(str(tmp_path), "t", ".zst") as (out, uri):
        writer = f.FrameWriter(out, 2, frame_bytes=1000)
        for i in range(100):
            writer.add(i, np.arange(i, i + 100))
        writer.close()
    with read_random(uri) as file:
        reader = f.FrameReader(file)
        assert len(reader.table) > 15
        read = []
        plain = reader.frame
        reader.frame = lambda i: read.append(i) or plain(i)
        ((d, start, ids),) = reader.documents({42})
        assert (d, start, ids.tolist()) == (42, 4200, list(range(42, 142))) and len(read) == 1
    raw = bytearray(open(uri, "rb").read())
    import zstandard

    # The frames are plain zstandard ones: any reader can go through them and skip the seek table.
    assert zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True).read(200) == np.arange(100, dtype="<u2").tobytes()
    raw[40] ^= 255
    (tmp_path / "bad.zst").write_bytes(raw)
    with read_random(str(tmp_path / "bad.zst")) as file, pytest.raises(Exception):
        list(f.FrameReader(file).documents())


def test_odd_rows(spark):
    df = spark.createDataFrame(brute.ODD, brute.DOCS)
    rows = sorted(f.read_tokens(spark, f.write_tokens(df, VOCAB, end_id=1)).collect(), key=lambda r: r.start)
    docs = sorted(((r[0], r[1]) for r in brute.ODD), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows] == wanted(docs)
    assert f.read_tokens(spark, f.write_tokens(spark.createDataFrame([], "doc_id long, text string, path string"), VOCAB, end_id=1)).collect() == []
