import io

import pytest

from threadwise.llm import arc

PAGES = "page_id long, url string, html string"
ROWS = [
    (5, "http://a.org/", "<p>one</p>"),
    (2, "http://b.org/x y\n", "<p>one</p>"),
    (9, None, None),
    (4, "", ""),
    (7, "http://c.org/é", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nfiledesc:// é"),
    (None, "http://d.org/", "<p>one</p>"),
    (None, "http://d.org/", "only without id"),
    (11, "http://e.org/", "z" * 300_000),
    (2, "http://b.org/again", "<p>one</p>"),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(3)
    arcs = arc.write_arc(pages)
    got = arc.read_records(spark, arc.convert(arcs)).collect()
    assert len(got) == len(ROWS)
    first: dict = {}
    for p, _, h in ROWS:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in ROWS:
        data, least = (h or "").encode(), first.get(h or "")
        revisit = least is not None and p != least
        want.append((p, len(data), arc.base32_sha1(data), "revisit" if revisit else "response", least if revisit else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    names = {(r.page_id, r.payload_digest): r.record_id for r in got if r.record_type == "response"}
    for r in got:
        assert r.refers_to_id == (names[r.refers_to, r.payload_digest] if r.refers_to is not None and r.refers_to != 2 else r.refers_to_id)
        assert r.record_id.startswith("<urn:uuid:") and r.date == "2024-01-01T00:00:00Z"
        if r.record_type == "response":
            assert arc.base32_sha1(r.payload) == r.payload_digest and len(r.payload) == r.payload_bytes
    assert {r.url for r in got if r.page_id == 9} == {"-"} and "http://b.org/x%20y%0A" in {r.url for r in got}


def test_files_roll(spark, monkeypatch):
    monkeypatch.setattr(arc, "FILE_BYTES", 600)
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", f"page {i % 7} " * 20) for i in range(60)], PAGES).repartition(2)
    arcs = arc.write_arc(pages)
    assert arcs.count() > 4
    got = {r.page_id: r.refers_to for r in arc.read_records(spark, arc.convert(arcs)).collect()}
    assert got == {i: (i % 7 if i >= 7 else None) for i in range(60)}


@pytest.mark.parametrize("version", ["1", "2"])
def test_versions_and_lengths(version):
    blocks = [b"plain\n\nhttp://not.a/header 1 2 3 4\n", b"", b"x" * 70_000]
    data = arc.arc_version_block(version, "f.arc") + b"\n"
    for i, b in enumerate(blocks):
        data += arc.arc_header(version, f"http://u/{i} {i}", "text/html", len(data), "f.arc", len(b)) + b + b"\n"
    got = list(arc.read_arc(io.BytesIO(data)))
    assert [r["block"] for r in got] == blocks and [r["URL"] for r in got] == [f"http://u/{i}%20{i}" for i in range(3)]
    assert {r["version"] for r in got} == {version}
    with pytest.raises(ValueError):
        list(arc.read_arc(io.BytesIO(data[:-20])))
    with pytest.raises(ValueError):
        list(arc.read_arc(io.BytesIO(data.replace(b"IP-address", b"IP-Adresse", 1))))


def test_empty_table_and_clashing_names(spark):
    empty = arc.write_arc(spark.createDataFrame([], PAGES))
    assert arc.read_records(spark, arc.convert(empty)).collect() == []
    df = spark.createDataFrame([(1, "http://a/", "x", "path", 3)], PAGES + ", path string, digest int")
    (r,) = arc.read_records(spark, arc.convert(arc.write_arc(df))).collect()
    assert (r.page_id, r.payload_bytes, r.record_type) == (1, 1, "response")


def test_info_record_and_what_a_revisit_names(spark):
    pages = spark.createDataFrame([(1, "http://a/one", "same"), (2, "http://a/two", "same")], PAGES).coalesce(1)
    (path,) = [r.path for r in arc.convert(arc.write_arc(pages)).collect()]
    with arc.open_members(path) as stream:
        (info, about), (first, _), (again, block) = list(arc.read_warc(stream))
    assert info["WARC-Type"] == "warcinfo" and b"arc-version-block: 1 0 " in about and b"converted-from: pages-" in about
    assert first["WARC-Type"] == "response" and again["WARC-Type"] == "revisit" and block.endswith(b"\r\n\r\n")
    assert again["WARC-Refers-To"] == first["WARC-Record-ID"] and again["WARC-Refers-To-Target-URI"] == "http://a/one"
    assert again["WARC-Refers-To-Date"] == first["WARC-Date"]
