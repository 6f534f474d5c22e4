from __future__ import annotations

import gzip
import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from wordloom.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string, chunk int"


def record(body: bytes, kind="response", uri="http://a.example/", rid="<urn:uuid:1>") -> bytes:
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_round_trip_of_columns(spark):
    rows = [(i, f"http://x/{i}", ("é" * i) + "z" * (i * 31 % 257), "d", 1) for i in range(120)]
    rows += [(500, "u", None, None, None), (501, None, "", "d", 1), (502, "u", "long" * 300_000, "d", 2)]
    chunks = warc.chunk_records(spark.createDataFrame(rows, SCHEMA), 100)
    for r in chunks.where("page_id < 502").collect():
        assert r.n_bytes == len(r.chunk) <= 100 and r.start == 100 * r.chunk_no
    whole = {r.record_id: r for r in warc.assemble(chunks).collect()}
    for page, _, html, *_ in rows:
        r = whole[f"page-{page}"]
        assert bytes(r.payload) == (html or "").encode() and r.intact and r.digest == hashlib.sha256((html or "").encode()).hexdigest()
    lost = warc.assemble(chunks.where("not (page_id = 502 and chunk_no = 7)")).where("record_id = 'page-502'").first()
    assert not lost.intact


def test_prefix_digests(spark):
    got = warc.chunk_records(spark.createDataFrame([(1, "u", "abcdefg", None, None)], SCHEMA), 3).orderBy("chunk_no").collect()
    assert [r.digest for r in got] == [hashlib.sha256(b"abcdefg"[:n]).hexdigest() for n in (3, 6, 7)] and [r.last for r in got] == [False, False, True]


def test_awkward_tables(spark):
    df = spark.createDataFrame([(None, "u", "x", "d", 1), (3, "u", "same", "d", 1), (3, "u", "same", "d", 1)], SCHEMA)
    assert warc.chunk_records(df.limit(0)).collect() == []
    assert sorted((r.page_id or 0, r.record_id) for r in warc.chunk_records(df).collect()) == [(0, None), (3, "page-3"), (3, "page-3")]


def test_files_are_streamed(spark, tmp_path):
    bodies = [b"", b"a" * 1000, b"WARC/1.0\r\n\r\n", bytes(range(256)) * 50]
    plain, zipped = tmp_path / "a.warc", tmp_path / "b.warc.gz"
    plain.write_bytes(b"".join(map(record, bodies)))
    zipped.write_bytes(b"".join(gzip.compress(record(b)) for b in bodies))
    got = warc.read_warc(spark, [str(plain), str(zipped)], 300).orderBy("path", "record_no", "chunk_no").collect()
    for path in (plain, zipped):
        for k, body in enumerate(bodies):
            mine = [r for r in got if r.path == str(path) and r.record_no == k]
            assert b"".join(bytes(r.chunk) for r in mine) == body and mine[-1].last and all(r.complete for r in mine)
            assert mine[-1].digest == hashlib.sha256(body).hexdigest() and all(r.n_bytes <= 300 for r in mine)


@given(st.binary(max_size=400), st.integers(1, 50), st.integers(0, 600))
@settings(max_examples=60, deadline=None)
def test_cut_files_end_without_error(body, chunk, cut):
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".warc") as f:
        f.write((record(body) + record(b"next"))[:cut])
        f.flush()
        rows = list(warc.read_file(f.name, chunk))
    assert all(len(r[8]) <= chunk for r in rows)
    if cut >= len(record(body)) - 4:
        assert b"".join(r[8] for r in rows if r[1] == 0) == body


def test_written_files_read_back(spark, tmp_path):
    rows = [(i, f"http://x/{i}\nbad", "<p>é" * (i % 50), None, None) for i in range(60)] + [(99, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for compress in (True, False):
        files = warc.write_warc(df, str(tmp_path / str(compress)), compress).collect()
        assert sum(f.n_records for f in files) == 61
        got = warc.read_warc(spark, [f.path for f in files], 64)
        whole = warc.assemble(got)
        assert sorted(bytes(r.payload) for r in whole.collect()) == sorted((h or "").encode() for _, _, h, *_ in rows)
        assert whole.where("not intact").count() == 0


def test_long_header_lines_are_read_whole(tmp_path):
    path = tmp_path / "long.warc"
    uri = "http://a.example/" + "x" * 200_000 + ":y"
    path.write_bytes(record(b"one", uri=uri) + record(b"two") + b"no record " * 1000)
    rows = list(warc.read_file(str(path), 100))
    assert [(r[4], r[8], r[11]) for r in rows] == [(uri, b"one", True), ("http://a.example/", b"two", True), (None, b"", False)]
