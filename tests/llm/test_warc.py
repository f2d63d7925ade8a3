"""Archives: both ARC versions, conversion, and the whole way through files."""
import base64
import gzip
import hashlib
import io

import pytest

from tidewarp.llm import warc

ROWS = [(1, "http://a b/\nc", "x\ny", 1), (2, None, None, 1), (None, "u", "x\ny", 1), (1, "http://a b/\nc", "x\ny", 1), (3, "v", "", 1), (None, None, "zé", 1), (None, None, "zé", 1),
        (7, "q", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\nfoo", 1), (8, "http://l", "p" * 300000, 1), (9, "http://m", "p" * 300000, 1), (10, "http://n", "\u0000\r\n\r\n", 1)]
SCHEMA = "page_id long, url string, html string, refers_to int"


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, least=0):
    out = []
    for i, _, html, _ in rows:
        n = len((html or "").encode())
        same = [x[0] for x in rows if (x[2] or "") == (html or "") and x[0] is not None]
        first = min(same, default=None)
        again = n >= least and first is not None and i != first
        out.append((i, n, sha(html), "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 3])
def test_archive(spark, least):
    got = warc.archive(spark.createDataFrame(ROWS, SCHEMA), least).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(ROWS, least)
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html, 0) for r in pages.collect()]
    assert sorted(str(tuple(r)) for r in warc.archive(pages).collect()) == brute(rows)


def test_arc_versions_parse_by_declared_length():
    for version in (1, 2):
        body = b"HTTP/1.0 200 OK\r\n\r\nline\nhttp://x 0.0.0.0 20200101000000 text/html 5\nabcde"
        raw = warc.arc_head(version) + warc.arc_record(version, "http://a/?q=1 2", body, date="200102030405") + warc.arc_record(version, "http://b/", b"")
        one, two = warc.arc_parse(io.BytesIO(raw))
        assert one["URL"] == "http://a/?q=1%202" and one["content"] == body and two["content"] == b""
        assert list(one)[:-1] == warc.ARC_FIELDS[version].split()
        (fields, block), = warc.warc_parse(io.BytesIO(warc.from_arc(one, 5)))
        assert fields["warc-date"] == "2001-02-03T04:05:00Z" and block == body and fields["warc-type"] == "response"
        assert fields["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body.split(b"\r\n\r\n", 1)[1]).digest()).decode()
        (again, block), = warc.warc_parse(io.BytesIO(warc.from_arc(one, 6, 5)))
        assert again["warc-type"] == "revisit" and again["warc-refers-to"] == fields["warc-record-id"] and block == b"HTTP/1.0 200 OK\r\n\r\n"
    # a URL with spaces, as old crawlers left them
    raw = warc.arc_head(1) + b"http://a b c 1.2.3.4 20200101000000 text/html 3\nxyz\n"
    assert next(warc.arc_parse(io.BytesIO(raw)))["URL"] == "http://a b c"
    with pytest.raises(ValueError):
        list(warc.arc_parse(io.BytesIO(warc.arc_head(1) + b"http://a 1.2.3.4 20200101000000 text/html 30\nxyz\n")))
    with pytest.raises(ValueError):
        list(warc.warc_parse(io.BytesIO(b"nonsense\r\n")))
    assert warc.warc_date("20200102") == "2020-01-02T00:00:00Z"


def test_convert_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for version in (1, 2):
        raw = warc.arc_head(version) + b"".join(warc.arc_record(version, f"http://h/{i}", b"body %d" % i) for i in range(5))
        (tmp_path / "in" / f"{version}.arc.gz").write_bytes(gzip.compress(raw) if version == 1 else raw)
    warc.convert_arc(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    rows = warc.read(spark, str(tmp_path / "out")).collect()
    assert sorted((r.url, bytes(r.payload)) for r in rows) == sorted((f"http://h/{i}", b"body %d" % i) for i in range(5) for _ in range(2))
    assert {r.record_type for r in rows} == {"response"}


def test_files_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    record = lambda i, n: warc.from_arc({"URL": f"http://h/{i}", "IP-address": "-", "Archive-date": "20240101", "Content-type": "text/html", "content": b"x" * n}, i)
    sizes = [10, 20, 0, 9000, 5, 1500, 1500, 7]
    files = [b.column(0)[0].as_py() + b"\n" for b in warc._files((record(i, n) for i, n in enumerate(sizes)), "pages")]
    parsed = [list(warc.warc_parse(io.BytesIO(f))) for f in files]
    assert all(p[0][0]["warc-type"] == "warcinfo" and len(p) > 1 for p in parsed)
    assert [int(f["warc-source-row"]) for p in parsed for f, _ in p[1:]] == list(range(len(sizes)))
    assert [len(b) for p in parsed for _, b in p[1:]] == sizes
    assert all(len(f) <= 3000 or len(p) == 2 for f, p in zip(files, parsed)) and len(files) > 3
    assert not list(warc._files(iter([]), "pages"))
