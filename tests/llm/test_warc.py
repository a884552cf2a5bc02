import gzip
import hashlib

import brute_force as brute
import pytest

from tidewatch.llm import queries, warc
from tidewatch.session import scratch_path

ROOT = "/root/testdata/sf0.001"


def trip(spark, pages, **options):
    arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    warc.write_arc(pages, arc, **options)
    warc.convert(spark, arc, out)
    return warc.read_warc(spark, out), arc, out


def want(rows):
    first = {}
    for r in sorted((x for x in rows if x.page_id is not None), key=lambda x: x.page_id):
        first.setdefault(r.html or "", r.page_id)
    out = []
    for r in rows:
        data = (r.html or "").encode()
        again = first.get(r.html or "") not in (None, r.page_id)
        out.append((r.page_id, len(data), brute.payload_digest(data), "revisit" if again else "response", first[r.html or ""] if again else None))
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(repr((int(r.key) if r.key else None, r.payload_bytes, r.payload_digest, r.type, int(r.refers_to) if r.refers_to else None)) for r in df.collect())


def test_round_trip_of_all_pages(spark):
    pages = spark.read.parquet(f"{ROOT}/pages.parquet")
    got = queries.op7_arc_to_warc(spark, ROOT).collect()
    assert sorted(repr(tuple(r)) for r in got) == want(pages.collect())


def test_copies_line_breaks_and_odd_rows(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "line\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\n", "1 0 x\nURL a b\n", "é\U0001f600\n\n", "<p>a</p>", "z" * 300_000, "HTTP/1.1 404\r\n\r\nx"]
    urls = ["http://a/x y", None, "http://b/\nq", "", "http://é/ü"]
    pages = spark.createDataFrame([(i, urls[i % 5], h, "extra", 1) for i, h in enumerate(html)], "page_id bigint, url string, html string, file string, block int")
    for size in (warc.FILE_BYTES, 50_000, 700):
        df, *_ = trip(spark, pages, file_bytes=size)
        assert rows_of(df) == want(pages.collect())
        for r in df.where("type = 'response'").collect():
            assert r.found_digest == r.payload_digest and r.id.startswith("<urn:uuid:") and r.date == "2024-01-01T00:00:00Z"
    df, *_ = trip(spark, pages.limit(0))
    assert df.count() == 0
    # A null key never stands for others; repeated rows are records of their own.
    twice = spark.createDataFrame([(None, "u", "same"), (3, "u", "same"), (3, "u", "same"), (None, "u", "alone")], "page_id bigint, url string, html string")
    kinds = sorted((r.key or "", r.type, r.refers_to or "") for r in trip(spark, twice)[0].collect())
    assert kinds == [("", "response", ""), ("", "revisit", "3"), ("3", "response", ""), ("3", "revisit", "3")]


def test_both_versions_are_parsed_by_their_own_fields():
    for version, tail in ((1, b"text/html 5"), (2, b"text/html 200 - - 77 f.arc 5")):
        opening = f"{version} 0 org\n{warc.ARC_FIELDS[version]}\n".encode()
        head = b"filedesc://x 0.0.0.0 19990101 text/plain %d\n" % len(opening)
        data = head + opening + b"\nhttp://a/b c 1.2.3.4 19990203040506 " + tail + b"\na\nb\nc\n"
        for raw in (data, gzip.compress(data), gzip.compress(data[:40]) + gzip.compress(data[40:])):
            [(fields, block)] = warc.arc_records(raw)
            assert fields["URL"] == "http://a/b c" and fields["IP-address"] == "1.2.3.4" and block == b"a\nb\nc" and fields.get("Offset") == (None if version == 1 else "77")
    with pytest.raises(ValueError):
        list(warc.arc_records(data[:-4]))
    with pytest.raises(ValueError):
        list(warc.arc_records(b"filedesc://x 0.0.0.0 1999 text/plain 10\n9 0 org\nURL"))


def test_dates_and_digests():
    dates = ["19990203040506", "199902", "1999", "19990203040506123"]
    assert [warc.iso_date(d) for d in dates] == ["1999-02-03T04:05:06Z", "1999-02-01T00:00:00Z", "1999-01-01T00:00:00Z", "1999-02-03T04:05:06Z"]
    assert warc.base32_sha1(b"x") == brute.payload_digest(b"x") and len(hashlib.sha1(b"x").digest()) == 20


def test_files_are_plain_gzip_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "x")], "page_id bigint, url string, html string").coalesce(1)
    _, arc, out = trip(spark, pages)
    import pathlib

    files = [list(warc.warc_records(gzip.decompress(f.read_bytes()))) for f in pathlib.Path(out).rglob("part-*")]
    records = [r for f in files for r in f]
    assert all(f[0][0]["warc-type"] == "warcinfo" for f in files)
    assert [f["warc-type"] for f, _ in records].count("revisit") == 1 and all(len(b) == int(f["content-length"]) for f, b in records)
    assert all(gzip.decompress(f.read_bytes()).startswith(b"filedesc://") for f in pathlib.Path(arc).rglob("part-*"))
