"""WARC writing and reading: exact round trip, revisits, damage."""

import hashlib
import io
import zlib

import pytest

from vespera.llm import warc


def test_round_trip_and_revisits(spark):
    big = "ä<p>" * 400
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (7, "http://a/7", big), (3, "http://a/3", None), (4, "http://a/4", ""), (5, None, "\r\n\r\nWARC/1.1\r\n\r\n"), (6, "u", "x" * 999), (8, "u", "x" * 999), (9, "long", "\U0001f600 z" * 200_000), (None, "n", "null id")]
    df = spark.createDataFrame([(i, u, h, "extra") for i, u, h in pages], "page_id long, url string, html string, payload string")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(df, roll_bytes=500)).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        data = (html or "").encode()
        row = got[i]
        revisit = i in (1, 2)
        assert (row.payload_bytes, row.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (row.record_type, row.refers_to) == (("revisit", 7) if revisit else ("response", None))
        assert bytes(row.payload) == (b"" if revisit else data)


def test_rows_that_share_the_largest_id_and_empty_tables(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, "a", "y" * 2000)] * 2 + [(0, "b", "y" * 2000)]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, schema))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], schema))).count() == 0


def one(data=b"hello" * 50_000):
    return warc.pack_record(1, "http://a", data, "response", None)


def test_one_member_per_record_and_small_reads():
    raw = one() + one(b"") + warc.pack_record(2, "http://b", b"hello", "revisit", 1)
    first = zlib.decompressobj(31)
    assert first.decompress(raw).startswith(b"WARC/1.1\r\n") and first.eof and first.unused_data

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(7)

    kinds = [(h["warc-type"], p) for h, _, p in warc.read_records(Slow(raw))]
    assert kinds == [("response", b"hello" * 50_000), ("response", b""), ("revisit", b"")]


@pytest.mark.parametrize("damage", ["cut", "digest", "length", "version", "colon"])
def test_damage_is_reported(damage):
    raw = one(b"hello")
    text = zlib.decompress(raw, 31)
    if damage == "cut":
        bad = raw[:-20]
    else:
        old, new = {"digest": (b"hello", b"hullo"), "length": (b"Content-Length: 8", b"Content-Length: 9"), "version": (b"WARC/1.1", b"WARC/9.9"), "colon": (b"WARC-Date: ", b"WARC-Date  ")}[damage]
        text = text.replace(old, new)
        if damage == "colon":
            text = text.replace(b"1970-01-01T00:00:00Z", b"1970")
        deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
        bad = deflate.compress(text) + deflate.flush()
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(bad)))


def test_paths_are_opened_by_sparks_names(tmp_path):
    assert warc._open(f"file://{tmp_path}")[1] == str(tmp_path)
    fs, path = warc._open("s3a://bucket/some/key?region=eu-west-1")
    assert (fs.type_name, path) == ("s3", "bucket/some/key")
