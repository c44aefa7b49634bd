import base64
import gzip
import hashlib
import io

import pytest

from bomspark.llm.common import shared_dir
from bomspark.llm.warc import WarcError, archive_round_trip, members, read_archive, read_archives, record_bytes, write_archives


def test_round_trip_with_revisits(spark):
    rows = [(1, "http://a/ü", "<p>é</p>", 0), (2, "http://b\r\n", "<p>é</p>", 0), (3, None, None, 0), (4, "x", "", 0), (5, "y", "z\r\n\r\nWARC/1.0\r\n" * 20000, 0), (7, "w", "<p>é</p>", 0), (7, "w", "<p>é</p>", 0), (None, "n", "<p>é</p>", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = archive_round_trip(spark, pages.repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = next((h or "") for i, _, h, _ in rows if i == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds == {1: ("revisit", 7), 2: ("revisit", 7), 7: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("response", None)}
    small = {r.page_id: r.record_type for r in archive_round_trip(spark, pages, min_revisit_bytes=4).collect()}
    assert small[3] == small[4] == "response" and small[1] == "revisit"


def test_files_are_standard_gzip_and_roll(spark):
    pages = spark.range(40).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(sha2(cast(id as string), 256), 40) as html").repartition(1)
    folder = shared_dir(spark, "warc-test")
    listed = write_archives(pages, folder, roll_bytes=2500)
    assert listed.count() > 3 and listed.agg({"records": "sum"}).first()[0] == 40
    name = listed.first().archive
    data = open(f"{folder.removeprefix('file://')}/{name}", "rb").read()
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == listed.where(f"archive = '{name}'").first().records
    back = read_archives(listed, folder, payloads=True)
    assert {(r.page_id, bytes(r.payload).decode()) for r in back.collect()} == {(r.page_id, r.html) for r in pages.collect()}


def test_reader_checks_members_frames_and_digests():
    good = record_bytes(1, "u", b"payload" * 100, None)
    assert [o for o, _ in members(io.BytesIO(good * 3), buffer=7)] == [0, len(good), 2 * len(good)]
    assert [r["payload"] for r in read_archive(io.BytesIO(good))] == [b"payload" * 100]
    plain = gzip.decompress(good)
    for bad in (good[:-9], good[:40] + b"\0\0\0\0" + good[44:], gzip.compress(plain.replace(b"payload", b"paYload", 1)), gzip.compress(plain.replace(b"Content-Length: 7", b"Content-Length: 6")), gzip.compress(b"nothing")):
        with pytest.raises(WarcError):
            list(read_archive(io.BytesIO(bad)))
    assert list(read_archive(io.BytesIO(b""))) == []


def test_empty_table(spark):
    assert archive_round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_large_ids_beside_null_ones_stay_exact(spark):
    big = (1 << 63) - 1
    pages = spark.createDataFrame([(big, "http://a/", "x"), (big - 1, "http://b/", "x"), (None, "http://c/", "y"), (-(1 << 63), "http://d/", "z")], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.refers_to for r in archive_round_trip(spark, pages).collect()}
    assert got == {big: None, big - 1: big, None: None, -(1 << 63): None}
