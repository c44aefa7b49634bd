"""WARC archives: writer with revisit records, and a sequential reader.

Every record is a gzip member of its own. The reader walks an archive member by member with
incremental decompression, frames each record by its Content-Length and verifies block and
payload digests; at no time does it hold more than one record and one input buffer.

Defined results: null payloads are empty. Of records with equal payloads of at least
``min_revisit_bytes`` the one with the largest id is the response, the others revisit it.
Repeated rows with the largest id are all responses. Null ids and urls are written as empty headers and read back as null.
A broken member, frame or digest raises ``WarcError``. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, small_side

RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, archive_offset long"


class WarcError(ValueError):
    pass


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member with a response record, or a revisit record when refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "" if page_id is None else page_id
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream: BinaryIO, buffer: int = 1 << 18) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member, decompressed as the stream is read."""
    rest, at = b"", 0
    while True:
        rest = rest or stream.read(buffer)
        if not rest:
            return
        inflate, parts, began = zlib.decompressobj(31), [], at
        while not inflate.eof:
            data = rest or stream.read(buffer)
            rest = b""
            if not data:
                raise WarcError(f"the member at {began} is cut off")
            try:
                parts.append(inflate.decompress(data))
            except zlib.error as error:
                raise WarcError(f"the member at {began} is broken: {error}") from error
            at += len(data) - len(inflate.unused_data)
        rest = inflate.unused_data
        yield began, b"".join(parts)


def parse_record(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, found, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise WarcError("not a record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(headers.get("content-length", -1))
    if length < 0 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length} does not frame the block")
    return headers, rest[:length]


def read_archive(stream: BinaryIO) -> Iterator[dict]:
    """The records of an archive in order, with verified digests."""
    for offset, content in members(stream):
        headers, block = parse_record(content)
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit = headers["warc-type"] == "revisit"
        stated = headers["warc-payload-digest"].removeprefix("sha1:")
        if sha1_base32(block) != headers["warc-block-digest"].removeprefix("sha1:") or not revisit and sha1_base32(payload) != stated:
            raise WarcError(f"a digest of {headers.get('warc-record-id')} does not fit")
        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        number = lambda key: int(headers[key].rpartition(":")[2].rstrip(">")) if headers.get(key, "").rpartition(":")[2].rstrip(">") else None
        yield {"page_id": number("warc-record-id"), "url": headers.get("warc-target-uri") or None, "record_type": headers["warc-type"], "payload_bytes": length, "payload_digest": stated, "refers_to": number("warc-refers-to"), "archive_offset": offset, "payload": None if revisit else payload}


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write archives below ``folder``; returns the table (archive, records, bytes) of them.

    A file is written under a name of the attempt and listed only once it is complete, so a
    repeated task leaves at most unlisted files."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    groups = rows.select("page_id", digest.alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("response_id")).where("n > 1").drop("n")
    marked = rows.withColumn("digest", digest).join(small_side(materialize(groups, "payload-groups")), "digest", "left").withColumn("refers_to", F.when(F.col("page_id") < F.col("response_id"), F.col("response_id"))).drop("digest", "response_id")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base)
        done, out, path, size, count = [], None, "", 0, 0
        for batch in batches:
            for page, link, content, refers in zip(batch.page_id, batch.url, batch.html, batch.refers_to, strict=True):
                if out is None:
                    path, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(path, compression=None)
                data = record_bytes(None if pd.isna(page) else int(page), link, content.encode("utf-8", "surrogatepass"), None if pd.isna(refers) else int(refers))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= roll_bytes:
                    out.close()
                    done.append((path.rpartition("/")[2], count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path.rpartition("/")[2], count, size))
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    marked = marked.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})  # longs beside nulls would become floats in pandas
    return materialize(marked.mapInPandas(write, "archive string, records long, bytes long"), "archive-list")


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """All records of the listed archives, one archive per task at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.archive:
                rows, size = [], 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for record in read_archive(stream):
                        if not payloads:
                            del record["payload"]
                        rows.append(record | {"archive": name})
                        size += record["payload_bytes"] if payloads else 200
                        if size > 4 << 20:
                            yield _frame(rows)
                            rows, size = [], 0
                if rows:
                    yield _frame(rows)

    # a fixed number of partitions: a short list of names says nothing of the work behind it
    return archives.select("archive").repartition(max(1, min(archives.count(), 100_000)), "archive").mapInPandas(read, RECORDS + (", payload binary" if payloads else ""))


def _frame(rows: list[dict]) -> pd.DataFrame:
    # longs beside nulls would become floats
    return pd.DataFrame({k: pd.array([r[k] for r in rows], "Int64") if k in ("page_id", "refers_to") else [r[k] for r in rows] for k in rows[0]})


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and return their records."""
    folder = shared_dir(spark, "warc")
    return read_archives(write_archives(pages, folder, min_revisit_bytes=min_revisit_bytes), folder)
