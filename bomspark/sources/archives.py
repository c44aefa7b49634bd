"""Baselines from workflow archives: which run to take, and one entry of its ZIP archive.

``runs`` are rows in the order in which they are listed, newest first. An archive is one binary row;
its entry is found by the directory at the end, inflated piece by piece and checked by size and checksum.
"""

from __future__ import annotations

import io
import posixpath
import stat
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Events whose runs are trusted, and the largest archive and document.
TRUSTED = ("push", "workflow_dispatch", "schedule", "repository_dispatch", "release")
MOST_ARCHIVE, MOST_DOCUMENT = 200 << 20, 50 << 20


class ArchiveError(ValueError):
    pass


def safe_path(path: str) -> str:
    """The relative path in its shortest form; an error if it leaves the archive."""
    plain = posixpath.normpath(path.replace("\\", "/").rstrip("/") or ".")
    if not path or "\0" in path or plain.startswith(("/", "../")) or plain in ("..", ".") or plain[1:2] == ":":
        raise ArchiveError(f"unsafe path in archive: {path!r}")
    return plain


def newest_artifact(runs: DataFrame, artifacts: DataFrame, branch: str, name: str) -> DataFrame:
    """run_id, artifact_id of the first listed run that succeeded on ``branch`` after a trusted event and
    has an artifact of this name that isn't expired; no row if there is none, an error if it has several.

    ``runs``: run_id, place, conclusion, head_branch, event; ``artifacts``: run_id, artifact_id, name, expired."""
    good = runs.where((F.col("conclusion") == "success") & (F.col("head_branch") == branch) & F.col("event").isin(*TRUSTED)).select("run_id", "place")
    named = artifacts.where((F.col("name") == name) & ~F.coalesce("expired", F.lit(False))).groupBy("run_id").agg(F.count("*").alias("n"), F.min("artifact_id").alias("artifact_id"))
    first = good.join(named, "run_id").orderBy("place").limit(1)
    several = F.raise_error(F.concat(F.lit("run "), F.col("run_id").cast("string"), F.lit(f" has several artifacts named {name}")))
    return first.select("run_id", F.when(F.col("n") > 1, several).otherwise(F.col("artifact_id")).alias("artifact_id"))


def entry(archive: bytes, path: str, most: int = MOST_DOCUMENT) -> bytes:
    """The content of the one entry at ``path``."""
    wanted, found = safe_path(path), None
    if len(archive) > MOST_ARCHIVE:
        raise ArchiveError("archive is too large")
    try:
        with zipfile.ZipFile(io.BytesIO(archive)) as directory:
            for info in directory.infolist():
                if stat.S_ISLNK(info.external_attr >> 16):
                    raise ArchiveError(f"archive holds a link: {info.filename}")
                if safe_path(info.filename) == wanted:
                    if found:
                        raise ArchiveError(f"archive holds {wanted} twice")
                    found = info
            if found is None:
                raise ArchiveError(f"archive does not hold {wanted}")
            if found.flag_bits & 1 or found.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ArchiveError("archive entry is encrypted or of an unknown compression")
            if found.file_size > most:
                raise ArchiveError("archive entry is too large")
            out = bytearray()
            with directory.open(found) as stream:  # inflates as it is read, and checks the checksum at its end
                while piece := stream.read(1 << 16):
                    out += piece
                    if len(out) > most:
                        raise ArchiveError("archive entry is too large")
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError) as error:
        raise ArchiveError(f"archive is broken: {error}") from error
    if len(out) != found.file_size:
        raise ArchiveError("archive entry has another size than stated")
    return bytes(out)


def read_archives(spark: SparkSession, path: str, inside: str) -> DataFrame:
    """sbom_id (the archive), text: the document at ``inside`` of each archive below ``path``."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([entry(content.as_py(), inside).decode("utf-8")])], ["sbom_id", "text"])

    return raw.mapInArrow(unpack, "sbom_id string, text string")
