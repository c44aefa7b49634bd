"""Documents as frames of lines, put in order and written by Spark.

A document is a list of pieces: constant texts, and frames that give one line a row. ``document``
makes one sorted frame of them; its part files, by name one after the other, are the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import numbered, settle

WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Rows:
    """key (array of strings, the order of lines), line; ``separator`` stands before every line
    but the first of the piece."""

    frame: DataFrame
    separator: str = ""


Piece = str | Rows


def quoted(c: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]$", "")


def rows(df: DataFrame, line: Column, *order: str, separator: str = "") -> Rows:
    """Lines of ``df`` in the order of its columns ``order``: strings by code point, null first,
    whole numbers from 0 on by value."""
    kinds = dict(df.dtypes)
    keys = [F.lpad(F.col(c).cast("string"), 19, "0") if kinds[c] in WHOLE else F.col(c).cast("string") for c in order]
    key = F.array(*[F.coalesce(k, F.lit("")) for k in keys]) if keys else F.array().cast("array<string>")
    return Rows(df.select(key.alias("key"), line.alias("line")), separator)


def document(spark: SparkSession, pieces: list[Piece]) -> DataFrame:
    """line, sorted. Equal rows keep their number; the lines are a table in the shared folder, so
    that numbers stay when a task runs again."""
    constant = [(i, "", p) for i, p in enumerate(pieces) if isinstance(p, str)]
    frames = [spark.createDataFrame(constant, "section int, separator string, line string").coalesce(1).withColumn("key", F.array().cast("array<string>"))]
    frames += [p.frame.select(F.lit(i).alias("section"), F.lit(p.separator).alias("separator"), "line", "key") for i, p in enumerate(pieces) if isinstance(p, Rows)]
    made = settle(reduce(DataFrame.unionByName, frames).withColumn("number", F.monotonically_increasing_id()), "lines")
    at = F.struct("key", "number")
    first = made.where("separator <> ''").groupBy("section").agg(F.min(at).alias("first"))  # one row a piece
    apart = F.when(at != F.col("first"), F.col("separator")).otherwise("")
    return made.join(F.broadcast(first), "section", "left").orderBy("section", "key", "number").select(F.concat(F.coalesce(apart, F.lit("")), "line").alias("line"))


def texts(made: DataFrame) -> Iterator[str]:
    """The lines of a document, one partition at a time."""
    return (f"{r.line}\n" for r in made.toLocalIterator())


def write(made: DataFrame, path: str) -> None:
    """A new folder of part files, written by the executors, if ``path`` ends with a slash; else
    one local file or standard output, which takes its lines through the driver."""
    if path.endswith("/"):
        made.write.text(path)
        return
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(texts(made))


# What stands after a text that was cut, and how long a summary and a comment may be.
CUT = "_Report truncated; use the report-markdown output for the complete report._"
SUMMARY_MOST, COMMENT_MOST = 900_000, 60_000
CHUNK = 1000


def bounded(made: DataFrame, most: int = SUMMARY_MOST) -> DataFrame:
    """The first ``most`` characters of a document, line ends included, with a closing note if more was cut.

    Lengths run up in two levels: sums of ``CHUNK`` lines each, one row a chunk, then within the one
    chunk in which the limit lies. The line in which it lies is cut there. The note says how many lines
    were left out or cut."""
    lines = numbered(made.withColumn("n", F.length("line") + 1).withColumn("order", F.monotonically_increasing_id()), "at", "order").drop("order")
    chunk = F.floor(F.col("at") / CHUNK)
    chunks = lines.groupBy(chunk.alias("chunk")).agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for 1,000 lines
    chunks = settle(chunks.withColumn("before", before), "chunks")
    inside = F.sum("n").over(Window.partitionBy("chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    near = lines.withColumn("chunk", chunk).join(chunks.where(F.col("before") < most).select("chunk", "before"), "chunk")
    kept = near.withColumn("start", F.col("before") + inside).where(F.col("start") < most)
    whole = F.col("start") + F.col("n") <= most
    kept = settle(kept.select("at", F.when(whole, F.col("line")).otherwise(F.substring("line", F.lit(1), (F.lit(most) - F.col("start")).cast("int"))).alias("line"), (~whole & (F.length("line") > most - F.col("start"))).alias("cut")), "bounded")
    total, n, cut = made.count(), *kept.agg(F.count("*"), F.count_if("cut")).first()
    if total == n and not cut:
        return kept.orderBy("at").select("line")
    note = made.sparkSession.createDataFrame([(n + i, t) for i, t in enumerate(("", f"_{total - n + cut} lines are cut or left out._", CUT))], "at long, line string")
    return kept.select("at", "line").unionByName(note).orderBy("at").select("line")
