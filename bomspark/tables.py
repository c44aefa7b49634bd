"""Reading tables and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def growing(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join whose sides both grow with the input, so that neither is sent to the driver and broadcast.

    Sizes of files mislead here: a few MB of Parquet can hold millions of rows."""
    return df.hint("merge")


def numbered(df: DataFrame, column: str, *order: str | Column) -> DataFrame:
    """``df`` with ``column``, the dense place (from 0) of each row in ``order``.

    Rows are sorted over all tasks and written; one count a partition gives each its first number."""
    rows = settle(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part, first, starts = F.shiftright("__at", 33), 0, []
    for r in sorted(rows.groupBy(part.alias("part")).count().collect()):  # a row for each partition of the sort
        starts.append((r["part"], first))
        first += r["count"]
    begin = F.broadcast(df.sparkSession.createDataFrame(starts, "__part long, __first long"))
    return rows.join(begin, part == F.col("__part")).withColumn(column, F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__first")
