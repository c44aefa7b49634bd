"""Continuous monitoring of a folder of documents: an extension beside the batch diff.

Every new document is compared with the stored snapshot of its inventory (its file name up to
the first ``@``); changes are appended to a table, and the document becomes the snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.diff import diff
from ..sources.documents import components

KEY = "\x01"


def inventory(sbom_id: str = "sbom_id"):
    return F.substring_index(F.substring_index(sbom_id, "/", -1), "@", 1)


def _last(session: SparkSession, folder: str, batch: int, touched: DataFrame, like: DataFrame) -> DataFrame:
    """The components stored last, before ``batch``, of the inventories in ``touched``; a batch
    that runs again finds the same ones."""
    if batch == 0:
        return session.createDataFrame([], like.schema)
    stored = session.read.schema("inventory string, batch long").parquet(f"{folder}/index").where(F.col("batch") < batch)
    latest = stored.join(touched, "inventory", "left_semi").groupBy("inventory").agg(F.max("batch").alias("batch"))
    every = session.read.schema(StructType([*like.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/versions").where(F.col("batch") < batch)
    return every.join(latest.withColumnRenamed("inventory", "sbom_id"), ["sbom_id", "batch"], "left_semi").select(*like.columns)


def monitor(spark: SparkSession, landing: str, folder: str, once: bool = False) -> StreamingQuery:
    """Appends inventory, id, status, drift of every change to ``folder``/changes/batch=N.

    A batch stores the components of its own documents under its number, and in an index which
    inventories they are; others are neither read nor written again, and a repeated batch
    replaces its own output. Of several documents of one inventory in a batch, the last by path
    counts."""
    arriving = spark.readStream.format("text").option("wholetext", True).load(landing).select(F.col("_metadata.file_path").alias("sbom_id"), F.col("value").alias("text"))

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        last = batch.groupBy(inventory().alias("inventory")).agg(F.max_by(F.struct("sbom_id", "text"), "sbom_id").alias("d"))
        new = components(last.select(F.col("inventory").alias("sbom_id"), "d.text"))
        new = new.withColumn("id", F.concat_ws(KEY, "sbom_id", "id"))
        touched = last.select("inventory")
        changes = diff(_last(session, folder, number, touched, new), new).rows.where("status <> 'same'")
        part = F.split("id", KEY)
        changes.select(part[0].alias("inventory"), part[1].alias("id"), "status", "drift").write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")
        new.write.mode("overwrite").parquet(f"{folder}/versions/batch={number}")
        touched.write.mode("overwrite").parquet(f"{folder}/index/batch={number}")

    writer = arriving.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(availableNow=True) if once else writer).start()
