"""Exact dedup as a stateful stream, with DataFrame functions only.

Digests of the normalised texts are fed to a streaming aggregation whose keyed state lives
on disk (RocksDB) and never expires. Per digest the state retains the row count and, of the
row that stays, a stable identifier and a content locator (its file and its row there). Rows
whose digest was seen more than once are hits: the full text of the row that stays is fetched
by its locator and compared with theirs, and should different texts ever share a digest, the
rows of that digest are grouped by text instead. Documents that don't come from Parquet files
are written to the state's folder first, so that locators hold.

Defined results: null texts count as empty; all-white-space texts are equal to empty ones.
Of equal texts the row with the most code points stays, then the smallest id; rows that tie
in both (repeated rows) are all marked kept and counted each. A null id orders last; any
64-bit id is fine. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialize, shared_dir, small_side

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.compactOnCommit": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space ahead of need
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _locator() -> list[Column]:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def _is_located(docs: DataFrame) -> bool:
    """Whether rows come from Parquet files, which number them."""
    try:
        docs.select(*_locator()).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


class StreamingDedup:
    """Digest state in ``folder``; batches may be added at any time, also after a restart."""

    def __init__(self, spark: SparkSession, folder: str | None = None, digest_chars: int = 64):
        self.spark, self.folder, self.digest_chars = spark, folder or shared_dir(spark, "dedup"), digest_chars

    def _digest(self, text: Column) -> Column:
        return F.substring(F.sha2(normalised(text), 256), 1, self.digest_chars)

    def _copies(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, text string, batch string").parquet(f"{self.folder}/texts")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> None:
        """Append the digests of ``docs`` to the feed and bring the state up to date."""
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
        if not _is_located(docs):
            batch = uuid.uuid4().hex
            rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{self.folder}/texts", compression="zstd")
            rows = self._copies().where(F.col("batch") == batch)
        feed = rows.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), *_locator())
        feed = feed.withColumn("digest", F.substring("text_sha256", 1, self.digest_chars))
        feed.write.mode("append").parquet(f"{self.folder}/feed")
        own = self.spark.newSession()  # the settings of the state are those of its stream alone
        for k, v in {**STATE_CONF, "spark.sql.shuffle.partitions": self.spark.conf.get("spark.sql.shuffle.partitions")}.items():
            own.conf.set(k, v)
        stream = own.readStream.schema(feed.schema).option("maxBytesPerTrigger", 64 << 30).parquet(f"{self.folder}/feed")
        best = F.min(F.struct((-F.col("n_chars")).alias("minus_chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row"))
        state = stream.groupBy("digest").agg(F.count("*").alias("n"), best.alias("best"))
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    def feed(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/feed")

    def state(self) -> DataFrame:
        """digest, n, keep_chars, keep_id, keep_file, keep_row: the state after the last batch."""
        raw = self.spark.read.format("statestore").load(f"{self.folder}/state")
        count, best = (f"value.`{f.name}`" for f in raw.schema["value"].dataType.fields)
        return raw.select("key.digest", F.col(count).alias("n"), (-F.col(f"{best}.minus_chars")).alias("keep_chars"), F.col(f"{best}.doc_id").alias("keep_id"), F.col(f"{best}.file").alias("keep_file"), F.col(f"{best}.row").alias("keep_row"))

    def decisions(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 of every document fed so far.

        ``docs`` holds the texts of these documents, for comparing the full bytes of hits."""
        if not self.feed().limit(1).count():
            return self.spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
        state = materialize(self.state(), "dedup-state")
        hits = small_side(state.where("n > 1").select("digest", "keep_file", "keep_row"))
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text)).alias("norm"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"), self._digest(F.col(text)).alias("digest"))
        source, body = (docs, text) if _is_located(docs) else (self._copies(), "text")
        stays = source.select(*_locator(), normalised(F.col(body)).alias("kept_norm")).join(hits.select("digest", F.col("keep_file").alias("file"), F.col("keep_row").alias("row")), ["file", "row"]).select("digest", "kept_norm")
        classes = texts.join(hits.select("digest"), "digest", "left_semi").groupBy("digest", "norm").agg(F.count("*").alias("n"))
        mixed = materialize(classes.join(stays, "digest", "left").where(~F.col("norm").eqNullSafe(F.col("kept_norm"))).select("digest").distinct(), "collisions")

        def judged(rows: DataFrame) -> DataFrame:
            kept = (F.col("n_chars") == F.col("keep_chars")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
            return rows.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), "text_sha256")

        if mixed.isEmpty():
            return judged(self.feed().join(state, "digest"))
        plain = judged(self.feed().join(state.join(mixed, "digest", "left_anti"), "digest"))
        odd = texts.join(mixed, "digest", "left_semi")
        best = odd.groupBy("digest", "norm").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("n_chars")).alias("minus"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("best"))
        best = best.select("digest", "norm", "n", (-F.col("best.minus")).alias("keep_chars"), F.col("best.doc_id").alias("keep_id"))
        return plain.unionByName(judged(odd.join(best, ["digest", "norm"]).withColumn("text_sha256", F.sha2("norm", 256))))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", digest_chars: int = 64) -> DataFrame:
    """One pass of the stream over ``docs`` and the decision on every row."""
    dedup = StreamingDedup(docs.sparkSession, digest_chars=digest_chars)
    dedup.add(docs, id_col, text)
    return dedup.decisions(docs, id_col, text)
