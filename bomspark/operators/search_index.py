"""A stored index over the components of a document: postings of n-grams, last rows of ids, positions.

``postings`` lists, for each n-gram (of 1 to 3 characters) and batch of rows, the positions of components
whose search text holds it, in folders by a hash of the n-gram; ``ids`` has the last component of each
id, in folders by a hash of the id; ``rows`` has the components with their dense position, in folders of
neighbouring positions. A search reads the folders of its own n-grams, keeps components that have all of them and verifies these
alone against their text; queries of up to three characters are answered by postings and need no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..tables import growing, numbered, shared_folder

LONGEST, BUCKETS, BLOCK = 3, 64, 4096


def _text(comps: DataFrame) -> Column:
    return fn.search_text({c: F.col(c) for c in ("name", "version", "purl", "id", "supplier", "cpes", "licenses", "raw") if c in comps.columns})


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """gram, position: for each batch and n-gram the positions whose text holds it."""
    for batch in batches:
        lists: dict[str, list[int]] = {}
        for position, text in zip(batch["position"].tolist(), batch["search_text"]):
            for gram in {text[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(text) - n + 1)}:
                lists.setdefault(gram, []).append(position)
        yield pd.DataFrame({"gram": list(lists), "position": list(lists.values())})


@dataclass(frozen=True)
class SearchIndex:
    folder: str

    @classmethod
    def build(cls, comps: DataFrame, folder: str | None = None) -> SearchIndex:
        """Write the index of ``comps`` (one document) to a fresh folder, by default a shared one."""
        index = cls(folder or shared_folder(comps.sparkSession, "index"))
        placed = numbered(comps, "position", "ordinal").withColumn("search_text", _text(comps))
        placed.withColumn("block", F.floor(F.col("position") / BLOCK).cast("int")).write.partitionBy("block").parquet(f"{index.folder}/rows")
        stored = comps.sparkSession.read.parquet(f"{index.folder}/rows")
        # grouped where the rows are read: a batch holds few different n-grams, though many occurrences of each
        postings = stored.select("position", "search_text").mapInPandas(_listed, "gram string, position array<long>").withColumn("bucket", _bucket(F.col("gram")))
        postings.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{index.folder}/postings")
        ids = stored.groupBy("id").agg(F.max("position").alias("position")).withColumn("bucket", _bucket(F.col("id")))
        ids.repartition("bucket").write.partitionBy("bucket").parquet(f"{index.folder}/ids")
        return index

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "rows").drop("block", "search_text")

    def search(self, spark: SparkSession, query: str) -> DataFrame:
        """The components whose search text holds the query, in document order."""
        query = query.lower()
        if not query:
            raise ValueError("a search needs a query")
        size = min(len(query), LONGEST)
        grams = sorted({query[i : i + size] for i in range(len(query) - size + 1)})
        buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(_bucket(F.col("g"))).distinct().collect()]  # of one query
        found = self._read(spark, "postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams)).select(F.explode("position").alias("position"))
        if len(grams) > 1:
            found = found.groupBy("position").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
        rows = self._read(spark, "rows").join(growing(found.select("position")), "position", "left_semi")
        if len(query) > LONGEST:
            rows = rows.where(F.contains("search_text", F.lit(query)))
        return rows.orderBy("position").drop("block", "search_text")

    def lookup(self, spark: SparkSession, id_: str) -> DataFrame:
        """The last component with this id."""
        bucket = F.pmod(F.xxhash64(F.lit(id_)), F.lit(BUCKETS)).cast("int")
        at = self._read(spark, "ids").where((F.col("bucket") == bucket) & (F.col("id") == id_)).select("position").first()
        return self.page(spark, at.position if at else 0, 1 if at else 0)

    def page(self, spark: SparkSession, offset: int = 0, limit: int = 200) -> DataFrame:
        """Components by position; only the blocks that hold them are read."""
        block = F.col("block").between(offset // BLOCK, max(offset + limit - 1, 0) // BLOCK)
        return self._read(spark, "rows").where(block & (F.col("position") >= offset) & (F.col("position") < offset + limit)).orderBy("position").drop("block", "search_text")
