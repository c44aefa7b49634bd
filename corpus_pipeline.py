"""From raw documents to packed training sequences, as five stages over whole tables.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and, but
for the last, returns the columns of ``documents``; columns beyond these pass through.

Defined results: rows, not ids, are kept or dropped, so repeated and null ids lose no unique
text. A null text is judged, compared and packed as an empty one, and stays null until mixing;
mixing takes nothing of texts without words, so they end there. Ties go to the smallest id,
null last, then to one row. Texts are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomspark.llm.common import materialize, small_side, table
from bomspark.llm.jaccard_join import similar_components
from bomspark.llm.mixing import mix, mixed_texts
from bomspark.llm.packing import pack_documents
from bomspark.llm.quality import quality_score, train
from bomspark.llm.registry import EOS, THRESHOLD, WEIGHTS, WINDOW, tokenizer_path
from bomspark.llm.stream_dedup import exact_duplicates


ROW, CHARS = "__row", "__chars"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` written once with a key of its own for each row and the length of its text."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()).withColumn(CHARS, F.length(F.coalesce("text", F.lit("")))), "keyed", "zstd")


def _firsts(keyed: DataFrame, classes: DataFrame, *order: Column) -> DataFrame:
    """Of each class (row key, class) exactly the first row stays: by ``order``, id (null last), row key."""
    rows = classes.join(keyed.select(ROW, CHARS, "doc_id"), ROW)
    best = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*order, F.col("doc_id").isNull(), F.col("doc_id")])], ROW))
    first = rows.groupBy("class").agg(best.alias("best")).select(F.col(f"best.{ROW}").alias(ROW))
    dropped = materialize(classes.select(ROW).join(first, ROW, "left_anti"), "dropped")
    return keyed.join(small_side(dropped), ROW, "left_anti").drop(ROW, CHARS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; learnt from the labelled rows of ``docs``."""
    forest = train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return docs.where(quality_score(forest, F.col("text")) >= THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts exactly one row stays: the longest, then the smallest id."""
    keyed = _keyed(docs)
    equal = exact_duplicates(keyed, id_col=ROW).where("group_size > 1")
    return _firsts(keyed, materialize(equal.select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("class")), "equal"), -F.col(CHARS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets (five words, 0.8) exactly one row stays: the smallest id."""
    keyed = _keyed(docs)
    found = similar_components(keyed, words=5, threshold=(80, 100), id_col=ROW)
    return _firsts(keyed, materialize(found.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("class")), "linked"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, repeats on lines of their own."""
    mixed = mixed_texts(docs, mix(docs, WEIGHTS))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in the packed sequences."""
    return pack_documents(docs, tokenizer_path(), WINDOW, EOS)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The classifier is learnt and the packing tokenised: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
