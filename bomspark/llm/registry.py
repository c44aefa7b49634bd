"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import clusters_with_inertia
from .chunk_dedup import repeated_spans
from .common import table
from .decontaminate import contamination
from .html_text import extract_pages
from .jaccard_join import similar_components
from .mixing import mix, taken_words
from .oracles import CENTROIDS, DECONTAMINATE, SPELLING
from .packing import pack_documents
from .quality import fold, quality_score, train
from .spelling import spelling_variants
from .stream_dedup import exact_duplicates
from .topk import exact_top_k
from .url_filter import filter_urls
from .warc import archive_round_trip

URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
WEIGHTS = (5, 2, 1)
WINDOW, EOS = 4096, 2
THRESHOLD = 0.3


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages", "page_id", "url", "html"), URL_RULES)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), WINDOW, EOS)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"), WEIGHTS, with_texts=False))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_round_trip(spark, table(spark, sf_dir, "pages", "page_id", "url", "html"), min_revisit_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, threshold=(90, 100))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    forest = train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), quality_score(forest, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters_with_inertia(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_exact_top_k, op3_substring_dedup, op4_packing, op5_html_text, op6_mixing, op7_warc, op8_jaccard_join, op9_exact_dedup, op10_quality, op11_centroids, op12_spelling, op13_decontaminate, pipeline)
}

#: The others are iterative, learnt, tokenised or byte-level; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op11_centroids": CENTROIDS,
    "op12_spelling": SPELLING,
    "op13_decontaminate": DECONTAMINATE,
    "op2_exact_top_k": """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 20 = 0) q JOIN v c ON c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op9_exact_dedup": r"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), k AS (
  SELECT doc_id, h, n, count(*) OVER (PARTITION BY h) AS group_size, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
""",
}
