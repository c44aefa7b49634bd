import numpy as np
import pytest
from pyspark.sql import functions as F

from bomspark.llm.quality import FEATURES, fit, fold, held_out, quality_score, statistics, train
from bomspark.llm.registry import op10_quality

SF = "/root/testdata/sf0.01"


def walk(forest, row):
    total, inner = forest.base, forest.feature.shape[1]
    for f, t, v in zip(forest.feature, forest.threshold, forest.value):
        at = 0
        while at < inner:
            at = 2 * at + (2 if row[f[at]] > t[at] else 1)
        total += v[at - inner]
    return 1 / (1 + np.exp(-total))


def test_flattened_trees_equal_a_walk_of_each_row_and_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = fit(x, y, trees=40)
    assert np.allclose(forest.score(x), [walk(forest, r) for r in x])
    fresh = rng.normal(size=(400, 5))
    assert np.mean((forest.score(fresh) > 0.5) == ((fresh[:, 0] > 0.3) ^ (fresh[:, 1] > 0))) > 0.93


def test_statistics_are_finite_for_odd_texts():
    for text in (None, "", " ", "\n\n", "a", "é" * 100, "|", "A" * 200_000, "x y " * 50_000, "\x00\ud800"):
        values = statistics(text)
        assert len(values) == len(FEATURES) and np.isfinite(values).all()


def test_held_out_accuracy(spark):
    scored = op10_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert np.mean(good) > 0.93 and np.mean(bad) < 0.3
    assert scored.count() == 1000 and scored.where("score < 0 or score > 1 or score is null").count() == 0


def test_held_out_rows_are_never_learnt(spark):
    docs = spark.createDataFrame([(i, "plain words here " * (1 + i % 5) if i % 2 else "### $$$ " * (1 + i % 7)) for i in range(200)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    wrong = labels.withColumn("quality", F.when(fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = train(docs, labels), train(docs, wrong)
    assert np.array_equal(a.value, b.value) and np.array_equal(a.threshold, b.threshold)
    assert {r.doc_id: r.f == 0 for r in docs.select("doc_id", fold(F.col("doc_id")).alias("f")).collect()} == {i: held_out(i) for i in range(200)}


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(1, None)], 0.5), ([(99, 1)], 0.5)])
def test_no_usable_labels(spark, labels, want):
    docs = spark.createDataFrame([(1, "a", 0), (2, None, 0), (2, None, 0), (None, "", 0)], "doc_id long, text string, _id int")
    forest = train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert [r[0] for r in docs.select(quality_score(forest, F.col("text"))).collect()] == [want] * 4
    assert docs.limit(0).select(quality_score(forest, F.col("text"))).count() == 0


def test_an_id_of_many_texts_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(i, "plain words here " * (1 + i % 5) if i % 2 else "### $$$ " * (1 + i % 7)) for i in range(200)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    known = next(i for i in range(200) if not held_out(i))
    more = docs.unionByName(spark.range(500).select(F.lit(known).cast("long").alias("doc_id"), F.concat(F.lit("other text "), "id").alias("text")))
    one = more.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    a, b, c = train(more, labels), train(one, labels), train(more.repartition(7), labels)
    assert np.array_equal(a.value, b.value) and np.array_equal(a.threshold, b.threshold) and np.array_equal(a.value, c.value)
