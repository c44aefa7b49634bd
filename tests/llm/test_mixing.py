import numpy as np
import pytest
from pyspark.sql import functions as F

from bomspark.llm.mixing import mix, mixed_texts, permuted, shard_counts, taken_words, targets


def filled(sizes, weights, most=3.0):
    """Targets by resharing the excess until none is above."""
    total, names = sum(sizes.values()), sorted(sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = {}
    while True:
        rest, level = total - sum(capped.values()), sum(w[s] for s in names if s not in capped)
        share = {s: rest * w[s] / level for s in names if s not in capped} if level else {}
        over = {s: most * sizes[s] for s in share if share[s] > most * sizes[s]}
        if not over:
            return capped | share
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_sharing(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"+s{i:02}": int(v) for i, v in enumerate(rng.integers(0, 10 ** rng.integers(1, 5, 9)))}
    got = targets(spark.createDataFrame(list(sizes.items()), "src string, source_size long"), (5, 2, 1), 3.0).collect()
    want = filled(sizes, (5, 2, 1))
    assert {r.src: pytest.approx(r.target, rel=1e-9, abs=1e-6) for r in got} == want


@pytest.mark.parametrize("n", [1, 2, 7, 64, 100])
def test_index_permutation_and_its_inverse(spark, n):
    df = spark.range(n).select("id", permuted(F.col("id"), F.lit(n), 5, F.lit("k")).alias("to"))
    rows = df.select("id", "to", permuted(F.col("to"), F.lit(n), 5, F.lit("k"), back=True).alias("back")).collect()
    assert sorted(r.to for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def corpus(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{i}.{j}" for j in range(rng.integers(0, 400))), ["hot", "a", "b", None][min(3, int(rng.exponential(0.8)))], "x") for i in range(300)]
    rows += [(1000, None, "a", "x"), (1001, "", "empty", "x"), (1002, " \n", None, "x"), (1003, " ".join(f"long{j}" for j in range(5000)), "b", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, block string")


def test_taken_words_meet_targets_and_bounds_and_reruns_agree(spark):
    rows, docs = corpus(spark)
    got = {r.doc_id: r for r in taken_words(mix(docs, block_words=64, shard_slots=32)).collect()}
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for i, text, source, _ in rows:
        r, key = got[i], source or "~"
        assert r.size == len((text or "").split()) and 0 <= r.taken <= 3 * r.size
        sizes[key], taken[key], target[key] = sizes.get(key, 0) + r.size, taken.get(key, 0) + r.taken, r.target
    want = filled(sizes, (5, 2, 1))
    for key in sizes:
        assert target[key] == pytest.approx(want[key]) and abs(taken[key] - want[key]) <= 0.5
        assert all(got[i].source_size == sizes[key] for i, _, s, _ in rows if (s or "~") == key)
    again = {r.doc_id: r.taken for r in taken_words(mix(docs.repartition(7), block_words=64, shard_slots=32)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_texts_hold_exactly_the_taken_words(spark):
    rows, docs = corpus(spark)
    m = mix(docs, block_words=64)
    taken = {r.doc_id: r.taken for r in taken_words(m).collect() if r.taken}
    mixed = mixed_texts(docs, m)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r.text.split() for r in mixed.collect()}
    assert {i: len(w) for i, w in got.items()} == taken
    words = {i: (t or "").split() for i, t, _, _ in rows}
    assert all(set(w) <= set(words[i]) and max(map(w.count, w[:3])) <= 3 for i, w in got.items())


def test_slots_are_spread_over_shards(spark):
    _, docs = corpus(spark)
    shards = mix(docs, block_words=16, shard_slots=100).spans.select("shard", "src", "slot").distinct().groupBy("shard").count().collect()
    n = sum(r["count"] for r in shards) / len(shards)
    assert len(shards) > 10 and all(0.4 * n < r["count"] < 1.8 * n for r in shards)


def test_empty_tables(spark):
    assert taken_words(mix(spark.createDataFrame([], "doc_id long, text string, source string"))).count() == 0
    only = taken_words(mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string"))).collect()
    assert [(r.doc_id, r.size, r.target, r.taken) for r in only] == [(1, 0, 0.0, 0)]


def test_repeated_and_missing_ids_are_mixed_row_by_row(spark):
    texts = [" ".join(f"w{i}.{j}" for j in range(150 + i)) for i in range(40)]
    ids = [7] * 10 + [None] * 10 + list(range(100, 115)) + [7] * 5
    rows = [(i, t, ["hot", "a"][k % 3 == 0]) for k, (i, t) in enumerate(zip(ids, texts, strict=True))] + [(7, "same text here", "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mix(docs, (1, 3), block_words=64)
    got = mixed_texts(docs, m).collect()
    target = sum(r.target for r in m.sources.collect())
    assert abs(sum(len(r.text.split()) for r in got) - target) <= len(m.sources.collect())
    assert sum(r.doc_id is None for r in got) and len(got) <= len(rows)
    for r in got:  # every row holds words of one text of its id, each three times at most
        words = r.text.split()
        assert max(map(words.count, words[:3])) <= 3
        assert any(set(words) <= set(t.split()) for i, t, _ in rows if i == r.doc_id)


def test_shards_draw_multinomial_counts(spark):
    wanted = {"a": 50_000, "b": 30_000, "c": 19_900, "d": 100, "none": 0}
    sources = spark.createDataFrame(list(wanted.items()), "src string, slots long")
    rows = shard_counts(sources, 100_000, 250, seed=3).collect()
    slots = {s: sorted((r.first, r["count"]) for r in rows if r.src == s) for s in wanted}
    for s, n in wanted.items():  # each slot once
        assert [f for f, _ in slots[s]] == list(np.cumsum([0, *[c for _, c in slots[s]]])[: len(slots[s])]) and sum(c for _, c in slots[s]) == n
    counts = np.zeros((400, 4))
    for r in rows:
        counts[r.shard, "abcd".index(r.src)] += r["count"]
    counts, p = counts[:380], np.array([0.5, 0.3, 0.199, 0.001])  # the last shards may be cut
    assert np.allclose(counts.mean(0), 250 * p, atol=4 * np.sqrt(250 * p / 380) + 0.1)
    cov = np.cov(counts[:, :3].T)
    assert np.allclose(cov, 250 * (np.diag(p[:3]) - np.outer(p[:3], p[:3])), atol=12)
    chi = ((counts - 250 * p) ** 2 / (250 * p)).sum(1)
    assert 2.5 < chi.mean() < 3.6  # three degrees of freedom
    again = shard_counts(sources.repartition(3), 100_000, 250, seed=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_rows_without_id_are_spread_over_buckets(spark):
    from pyspark.sql import functions as F

    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id").cast("string")).alias("text"), F.lit("one").alias("source"))
    n, buckets = 100_000, round(100_000**0.5)
    sizes = docs.groupBy(F.pmod(F.xxhash64("doc_id", F.lit(2).cast("long"), F.xxhash64("text")), F.lit(buckets))).count()
    assert sizes.agg(F.max("count")).first()[0] < 3 * n / buckets
    m = mix(docs, (5, 2, 1), with_texts=False)
    got = taken_words(m).agg(F.sum("taken").alias("t"), F.count("*").alias("n"), F.max("taken").alias("most")).first()
    assert (got.n, got.t) == (n, 2 * n) and got.most <= 6
