import numpy as np
import pytest
from pyspark.sql import functions as F

from bomspark.llm.topk import SortedBlock, block_top_k, exact_top_k


def brute(q, qi, c, ci, k):
    out = []
    for i, x in zip(qi, q, strict=True):
        s = [(-int(x @ y), int(j)) for j, y in zip(ci, c, strict=True) if j != i]
        out += [(int(i), r + 1, j, -v) for r, (v, j) in enumerate(sorted(s)[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_bounds_find_the_exact_best(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 20, (4, 16))
    c = np.floor(centres[rng.integers(0, 4, 700)] + rng.normal(0, 3 + 10 * (seed % 3), (700, 16)))
    if seed == 5:
        c = np.ones((700, 16))  # all scores tie
    ids = rng.permutation(5000)[:700]
    q, qi = c[:40], ids[:40]
    pos, got, score = block_top_k(q, qi, c, ids, 10)
    found = {}
    for p, i, s in zip(pos, got, score, strict=True):
        found.setdefault(int(qi[p]), []).append((-int(s), int(i)))
    assert sorted((i, r + 1, j, -v) for i, x in found.items() for r, (v, j) in enumerate(sorted(x))) == brute(q, qi, c, ids, 10)


def test_query_against_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.3, (90, 8)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], "z") for i in range(90)] + [(200, None, ""), (220, [], ""), (240, [1.0, None], ""), (260, [float("nan")], ""), (280, [float("inf")], ""), (None, [1.0], ""), (40, [float(v) for v in x[40]], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    got = exact_top_k(df, F.col("vec_id") % 20 == 0, k=5, block_rows=25, query_rows=3)
    ids = np.array([i for i in range(90)] + [220, 40])
    c = np.floor(64 * np.vstack([x, np.zeros((1, 8)), x[40:41]]).astype(float))
    pick = [i for i, v in enumerate(ids[:-1]) if v % 20 == 0]
    assert sorted(map(tuple, got.collect())) == brute(c[pick], ids[pick], c, ids, 5)
    assert exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_fewer_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5]), (2, [-1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 2048), (0, 2, 2, -4096)]


@pytest.mark.parametrize("decay, most", [(0.0, 1.0), (1.5, 0.35), (3.0, 0.2)])
def test_reading_stops_early_where_few_dimensions_carry_the_scores(decay, most):
    rng = np.random.default_rng(7)
    scale = 400 * np.arange(1, 17.0) ** -decay
    c, ids = np.floor(rng.standard_t(3, (3000, 16)) * scale), rng.permutation(9000)[:3000]
    block = SortedBlock(c, ids)
    pos, got, score = block.top_k(c[:600], ids[:600], 10)
    want = {}
    for i in range(600):
        s = c @ c[i]
        s[i] = -np.inf
        best = np.lexsort((ids, -s))[:10]
        want[i] = list(zip(ids[best].tolist(), s[best].astype(int).tolist()))
    found = {}
    for p, i, v in zip(pos.tolist(), got.tolist(), score.tolist(), strict=True):
        found.setdefault(p, []).append((i, v))
    assert found == want and block.read / block.whole <= most
