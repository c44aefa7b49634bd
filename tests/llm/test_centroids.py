import hashlib
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bomspark.llm.centroids import LONG, Assigner, cluster_vectors, clusters_with_inertia, limbs, nearest, nearest_exact
from bomspark.llm.registry import ORACLES


def brute(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    salted = lambda i: (i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest())
    cents = [v for _, v in sorted(kept, key=lambda r: (salted(r[0]), r[1]))[:k]]
    for _ in range(rounds):
        groups = [[] for _ in cents]
        for _, v in kept:
            groups[nearest_exact(v, cents)[0]].append(v)
        cents = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else old for g, old in zip(groups, cents, strict=True)]
    found = [(i, *nearest_exact(v, cents)) for i, v in kept]
    inertia = [sum(d for _, c, d in found if c == j) for j in range(len(cents))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    fits = lambda x: x if x <= LONG else None
    return sorted(((i, c, fits(d), fits(inertia[c]), fits(sum(inertia)), digest[c]) for i, c, d in found), key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in clusters_with_inertia(df, **options).collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 40, 5_000, (1 << 26) - 1]))
def test_screening_is_exact_with_many_ties(seed, size):
    rng = np.random.default_rng(seed)
    cents = rng.integers(-size, size + 1, (12, 9))
    cents[5] = cents[2]  # always a tie, which the lower number wins
    cents[7] = cents[3] + rng.integers(-1, 2, 9)
    v = np.vstack([rng.integers(-size, size + 1, (40, 9)), cents, (cents[:6] + cents[6:]) // 2])
    cluster, distance, _ = nearest(v, cents)
    assert list(zip(cluster.tolist(), distance.tolist(), strict=True)) == [nearest_exact(x, cents.tolist()) for x in v.tolist()]


def test_exact_work_is_rare_unless_distances_are_close():
    rng = np.random.default_rng(1)
    v, cents = rng.integers(-40, 40, (4000, 64)), rng.integers(-40, 40, (16, 64))
    assert nearest(v, cents)[2] < 40  # of 4,000: only ties to the last digit
    far = v + 2**25
    assert nearest(far, cents + 2**25)[2] > 0 and (nearest(far, cents + 2**25)[0] == nearest(v, cents)[0]).all()


@given(st.integers(-(2**1030), 2**1030))
def test_limbs_of_any_size(total):
    assert sum(part << (40 * limb) for _, _, limb, part in limbs(0, 0, total)) == total


def test_large_components_take_the_exact_path():
    small, large = Assigner([[0, 0], [100, 0]], 64.0), Assigner([[0, 0], [2**40, 0]], 64.0)
    x = np.array([[1.0, 0.0], [3e38, -1.0], [1e300, 0.0], [2.0**34, 0]])
    assert small.assign(x)[0].tolist() == [1, 1, 1, 1] and small.assign(x)[1][1:3] == [None, None]
    assert large.assign(x)[0].tolist() == [0, 1, 1, 1] and large.assign(x)[1][3] == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_query_against_brute_force_with_odd_rows(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.3, 8))]) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(200, 260)]  # a large group of copies
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[10][1])]
    odd = [(300, None), (301, []), (302, [0.5] * 7), (303, [0.5] * 9), (304, [0.5] * 7 + [None]), (305, [float("nan")] + [0.5] * 7), (306, [float("-inf")] + [0.5] * 7)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], f"vec_id long, embedding array<{kind}>, cluster string, distance int").repartition(5)
    assert got(df, k=6, dims=8) == brute(rows + odd, 6, 3, 8)
    assert got(df, k=500, dims=8) == brute(rows + odd, 500, 3, 8)  # more centroids than vectors
    huge = rows + [(400, [3e38] * 8), (401, [-3e38] + [0.0] * 7), (402, [2.0**31] * 8)]
    more = spark.createDataFrame(huge, f"vec_id long, embedding array<{kind}>")
    huge = [(i, [float(np.float32(x)) if kind == "float" else x for x in v]) for i, v in huge]
    assert got(more, k=123, dims=8) == brute(huge, 123, 3, 8)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clusters_with_inertia(empty).collect() == [] and cluster_vectors(empty)[1] == []
    assert clusters_with_inertia(spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>")).collect() == []


def test_oracle_agrees_with_brute_force():
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 64).astype(np.float32).tolist()) for i in range(90)] + [(90, None), (91, [1.0])]
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows]), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))}))
    assert sorted(con.execute(ORACLES["op11_centroids"]).fetchall(), key=repr) == brute(rows)
