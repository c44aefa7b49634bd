"""Lloyd's clustering of integer vectors: float32 screening, exact integers where it is in doubt.

A round is one scan of the vectors. Each Arrow batch is multiplied with all centroids in float32;
for every product a bound of its rounding error is known (see ``nearest``), so that each squared
distance lies in an interval. Centroids whose interval begins after the earliest end are out. Where
one is left it is the nearest; where intervals overlap, those left are recomputed in exact integers
and the lowest number wins ties. Tasks send one exact sum per centroid and component, not vectors;
Spark adds them up, and the driver holds k x dims integers, a size that parameters set.

Defined results: vectors that are null, don't have ``dims`` components or hold null, NaN or infinite
ones take no part. Repeated rows are each a vector and come out once each. Rows without id are
clustered too, but start no centroid while there are others (their hash is null and sorts last).
With fewer than k vectors there are fewer centroids; an empty table gives an empty result. Extra
columns are ignored. Components of any finite size are exact: vectors with scaled components of
2**26 and more, and all vectors once a centroid has one, go through Python's integers. A squared
distance or an inertia that no long can hold is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Scaled components below this are exact in long arithmetic: squares of differences stay below 2**54.
SMALL = 1 << 26
LIMB = 40
LONG = (1 << 63) - 1


def scaled(x: float, scale: float) -> int:
    """floor(scale * x) without rounding, for a finite x of any size."""
    return math.floor(Fraction(x) * Fraction(scale))


def nearest(v: np.ndarray, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of long vectors: nearest centroid (lowest number on ties), squared distance, rows that needed exact work.

    A float32 dot product of d terms, summed in any order, is off by at most g * |v| |c| with
    g = (d + 2) u / (1 - (d + 2) u) and u = 2**-24, which counts the rounding of both factors.
    What the bounds themselves lose in double arithmetic is covered by a slack of 2**-44 of their terms."""
    d, wide_v, wide_c = v.shape[1], v.astype(float), cents.astype(float)
    g = (d + 2) * 2.0**-24 / (1 - (d + 2) * 2.0**-24)
    product = (v.astype(np.float32) @ cents.astype(np.float32).T).astype(float)
    square = (wide_c**2).sum(1)
    off = 2 * g * (1 + 1e-9) * np.sqrt((wide_v**2).sum(1))[:, None] * np.sqrt(square)
    off += (square + 2 * np.abs(product) + off) * 2.0**-44
    middle = square - 2 * product  # the squared distance less |v|^2, which is the same for all
    left = middle - off <= (middle + off).min(1)[:, None]
    cluster = left.argmax(1)
    doubt = np.flatnonzero(left.sum(1) > 1)
    if len(doubt):
        row, col = np.nonzero(left[doubt])
        exact = ((v[doubt][row] - cents[col]) ** 2).sum(1)
        order = np.lexsort((col, exact, row))
        cluster[doubt] = col[order[np.unique(row[order], return_index=True)[1]]]
    return cluster, ((v - cents[cluster]) ** 2).sum(1), len(doubt)


def nearest_exact(v: list[int], cents: list[list[int]]) -> tuple[int, int]:
    distance, cluster = min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    return cluster, distance


def kept_rows(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and components (as double) of the vectors that take part."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False).to_numpy(zero_copy_only=False))
    x = lists.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # null becomes NaN
    finite = np.isfinite(x).all(1)
    return at[finite], x[finite]


class Assigner:
    """Assigns batches of components to centroids; the same for rounds and for the last pass."""

    def __init__(self, cents: list[list[int]], scale: float):
        self.cents, self.scale = cents, scale
        self.small = all(abs(c) < SMALL for row in cents for c in row)
        self.longs = np.array(cents, np.int64) if self.small else None

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, list[int]]]]:
        """Rows for long arithmetic with their long vectors, and the others with Python integers."""
        with np.errstate(over="ignore"):
            whole = np.floor(x * self.scale)
        fit = (np.abs(whole) < SMALL).all(1) & self.small
        rest = ((i, [scaled(c, self.scale) for c in x[i].tolist()]) for i in np.flatnonzero(~fit).tolist())
        return np.flatnonzero(fit), whole[fit].astype(np.int64), rest

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        cluster, distance = np.zeros(len(x), np.int32), np.empty(len(x), object)
        fit, v, rest = self.split(x)
        if len(fit):
            cluster[fit], distance[fit], _ = nearest(v, self.longs)
        for i, row in rest:
            cluster[i], far = nearest_exact(row, self.cents)
            distance[i] = far if far <= LONG else None
        return cluster, distance.tolist()

    def sums(self, batches: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], int]]:
        """Counts and long sums per centroid, and the sums of what no long holds as Python integers."""
        k, dims = len(self.cents), len(self.cents[0])
        count, total, large = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), {}
        for x in batches:
            fit, v, rest = self.split(x)
            if len(fit):
                cluster = nearest(v, self.longs)[0]
                order = np.argsort(cluster, kind="stable")
                there, first = np.unique(cluster[order], return_index=True)
                total[there] += np.add.reduceat(v[order], first, axis=0)
                count += np.bincount(cluster, minlength=k)
            for _, row in rest:
                cluster, _ = nearest_exact(row, self.cents)
                count[cluster] += 1
                for j, c in enumerate(row):
                    large[cluster, j] = large.get((cluster, j), 0) + c
        return count, total, large


def limbs(cluster: int, dim: int, total: int) -> Iterator[tuple[int, int, int, int]]:
    """A sum of any size as (centroid, component, limb, part), total = sum of part << (LIMB * limb)."""
    sign, total, limb = (-1 if total < 0 else 1), abs(total), 0
    while total:
        yield cluster, dim, limb, sign * (total & ((1 << LIMB) - 1))
        total, limb = total >> LIMB, limb + 1


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: float, salt: str, id_col: str, vector: str) -> list[list[int]]:
    """The k vectors whose salted ids have the smallest sha256; equal ids go by their components."""
    usable = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where((F.size(vector) == dims) & usable)
    rows = rows.select(F.sha2(F.concat(F.lit(salt), F.col(id_col).cast("string")), 256).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    return [[scaled(c, scale) for c in r.v] for r in rows.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]


def next_centroids(vectors: DataFrame, cents: list[list[int]], scale: float, vector: str) -> list[list[int]]:
    """floor(sum / count) of each centroid's vectors; centroids without vectors stay."""
    dims = len(cents[0])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, large = Assigner(cents, scale).sums(kept_rows(b.column(0), dims)[1] for b in batches)
        rows = [(j, -1, 0, n) for j, n in enumerate(count.tolist()) if n]
        rows += [(j, d, 0, s) for j, sums in enumerate(total.tolist()) for d, s in enumerate(sums) if s]
        rows += [x for (j, d), s in large.items() for x in limbs(j, d, s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "dim", "limb", "part"])

    parts = vectors.select(vector).mapInArrow(part, "cluster int, dim int, limb int, part long")
    sums: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "dim", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():
        sums[r.cluster, r.dim] = sums.get((r.cluster, r.dim), 0) + (int(r.part) << (LIMB * r.limb))
    return [[sums.get((j, d), 0) // sums[j, -1] for d in range(dims)] if (j, -1) in sums else row for j, row in enumerate(cents)]


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, salt: str = "1:", id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector after ``rounds`` rounds, and the centroids."""
    cents = first_centroids(vectors, k, dims, scale, salt, id_col, vector)
    for _ in range(rounds if cents else 0):
        cents = next_centroids(vectors, cents, scale, vector)
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("v"))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(cents, scale)
        for batch in batches:
            at, x = kept_rows(batch.column(1), dims)
            cluster, distance = assigner.assign(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    id_type = source.schema["vec_id"].dataType.simpleString()
    if not cents:
        return source.sparkSession.createDataFrame([], f"vec_id {id_type}, cluster int, distance long"), cents
    return source.mapInArrow(last, f"vec_id {id_type}, cluster int, distance long"), cents


def centroid_digest(cent: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, cent)).encode()).hexdigest()


def clusters_with_inertia(vectors: DataFrame, **options) -> DataFrame:
    """``cluster_vectors`` with each cluster's and the whole inertia and the digest of the centroid."""
    found, cents = cluster_vectors(vectors, **options)
    found = materialize(found, "clusters")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()  # at most k rows
    inertia = {r.cluster: int(r.s) if not r.lost else LONG + 1 for r in sums}
    whole = sum(inertia.values())
    fits = lambda x: x if x <= LONG else None
    rows = [(j, fits(inertia.get(j, 0)), fits(whole), centroid_digest(c)) for j, c in enumerate(cents)]
    info = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(info), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
