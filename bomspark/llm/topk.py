"""Exact top-k inner-product search by sorted lists without random access.

Vectors are cut into blocks of candidates and blocks of queries; each pair of blocks is one
task's work. Inside, every dimension is a list sorted by value once (read from the top for
positive query weights, from the bottom for negative ones). Lists are read in growing steps.
Lower bounds are running sums: an entry read replaces the worst value that its list holds.
The best a candidate that stands in no list so far can reach is the sum of what the lists
still offer; while that is not below a query's k-th lower bound, upper bounds can't end the
reading and aren't made. Once it is, reading stops if few candidates have an upper bound that
reaches the k-th lower one, and their scores are resolved. A slice of queries begins at the
depth at which the slice before it stopped first, or at the lists' ends if none did. Per-block
winners are merged by a window over each query.

How much is read depends on the data: a third of it where a few dimensions carry the scores,
all of it where many even dimensions do, as they must be for an exact answer.

Defined results: vectors that are null, or hold null, NaN or infinite components, take no
part, nor do rows without id. Shorter vectors are padded with zeros. Repeated rows with one id are each a candidate,
but never for a query with that id; repeated query rows count once. An empty table gives an
empty result. Components are floored as doubles; their scaled values must be below 2**26 in
size, so that scores are exact (an error says so otherwise).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of each list that are read before its end.
DEPTHS = (1 / 64, 1 / 16, 1 / 4)
#: Queries that read a block's lists together.
SLICE = 256


class SortedBlock:
    """A block of candidates as one sorted list per dimension, read by slices of queries.

    ``read`` and ``whole`` count the list entries that queries have read, and all there are."""

    def __init__(self, cands: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.cands, self.ids, self.n = cands[order], ids[order], len(order)
        by_value = np.argsort(-self.cands, axis=0, kind="stable")
        self.rank = np.empty(by_value.shape, np.int32)
        np.put_along_axis(self.rank, by_value, np.arange(self.n, dtype=np.int32)[:, None], axis=0)
        self.ordered = np.take_along_axis(self.cands, by_value, axis=0)
        self.depths = sorted({int(self.n * share) for share in DEPTHS if int(self.n * share)})
        self.gains: dict[tuple[int, int], np.ndarray] = {}
        self.start = self.read = self.whole = 0

    def _gain(self, before: int, depth: int) -> np.ndarray:
        """What the entries from ``before`` to ``depth`` add to lower bounds, for lists read from the top and from the bottom."""
        if (before, depth) not in self.gains:
            top = (self.rank >= before) & (self.rank < depth)
            bottom = (self.rank < self.n - before) & (self.rank >= self.n - depth)
            self.gains[before, depth] = np.hstack([np.where(top, self.cands - self.ordered[-1], 0), np.where(bottom, self.cands - self.ordered[0], 0)]).T.copy()
        return self.gains[before, depth]

    def _slice(self, q: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        n, up, down = self.n, np.maximum(q, 0), np.minimum(q, 0)
        left, right = np.searchsorted(self.ids, ids), np.searchsorted(self.ids, ids, side="right")
        own = [(i, slice(left[i], right[i])) for i in np.flatnonzero(left < right)]
        open_, before, stopped = np.arange(len(q)), 0, []
        depths = self.depths[self.start :] if n > 4 * k else []
        if depths:
            low = np.repeat((up @ self.ordered[-1] + down @ self.ordered[0])[:, None], n, axis=1)
            for i, at in own:
                low[i, at] = -np.inf
        for depth in depths:
            low[open_] += np.hstack([up, down])[open_] @ self._gain(before, depth)
            before = depth
            unseen = up[open_] @ self.ordered[depth] + down[open_] @ self.ordered[n - 1 - depth]
            kth = np.partition(low[open_], n - k, axis=1)[:, n - k]
            done = open_[unseen < kth]  # no candidate that stands in no list so far can qualify
            for i, bound in zip(done, kth[unseen < kth], strict=True):
                high = np.where(self.rank < depth, self.cands, self.ordered[depth]) @ up[i] + np.where(self.rank >= n - depth, self.cands, self.ordered[n - 1 - depth]) @ down[i]
                high[low[i] == -np.inf] = -np.inf
                keep = np.flatnonzero(high >= bound)
                if len(keep) > n // 4:
                    continue  # outsiders can still qualify: read on
                stopped.append(depth)
                self.read += depth
                open_ = open_[open_ != i]
                yield self._best(i, keep, self.cands[keep] @ q[i], k)
            if not len(open_):
                break
        self.whole += len(q) * n
        self.read += len(open_) * n
        # later slices begin where the first query of this one stopped
        self.start = self.depths.index(min(stopped)) if stopped else len(self.depths)
        if len(open_):
            score = q[open_] @ self.cands.T
            place = {i: row for row, i in enumerate(open_)}
            for i, at in own:
                if i in place:
                    score[place[i], at] = -np.inf
            kth = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(open_), -np.inf)
            for row, i in enumerate(open_):
                keep = np.flatnonzero((score[row] >= kth[row]) & (score[row] > -np.inf))
                yield self._best(i, keep, score[row, keep], k)

    def _best(self, i: int, keep: np.ndarray, score: np.ndarray, k: int) -> tuple[int, np.ndarray, np.ndarray]:
        best = np.lexsort((keep, -score))[:k]
        return i, self.ids[keep[best]], score[best].astype(np.int64)

    def top_k(self, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, candidate id, score) of each query's k best in the block, ties to the smaller id."""
        got = [(at + i, c, s) for at in range(0, len(q), SLICE) for i, c, s in self._slice(q[at : at + SLICE], ids[at : at + SLICE], k)]
        if not got:
            return np.empty(0, int), np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([np.full(len(c), i) for i, c, _ in got]), np.concatenate([c for _, c, _ in got]), np.concatenate([s for _, _, s in got])


def block_top_k(queries: np.ndarray, query_ids: np.ndarray, cands: np.ndarray, cand_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return SortedBlock(cands, cand_ids).top_k(queries, query_ids, k)


def _pack(group: str, blocks: Column, df: DataFrame) -> DataFrame:
    packed = df.groupBy(blocks.alias(group)).agg(F.collect_list(F.struct("id", "v")).alias(f"{group}_rows"))
    return packed


def _matrix(rows: list) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([r["id"] for r in rows], dtype=np.int64)
    width = max((len(r["v"]) for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for x, r in zip(out, rows, strict=True):
        x[: len(r["v"])] = r["v"]
    if out.size and np.abs(out).max() >= 2.0**26:
        raise ValueError("a scaled component is too large for exact scores")
    return ids, out


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector: str = "embedding", block_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query row."""
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"), is_query.alias("is_query"))
    n, n_query = rows.agg(F.count("*"), F.count_if("is_query")).first()
    cb, qb = max(1, -(-n // block_rows)), max(1, -(-n_query // query_rows))
    cands = _pack("cb", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(cb)), rows.select("id", "v"))
    queries = _pack("qb", F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(qb)), rows.where("is_query").select("id", "v").dropDuplicates(["id"]))
    grid = cands.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))).withColumn("cell", F.col("cb") * qb + F.col("qb"))
    grid = grid.join(queries.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1)))).select((F.col("cb") * qb + F.col("qb")).alias("cell"), "qb_rows"), "cell").select("cb_rows", "qb_rows")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c_rows, q_rows in zip(batch.cb_rows, batch.qb_rows, strict=True):
                (ci, c), (qi, q) = _matrix(list(c_rows)), _matrix(list(q_rows))
                width = max(c.shape[1], q.shape[1])
                c, q = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (c, q))
                pos, ids, score = block_top_k(q, qi, c, ci, k)
                yield pd.DataFrame({"query_id": qi[pos], "vec_id": ids, "score": score})

    found = grid.mapInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
