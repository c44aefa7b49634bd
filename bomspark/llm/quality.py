"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on the driver from the statistics of a bounded sample of labelled rows
(``max_rows``, the rows of smallest id hash) and flattened into arrays, complete binary
layout, which executors walk for whole batches at once in numpy.

Defined results: null texts count as empty and get a score too. Labels that are null or of
unknown documents are not learnt from; with no usable label every score is 0.5. A null id
hashes as the empty string. Repeated rows score alike; of rows that share an id one text is
learnt from, that of the least hash, with the largest of its labels. Texts are measured whole, however long; scores that tie
stay tied. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("log_chars", "log_words", "word_chars", "upper", "digit", "space", "symbol", "punct", "bar", "shout", "upper_words", "distinct", "top_word", "repeat_next", "lines", "distinct_lines", "line_words", "long_words", "alpha_words", "end_marks", "non_ascii", "hash_words", "bigram_distinct", "starts_upper")
_SYMBOL, _DIGIT, _UPPER, _LOWER = re.compile(r"[#$%&*@^~<>{}\[\]\\/=+_]+"), re.compile(r"[0-9]+"), re.compile(r"[A-ZÀ-Þ]+"), re.compile(r"[a-zß-ÿ]+")


def _length(pattern: re.Pattern[str], text: str) -> int:
    return len("".join(pattern.findall(text)))


def statistics(text: str | None) -> list[float]:
    """The features of one whole text."""
    text = text or ""
    words, n = text.split(), max(len(text), 1)
    m = max(len(words), 1)
    counts, lines = Counter(words), [x for x in text.split("\n") if x]
    letters = _length(_UPPER, text) + _length(_LOWER, text)
    pairs = set(zip(words, words[1:]))
    upper = sum(map(str.isupper, words))
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / m, _length(_UPPER, text) / max(letters, 1), _length(_DIGIT, text) / n, sum(map(text.count, " \n\t")) / n, _length(_SYMBOL, text) / n, sum(map(text.count, ".,;:")) / m, text.count("|") / m, text.count("!") / m,
        upper / m, len(counts) / m, max(counts.values(), default=0) / m, sum(map(str.__eq__, words, words[1:])) / m, len(lines) / m, len(set(lines)) / max(len(lines), 1), m / max(len(lines), 1), sum(len(w) > 12 for w in words) / m, sum(map(str.isalpha, words)) / m, (text.count(".") + text.count("?")) / m,
        1 - len(text.encode("ascii", "ignore")) / n if text else 0.0, sum(v for w, v in counts.items() if len(w) > 24) / m, len(pairs) / max(len(words) - 1, 1), sum(map(str.istitle, words)) / m,
    ]


@dataclass(frozen=True)
class Forest:
    """feature and threshold per inner node, value per leaf; node i has children 2i+1 and 2i+2."""

    depth: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Forest:
    """Logistic boosting on histograms of binned features, level by level."""
    inner, leaves = 2**depth - 1, 2**depth
    rate_of = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(rate_of / (1 - rate_of)))
    if not len(y) or len(set(y.tolist())) < 2:
        return Forest(depth, base if len(y) else 0.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    feature, threshold, value = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    total = np.full(len(y), base)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            gain_best, cut = np.full(width, 1e-6), np.zeros(width, int)
            for f in range(x.shape[1]):
                key = local * bins + binned[:, f]
                gs, hs, ns = (np.bincount(key, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h, None))
                gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                gr, hr, nr = gs[:, -1:] - gl, hs[:, -1:] - hl, ns[:, -1:] - nl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                gain[(nl < least) | (nr < least)] = 0
                best = gain.argmax(1)
                better = gain[np.arange(width), best] > gain_best
                gain_best[better], cut[better] = gain[np.arange(width), best][better], best[better]
                for node in np.flatnonzero(better):
                    feature[tree, first + node], threshold[tree, first + node] = f, edges[f][min(cut[node], len(edges[f]) - 1)]
            node = at
            at = 2 * node + 1 + (x[np.arange(len(y)), feature[tree, node]] > threshold[tree, node])
        leaf = at - inner
        sums, weights = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value[tree] = rate * sums / (weights + ridge)
        total += value[tree][leaf]
    return Forest(depth, base, feature, threshold, value)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", max_rows: int = 12_000) -> Forest:
    """A forest learnt from at most ``max_rows`` labelled documents outside fold 0."""
    usable = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0))
    chosen = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["_id"], "y": batch["_label"], "x": [statistics(t) for t in batch["_text"]]})

    sample = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")  # bounded by max_rows
    # one text of each id, so that repeated ids don't add rows
    sample = sample.groupBy("_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    rows = sample.mapInPandas(measure, "id long, y int, x array<double>").toPandas()
    if rows.empty:
        return fit(np.empty((0, len(FEATURES))), np.empty(0))
    rows = rows.sort_values("id")  # one order whatever the partitions
    return fit(np.array(rows["x"].tolist()), rows["y"].to_numpy(float))


def quality_score(forest: Forest, text: Column) -> Column:
    """Score column (0 to 1) for a text column."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch]) if len(batch) else np.empty((0, len(FEATURES)))
            yield pd.Series(forest.score(x))

    return scores(F.coalesce(text, F.lit("")))


def held_out(doc_id: int | None) -> bool:
    """The fold rule for one id, in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0
