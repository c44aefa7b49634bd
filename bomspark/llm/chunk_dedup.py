"""Substring dedup by content-defined chunking.

A gear rolling hash over the UTF-8 bytes sets chunk borders from content alone, so an
insertion shifts borders only near itself. Chunks are deduplicated by a 96-bit digest;
neighbouring repeated chunks of a document are joined into spans. The table of repeated
chunks is written first, so that a chunk which many documents share meets them in a join
of two shuffles, which Spark splits where it is skewed.

A span's ends then grow character by character. Its first and its last chunk each lead to
the first occurrence of that chunk; the characters beside both places are compared, up to
``REACH`` of them, and what agrees is added to the span at either place. Of the texts only
the characters beside such places are taken. Spans of one row that meet are joined.

Defined results: null and empty texts have no chunks. Rows count one by one: rows that share
an id, or have none, each get spans of their own, with that id or null. Spans of fewer than
``min_words`` words once grown, a parameter, are not reported; a word counts where it begins.
Spans that have fewer even with the whole chunks beside them are left out before they grow.
A span is ``first`` if each of its chunks is the first occurrence (smallest id, null last, then
row, then position). Texts are cut whole, however long. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Random 16-bit numbers of the gear hash, from a fixed seed.
GEAR = np.random.default_rng(20240501).integers(0, 1 << 16, 256, dtype=np.uint16)
#: A digest of 96 bits: at 10**13 chunks fewer than 0.001 pairs of unequal chunks share one.
DIGEST = np.dtype([("digest", "<i8"), ("digest2", "<i4")])
#: Characters that a span can grow by at each end: two of the longest chunks, after which borders agree again.
REACH = 160
#: What names a text, and a place in one.
TEXT_KEY = ["no_id", "doc_id", "text_id"]
PLACE = [*TEXT_KEY, "side", "at"]
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + GEAR[data[i]] in 16 bits, for all i at once: 16 bytes of window."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        shifted = h[:-width] << np.uint16(width) if len(h) > width else h[:0]
        h = h.copy()
        h[width:] += shifted
    return h


def borders(data: np.ndarray, least: int = 10, bits: int = 4, most: int = 80) -> np.ndarray:
    """End offsets of the chunks of ``data``, 26 bytes on average; no border splits a character.

    A border is set by the upper bits of the hash's low byte, so by the 8 bytes before it: in a
    passage that stands in two texts borders agree after few bytes."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    starts_char = np.append((data[1:] & 0xC0) != 0x80, True)
    low = gear(data).astype(np.uint8)
    ends = (np.flatnonzero((low >> np.uint8(8 - bits) == 0) & starts_char) + 1).tolist()
    out, at = [], 0
    for end in [*ends, n]:
        while end - at > most:
            cut = at + most
            while cut < n and not starts_char[cut - 1]:
                cut += 1
            out.append(cut)
            at = cut
        if end - at >= least or (end == n and end > at):
            out.append(end)
            at = end
    return np.array(out)


#: Characters (80 bytes and the rest of a character at most), words in the chunk, in the one before, in the one after.
SHAPE = {"length": 21, "words": 14, "before": 7, "after": 0}


def _keyed(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    doc = F.col(id_col).cast("long")
    return texts.select(doc.isNull().alias("no_id"), F.coalesce(doc, F.lit(0)).alias("doc_id"), F.xxhash64(text).alias("text_id"), F.col(text).alias("text"))


def chunks(texts: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every chunk of every text: row, doc_id (0 if no_id), digest, digest2, start in characters, shape, text_id (on a row's first chunk only).

    ``shape`` holds four small numbers in one, as every chunk is shuffled twice: see SHAPE."""
    names = ("row", "no_id", "doc_id", "digest", "digest2", "start", "shape", "text_id")

    def frame(parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        out = pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True)))
        out["text_id"] = out["text_id"].astype("Int64").where(out["start"] == 0)
        return out

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            size = 0
            for row, no_id, doc, text_id, value in zip(batch["row"], batch["no_id"], batch["doc_id"], batch["text_id"], batch["text"], strict=True):
                raw = (value or "").encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, np.uint8)
                if not len(data):
                    continue
                ends = borders(data)
                begins = np.concatenate(([0], ends[:-1]))
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                space = SPACE[data]
                heads = np.concatenate(([0], np.cumsum(~space & np.concatenate(([True], space[:-1])))))
                digest = np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=12).digest() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]), DIGEST)
                n, words = len(ends), heads[ends] - heads[begins]
                beside = np.concatenate(([0], words, [0]))
                shape = ((chars[ends] - chars[begins]) << 21) | (words << 14) | (beside[:-2] << 7) | beside[2:]
                parts.append((np.full(n, row), np.full(n, no_id), np.full(n, doc), digest["digest"], digest["digest2"], chars[begins], shape, np.full(n, text_id)))
                size += n
                if size > 100_000:
                    yield frame(parts)
                    parts, size = [], 0
            if parts:
                yield frame(parts)

    keyed = _keyed(texts, id_col, text).withColumn("row", F.monotonically_increasing_id())
    return keyed.mapInPandas(cut, "row long, no_id boolean, doc_id long, digest long, digest2 int, start int, shape int, text_id long")


def _written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder; the shuffles that it took are removed as soon as it stands."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return materialize(df, name, "zstd")
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _islands(all_chunks: DataFrame) -> DataFrame:
    """Runs of neighbouring repeated chunks of a row, with the first occurrence's place for both ends."""
    key = ["digest", "digest2"]
    counted = all_chunks.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("no_id", "doc_id", "row", "start")).alias("one")).where("n > 1")
    one = [F.col("one.row").alias("one_row"), F.when(~F.col("one.no_id"), F.col("one.doc_id")).alias("one_doc"), F.col("one.start").alias("one_start")]
    repeated = _written(counted.select(*key, *one), "repeated")
    shape = {name: F.shiftright("shape", at).bitwiseAND(127) for name, at in SHAPE.items()}
    hits = all_chunks.select("row", *key, "start", "shape").join(repeated, key).drop(*key)
    end, order = F.col("start") + F.col("length"), Window.partitionBy("row").orderBy("start")
    hits = hits.repartition("row").withColumns(shape)  # sizes stay packed in the shuffle
    hits = hits.withColumn("opens", F.coalesce(F.lag(end).over(order) != F.col("start"), F.lit(True))).withColumn("island", F.count_if("opens").over(order))
    return hits.groupBy("row", "island").agg(
        F.min("start").alias("start"),
        F.max(end).alias("end"),
        F.sum("words").alias("words"),
        F.count("*").alias("n_chunks"),
        F.min((F.col("one_row") == F.col("row")) & (F.col("one_start") == F.col("start"))).alias("first"),
        F.min("one_doc").alias("first_doc_id"),
        F.min_by(F.struct(F.col("one_row").alias("row"), F.col("one_start").alias("at")), "start").alias("left"),
        F.max_by(F.struct(F.col("one_row").alias("row"), (F.col("one_start") + F.col("length")).alias("at")), "start").alias("right"),
        F.min_by("before", "start").alias("before"),
        F.max_by("after", "start").alias("after"),
    ).drop("island")


def _with_texts(spans: DataFrame, all_chunks: DataFrame) -> DataFrame:
    """``spans`` with their rows' ids and text_id, and with left and right as places in texts."""
    texts = all_chunks.where("start = 0").select("row", *TEXT_KEY)
    out = spans.join(texts, "row")
    for side in ("left", "right"):
        other = texts.select(F.col("row").alias("other_row"), F.struct(*TEXT_KEY).alias("other"))
        place = F.struct(*(f"other.{c}" for c in TEXT_KEY), f"{side}.at")
        out = out.join(other, F.col(f"{side}.row") == F.col("other_row")).withColumn(side, place).drop("other_row", "other")
    return out


def _beside(requests: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """PLACE, context: the characters on the outer side of each place, with one more that tells where a word begins."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for no_id, doc, text_id, value, places in zip(*(batch[c] for c in (*TEXT_KEY, "text", "places")), strict=True):
                for p in places:
                    side, at = p["side"], p["at"]
                    context = value[max(0, at - 1) : at + REACH] if side else value[max(0, at - REACH - 1) : at]
                    out.append((no_id, doc, text_id, side, at, context))
            yield pd.DataFrame(out, columns=[*PLACE, "context"])

    wanted = requests.distinct().groupBy(*TEXT_KEY).agg(F.collect_list(F.struct("side", "at")).alias("places"))
    found = _keyed(docs, id_col, text).where("text is not null").join(wanted, TEXT_KEY).select(*TEXT_KEY, "text", "places")
    return found.mapInPandas(take, "no_id boolean, doc_id long, text_id long, side int, at int, context string").dropDuplicates(PLACE)


def agree(side: int, one: str, two: str) -> int:
    """How many characters beside two places agree, outwards: side 0 leftwards, 1 rightwards after the character before the place."""
    a, b = (one[1:], two[1:]) if side else (one[::-1], two[::-1])
    n = min(len(a), len(b), REACH)
    return next((i for i in range(n) if a[i] != b[i]), n)


def grown(side: int, context: str, n: int) -> str:
    """The n characters beside a place in text order, after the one before them (a line feed at a text's start)."""
    if side:
        return context[: n + 1]
    return context[len(context) - n - 1 :] if len(context) > n else "\n" + context


def _growth(spans: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """PLACE, more: for each end that can grow, the longest string that it shares with its first occurrence or, being that, with another."""
    own = [F.struct(*TEXT_KEY, F.col(c).alias("at")) for c in ("start", "end")]
    sides = F.array(*(F.struct(F.lit(i).alias("side"), own[i].alias("own"), F.col(c).alias("other")) for i, c in enumerate(("left", "right"))))
    edges = spans.select(F.inline(sides)).where("own <> other").distinct()

    def places(of: str) -> DataFrame:
        return edges.select(*(f"{of}.{c}" for c in TEXT_KEY), "side", f"{of}.at")

    contexts = _written(_beside(places("own").union(places("other")), docs, id_col, text), "contexts")

    def named(of: str) -> DataFrame:
        return contexts.select("side", F.struct(*TEXT_KEY, "at").alias(of), F.col("context").alias(f"{of}_context"))

    met = edges.join(named("own"), ["side", "own"]).join(named("other"), ["side", "other"])
    flat = met.select("side", *(F.col(f"{of}.{c}").alias(f"{of}_{c}") for of in ("own", "other") for c in (*TEXT_KEY, "at")), "own_context", "other_context")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [agree(*x) for x in zip(batch["side"], batch["own_context"], batch["other_context"], strict=True)]
            for of in ("own", "other"):
                more = [grown(s, c, k) for s, c, k in zip(batch["side"], batch[f"{of}_context"], n, strict=True)]
                out = pd.DataFrame({**{c: batch[f"{of}_{c}"] for c in TEXT_KEY}, "side": batch["side"], "at": batch[f"{of}_at"], "n": n, "more": more})
                yield out[out["n"] > 0]

    longest = flat.mapInPandas(compare, "no_id boolean, doc_id long, text_id long, side int, at int, n int, more string")
    return _written(longest.groupBy(*PLACE).agg(F.max(F.struct("n", "more")).alias("m")).select(*PLACE, F.col("m.more").alias("more")), "growth")


def _joined(spans: DataFrame) -> DataFrame:
    """Spans with what they grow by: cut where two of a row would overlap, joined where they meet."""
    order = Window.partitionBy("row").orderBy("start")

    def begins(c: Column) -> Column:
        return F.coalesce(F.regexp_count(c, F.lit(r"(?<=[\x20\x09-\x0D])[^\x20\x09-\x0D]")), F.lit(0))

    def size(c: str) -> Column:
        return F.coalesce(F.length(c) - 1, F.lit(0))

    spans = spans.withColumn("r", F.least(size("right_more"), F.coalesce(F.lead("start").over(order), F.lit(2**31 - 1)) - F.col("end")))
    spans = spans.withColumn("l", F.least(size("left_more"), F.col("start") - F.coalesce(F.lag(F.col("end") + F.col("r")).over(order), F.lit(0))))
    words = F.col("words") + begins(F.substring("right_more", F.lit(1), F.col("r") + 1)) + begins(F.right("left_more", F.col("l") + 1))
    spans = spans.select("row", "no_id", "doc_id", (F.col("start") - F.col("l")).alias("start"), (F.col("end") + F.col("r")).alias("end"), words.alias("words"), "n_chunks", "first", "first_doc_id")
    apart = F.coalesce(F.lag("end").over(order) < F.col("start"), F.lit(True))
    spans = spans.withColumn("apart", apart).withColumn("group", F.count_if("apart").over(order))
    return spans.groupBy("row", "no_id", "doc_id", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.sum("n_chunks").alias("n_chunks"), F.min("first").alias("first"), F.min("first_doc_id").alias("first_doc_id"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 12) -> DataFrame:
    """doc_id, start, length (characters), words, n_chunks, first, first_doc_id: spans that stand elsewhere too."""
    all_chunks = _written(chunks(docs, id_col, text), "chunks")
    spans = _islands(all_chunks).where(F.col("words") + F.col("before") + F.col("after") >= min_words)
    spans = _written(_with_texts(_written(spans, "islands"), all_chunks), "spans")
    growth = _growth(spans, docs, id_col, text)
    for side, at, name in ((0, "start", "left_more"), (1, "end", "right_more")):
        mine = growth.where(F.col("side") == side).select(*TEXT_KEY, F.col("at").alias(at), F.col("more").alias(name))
        spans = spans.join(mine, [*TEXT_KEY, at], "left")
    out = _joined(spans).where(F.col("words") >= min_words)
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), F.col("start").cast("long").alias("start"), (F.col("end") - F.col("start")).cast("long").alias("length"), "words", "n_chunks", "first", "first_doc_id")
