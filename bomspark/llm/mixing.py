"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents form one stream of words, cut into blocks of fixed length. A source
gets as many block slots as its target needs. Every output shard draws its counts of slots
per source from one multinomial distribution, in which a source weighs as much as all its
slots; running sums over the shards number each source's slots. So that totals hold, slots
drawn beyond a source's need are void, and slots still missing go to shards at random. Slot ``t`` of a source is position ``t mod n`` of pass
``t div n`` over its ``n`` blocks; a pseudorandom permutation of the block indexes per source
and pass (swap-or-not rounds, no state) maps positions to blocks, and blocks join documents
by index. The last slot is cut to the words still missing, so totals hold to the word.

Defined results: null texts have no words and are never taken; null sources form a source
of their own, ordered last; a source without words has target 0. Repeated rows with one id
are separate documents in the stream, and so are rows without an id; taken words are reported
and texts are cut row by row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

ROUNDS = 24
ROW = "__row"


@dataclass(frozen=True)
class Mix:
    sources: DataFrame  #: src, source_size, target, blocks, passes, need, slots
    shards: DataFrame  #: shard, src, first, count: slots first to first + count - 1 of the source
    docs: DataFrame  #: row, doc_id, src, size, source_size, target
    spans: DataFrame  #: shard, src, slot, block, row, doc_id, start, words: what the mix takes
    texts: DataFrame | None  #: row and all columns of the documents, if texts are wanted


def targets(sources: DataFrame, weights: Sequence[int], most: float) -> DataFrame:
    """``sources`` (src, source_size) with target: weights repeat in source order, a source's
    target stops at ``most`` times its size, the excess is shared again by weight.

    Sorted by cap over weight, a source is capped exactly if the total covers all caps up to
    its own and its level of the rest; one pass of running sums finds the final level."""
    in_order = Window.orderBy("src")
    by_level = Window.orderBy("level", "src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)).withColumn("level", F.col("cap") / F.col("weight"))
    s = s.withColumn("caps", F.sum("cap").over(by_level)).withColumn("after", F.sum("weight").over(everything) - F.sum("weight").over(by_level)).withColumn("all_words", F.sum("source_size").over(everything))
    s = s.withColumn("capped", F.col("caps") + F.col("level") * F.col("after") <= F.col("all_words"))
    taken = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    rest = F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything), F.lit(1.0))
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", (F.col("all_words") - taken) / rest * F.col("weight")))).select("src", "source_size", "target")


def permuted(x: Column, n: Column, seed: int, *key: Column, back: bool = False) -> Column:
    """x mapped through a pseudorandom permutation of 0..n-1 that seed and key choose."""
    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)

    def step(acc: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), r, *key), n) - acc, n)
        swap = F.xxhash64(F.lit(seed + 1), r, F.greatest(acc, partner), *key).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(r) for r in rounds]), x.cast("long"), step)


def shard_counts(sources: DataFrame, n_slots: int, per_shard: int, seed: int, cells: int = 4096) -> DataFrame:
    """shard, src, first, count. Each shard draws ``per_shard`` slots, each of which is a source's
    with the chance of its share of all ``n_slots``; draws find their source through cells of
    equal width, of which a source's range covers some."""
    n_shards, width = max(1, -(-n_slots // per_shard)), max(1, -(-n_slots // cells))
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = sources.where("slots > 0").select("src", "slots", F.sum("slots").over(upto).alias("high")).withColumn("low", F.col("high") - F.col("slots"))
    cell = lambda x: F.floor(x / F.lit(width))
    ranges = ranges.select("src", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    draws = sources.sparkSession.range(0, n_shards, 1, max(1, min(20_000, n_shards // 4))).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(per_shard - 1))).alias("draw"))
    draws = draws.withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "shard", "draw"), F.lit(max(1, n_slots)))).withColumn("cell", cell(F.col("at")))
    # draws are made from few rows, whose size says nothing about theirs: no broadcast
    drawn = draws.hint("merge").join(ranges, "cell").where("low <= at AND at < high").groupBy("shard", "src").agg(F.count("*").alias("count"))
    before = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = materialize(drawn.withColumn("first", F.sum("count").over(before) - F.col("count")), "drawn")
    wanted = sources.select("src", "slots")
    used = drawn.join(wanted, "src").withColumn("count", F.least("count", F.col("slots") - F.col("first"))).where("count > 0")
    missing = wanted.join(drawn.groupBy("src").agg(F.sum("count").alias("had")), "src", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("slots > had")
    missing = missing.select("src", F.explode(F.sequence("had", F.col("slots") - 1)).alias("first")).select(F.pmod(F.xxhash64(F.lit(seed + 1), "src", "first"), F.lit(n_shards)).alias("shard"), "src", "first", F.lit(1).cast("long").alias("count"))
    return used.select("shard", "src", "first", "count").unionByName(missing)


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: float = 3.0, block_words: int = 512, shard_slots: int = 4096, seed: int = 17, id_col: str = "doc_id", text: str = "text", source: str = "source", with_texts: bool = True) -> Mix:
    """The mix of ``docs``; ``with_texts`` writes them once under their row keys, as mixed_texts needs them."""
    src = F.coalesce(F.concat(F.lit("+"), F.col(source)), F.lit("~"))  # null sorts last
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    texts = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "texts", "zstd") if with_texts else None
    row = F.monotonically_increasing_id() if texts is None else F.col(ROW)
    slim = materialize((docs if texts is None else texts).select(F.col(id_col).cast("long").alias("doc_id"), src.alias("src"), size.alias("size"), row.alias("row"), F.xxhash64(text).alias("same")), "sizes")
    # Two levels of running sums: within buckets of about the square root of all rows, then over buckets.
    n = slim.count()
    buckets = max(1, round(n / max(512, n**0.5)))
    slim = slim.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "same"), F.lit(buckets)))  # also rows without id are spread
    per_bucket = slim.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
    length = F.lit(block_words)
    sources = targets(per_bucket.groupBy("src").agg(F.sum("words").alias("source_size")), weights, most).withColumn("target", F.col("target") * share)
    sources = (
        sources.withColumn("blocks", F.ceil(F.col("source_size") / length))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("need", F.round(F.col("target")).cast("long") - F.col("passes") * F.col("source_size"))
        # where the last, shorter block stands in the last pass
        .withColumn("short", F.when(F.col("blocks") > 0, permuted(F.col("blocks") - 1, F.col("blocks"), seed, F.col("src"), F.col("passes"), back=True)))
        .withColumn("lacks", F.col("blocks") * length - F.col("source_size"))
    )
    past_short = F.col("need") > (F.col("short") + 1) * length - F.col("lacks")
    sources = materialize(sources.withColumn("slots", F.col("passes") * F.col("blocks") + F.coalesce(F.ceil((F.col("need") + F.when(past_short, F.col("lacks")).otherwise(0)) / length), F.lit(0))), "sources")
    placed = per_bucket.join(sources.select("src", "source_size", "target"), "src").select("src", "bucket", "base", "source_size", "target")
    within = Window.partitionBy("src", "bucket").orderBy("doc_id", "size", "same", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = materialize(slim.join(placed, ["src", "bucket"]).withColumn("begin", F.col("base") + F.sum("size").over(within) - F.col("size")).drop("base", "bucket", "same"), "placed")

    n_slots = sources.agg(F.sum("slots")).first()[0] or 0
    shards = materialize(shard_counts(sources, n_slots, max(shard_slots, isqrt(n_slots)), seed + 2), "shards")
    # slots are many times the rows that they come from: a fixed number of partitions
    slots = shards.join(sources, "src").repartition(max(1, min(20_000, -(-n_slots // 16_384))), "shard", "src", "first")
    slots = slots.withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)))
    slots = slots.withColumn("pass", F.floor(F.col("slot") / F.col("blocks"))).withColumn("at", F.col("slot") - F.col("pass") * F.col("blocks"))
    slots = slots.withColumn("block", permuted(F.col("at"), F.col("blocks"), seed, F.col("src"), F.col("pass")))
    ahead = F.col("at") * length - F.when(F.col("at") > F.col("short"), F.col("lacks")).otherwise(0)
    slots = slots.withColumn("limit", F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(F.col("need") - ahead, length)).cast("long"))
    slots = slots.select("shard", "src", "slot", "block", "limit")

    parts = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / length), F.floor((F.col("begin") + F.col("size") - 1) / length))))
    inside = F.col("block") * length
    parts = parts.withColumn("low", F.greatest(F.col("begin") - inside, F.lit(0).cast("long"))).withColumn("high", F.least(F.col("begin") + F.col("size") - inside, length.cast("long")))
    # slots are made after their shuffle, whose size says nothing about theirs: no broadcast
    spans = parts.join(slots.hint("merge"), ["src", "block"]).withColumn("words", F.least("high", "limit") - F.col("low")).where("words > 0")
    spans = spans.select("shard", "src", "slot", "block", "row", "doc_id", (inside + F.col("low") - F.col("begin")).alias("start"), "words")
    return Mix(sources, shards, rows.select("row", "doc_id", "src", "size", "source_size", "target"), spans, texts)


def taken_words(m: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    taken = m.spans.groupBy("row").agg(F.sum("words").alias("taken"))
    return m.docs.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, m: Mix, text: str = "text") -> DataFrame:
    """``docs`` as the mix takes them: the taken words of each pass over a document on a line of
    its own (a whole pass is the text as it is); documents of which nothing is taken go."""
    passes = m.spans.join(m.sources.select("src", "blocks"), "src").withColumn("pass", F.floor(F.col("slot") / F.col("blocks")))
    takes = passes.groupBy("row", "pass").agg(F.sort_array(F.collect_list(F.struct("start", "words"))).alias("parts"), F.sum("words").alias("words"))
    takes = takes.groupBy(F.col("row").alias(ROW)).agg(F.sort_array(F.collect_list(F.struct("pass", "words", "parts"))).alias("__takes"))
    joined = m.texts.join(takes, ROW)
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    joined = joined.withColumn("__words", words)
    pieces = F.transform("__takes", lambda t: F.when(t["words"] == F.size("__words"), F.col(text)).otherwise(F.array_join(F.flatten(F.transform(t["parts"], lambda p: F.slice("__words", p["start"].cast("int") + 1, p["words"].cast("int")))), " ")))
    return joined.withColumn(text, F.array_join(pieces, "\n")).select(*docs.columns)
