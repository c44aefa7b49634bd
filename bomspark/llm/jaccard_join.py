"""Exact Jaccard self-join of documents on word shingles, reported as components.

Token-combination prefixes, rarest first: the document frequency of every shingle is counted
over all distinct sets, and each set is ordered by it. Two sets whose Jaccard similarity
reaches the threshold share at least two shingles within prefixes that are one longer than
usual. Shingles of one set alone can't be shared, so only the rest of the prefix is indexed,
and a set with fewer than two shared shingles in its prefix has no partner at all. Two sets
share a rare shingle there, indexed singly, or two frequent ones, indexed as a pair. Sets too
large for pairs index frequent shingles singly (sets within reach of the limit do both).

Frequencies are counted in packed form: tasks deal their shingles out over buckets by hash,
a bucket's task counts its shingles and deals those of several sets out over parts by set,
and a part's task selects the prefixes. A bucket holds about ``unit`` shingles whatever the
size of the corpus; the unit grows with its square root, so that what one task sends to one
bucket stays worth a row. Exact copies count once there. A shingle of many sets would fill a bucket with an entry
for each of them. So shingles that are frequent within a chunk of a task are found while sets are made;
they are broadcast with their counts (a bounded number), and go past the buckets to their set's part.
Their frequency class comes from those counts. Any order of shingles that is the same for all sets
gives the same links, so that this changes no result.

Equal sets are one node from the start. Candidates of an index entry are met in rounds: all
against one leader first, again against another leader for what is still in different
components, and last every remaining pair of different components. There only what is outside
an entry's largest component is met with the others, and two sets that share many entries
pass the screen at the least of these keys alone. Each candidate is
screened by size and by a parity bitmap, whose differing bits are at most the differing
shingles, and then verified on the full sets. No pair that could join two components is
left out, and pairs within one component need no test.

Defined results: null, empty and white-space-only texts have no shingles and are their own
component. Texts shorter than a shingle are one shingle of all their words. Rows with a null
id link other rows like any, but have a null component unless a row with an id is in it.
Repeated rows are equal sets. An empty table gives an empty result. Shingles are compared by
64-bit hashes, sets by 128-bit digests; frequencies go by fewer bits, which can only make
more candidates. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side

BITS = 512
LONGS = BITS // 64
BITMAP = [f"b{i}" for i in range(LONGS)]
#: Bits of a shingle hash that stand in a bucket; those above them choose the bucket.
LOW = 40
#: Odd multipliers for the words of a shingle.
ODD = np.random.default_rng(7).integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PACKED = "grp int, bucket int, nodes binary, sizes binary, runs binary, tokens binary, classes binary"
#: Frequency class (eighths of a power of two) from which shingles are frequent: 32 sets.
FREQUENT = 40
#: Shingles of more than LEAST_HEAVY sets of a chunk, and of more than one set in HEAVY, are heavy; a
#: chunk has about CHUNK shingles.
HEAVY, LEAST_HEAVY, CHUNK = 256, 32, 1 << 21
#: A task deals out this share of a bucket's shingles at a time: sorting them takes several times their size,
#: which Python workers keep.
DEALT = 3
#: So many least keys of a set tell in the last round where two sets meet first.
LEAST_KEYS = 16
#: The bucket number that stands for heavy shingles.
ASIDE = (1 << 24) - 1


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text (A-Z lower-cased, ASCII white space)."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = pd.util.hash_array(np.array(tokens, dtype=object), categorize=False)
    k = min(words, len(tokens))
    total = np.full(len(tokens) - k + 1, np.uint64(k if k < words else 0) * ODD[-1], np.uint64)
    for i in range(k):
        total += hashes[i : len(hashes) - k + 1 + i] * ODD[i]
    return np.unique(_scatter(total))


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _heavy(sets: list[np.ndarray]) -> bytes | None:
    """The shingles that are heavy in these different sets, and their numbers of sets."""
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    heavy = counts > max(LEAST_HEAVY, len(sets) // HEAVY)
    return np.stack([tokens[heavy].view(np.int64), counts[heavy]]).tobytes() if heavy.any() else None


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, key, digest and size of every row's set; rows without a size hold the heavy shingles of a chunk."""

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk: dict[bytes, np.ndarray] = {}
        size = 0
        none = pd.DataFrame({"doc_id": pd.Series(dtype=object), "key": pd.Series(dtype="int64"), "node": pd.Series(dtype=object), "n": pd.Series(dtype="int32"), "heavy": pd.Series(dtype=object)})

        def found() -> pd.DataFrame:
            tokens = _heavy(list(chunk.values())) if chunk else None
            chunk.clear()
            return pd.DataFrame({"doc_id": [None], "key": [0], "node": [None], "n": [-1], "heavy": [tokens]}) if tokens else none

        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"]]
            out = pd.DataFrame({"doc_id": batch["doc_id"], "key": batch["key"]})
            out["node"], out["n"], out["heavy"] = [digest(s) for s in sets], [len(s) for s in sets], None
            yield out
            for node, tokens in zip(out["node"], sets, strict=True):
                if len(tokens) and node not in chunk:
                    chunk[node], size = tokens, size + len(tokens)
                if size >= CHUNK:
                    yield found()
                    size = 0
        yield found()

    # ids go through pandas as strings: longs beside nulls would become floats
    found = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(profile, "doc_id string, key long, node binary, n int, heavy binary")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def heavy_shingles(profile: DataFrame, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The heavy shingles of all chunks, sorted, and their frequency classes; of more than ``most`` the most frequent."""

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for packed in batch["heavy"]:
                tokens, counts = np.frombuffer(packed, np.int64).reshape(2, -1)
                yield pd.DataFrame({"token": tokens, "n": counts})

    tokens = profile.where("n < 0").select("heavy").mapInPandas(apart, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = tokens.orderBy(F.desc("n"), "token").limit(most).toPandas()  # 16 MB at most
    found = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.minimum(8 * np.log2(rows["n"].to_numpy(float)[order]), 255).astype(np.uint8)


def _places(tokens: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles are heavy, and their places among the heavy ones."""
    if not len(heavy):
        return np.zeros(len(tokens), bool), np.empty(0, np.uint64)
    at = np.searchsorted(heavy, tokens)
    at[at == len(heavy)] = 0
    held = heavy[at] == tokens
    return held, at[held].astype(np.uint64)


# Packed rows: nodes holds 16 bytes a set, sizes and runs 4 (its size, its shingles here),
# tokens 5 bytes a shingle, set after set, and classes 1.


def _five(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _eight(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests (two longs a set), sizes, runs and shingles of all ``rows``."""
    nodes = np.frombuffer(b"".join(rows["nodes"]), "<u8").reshape(-1, 2)
    sizes, runs = (np.frombuffer(b"".join(rows[c]), "<u4").astype(np.int64) for c in ("sizes", "runs"))
    return nodes, sizes, runs, _eight(b"".join(rows["tokens"]))


def _dealt(groups: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, runs: np.ndarray, tokens: np.ndarray, classes: np.ndarray | None, bucket: int) -> list[tuple]:
    """A packed row for each group of runs; runs come sorted by group."""
    ends = np.concatenate(([0], np.cumsum(runs)))
    borders = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True]))) if len(groups) else [0]
    return [
        (int(groups[i]), bucket, nodes[i:j].tobytes(), sizes[i:j].astype("<u4").tobytes(), runs[i:j].astype("<u4").tobytes(), _five(tokens[ends[i] : ends[j]]), b"" if classes is None else classes[ends[i] : ends[j]].tobytes())
        for i, j in zip(borders[:-1], borders[1:], strict=True)
    ]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["grp", "bucket", "nodes", "sizes", "runs", "tokens", "classes"])


def _bucketed(sets: dict[bytes, np.ndarray], buckets: int, heavy: np.ndarray = np.empty(0, np.uint64)) -> pd.DataFrame:  # noqa: B008
    """Shingles of different sets, but for heavy ones, dealt out over buckets."""
    whole = np.array([len(s) for s in sets.values()])
    tokens, owners = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets)), whole)
    if len(heavy):
        held, _ = _places(tokens, heavy)
        tokens, owners = tokens[~held], owners[~held]
    if not len(tokens):
        return _frame([])
    bucket = ((tokens >> np.uint64(LOW)) * np.uint64(buckets) >> np.uint64(64 - LOW)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, owner = bucket[order], owners[order]
    first = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1]))))
    nodes = np.frombuffer(b"".join(sets), "<u8").reshape(-1, 2)[owner[first]]
    return _frame(_dealt(bucket[first], nodes, whole[owner[first]], np.diff(np.append(first, len(tokens))), (tokens & np.uint64((1 << LOW) - 1))[order], None, 0))


def _aside(sets: dict[bytes, np.ndarray], buckets: int, parts: int, heavy: np.ndarray, classes: np.ndarray) -> pd.DataFrame:
    """The heavy shingles of different sets, as places in ``heavy``, on the way to the sets' parts."""
    sizes = np.array([len(t) for t in sets.values()])
    held, places = _places(np.concatenate(list(sets.values())), heavy)
    owner = np.repeat(np.arange(len(sets)), sizes)[held]
    nodes = np.frombuffer(b"".join(sets), "<u8").reshape(-1, 2)
    part = (nodes[:, 0] % np.uint64(parts)).astype(np.int64)
    order, runs = np.lexsort((owner, part[owner])), np.bincount(owner, minlength=len(sets))
    chosen = np.argsort(part, kind="stable")
    chosen = chosen[runs[chosen] > 0]
    return _frame(_dealt(buckets + part[chosen], nodes[chosen], sizes[chosen], runs[chosen], places[order], classes[places[order].astype(np.int64)], ASIDE) if len(chosen) else [])


def _passed(rows: pd.DataFrame, part: int) -> pd.DataFrame:
    """The heavy shingles of a part's sets, once for each set."""
    nodes, sizes, runs, tokens = _unpacked(rows)
    classes = np.frombuffer(b"".join(rows["classes"]), np.uint8)
    order = np.lexsort((nodes[:, 1], nodes[:, 0]))
    copy = np.zeros(len(nodes), bool)  # sets that several tasks sent
    copy[order[1:]] = (nodes[order[1:]] == nodes[order[:-1]]).all(axis=1)
    kept = np.repeat(~copy, runs)
    return _frame(_dealt(np.full((~copy).sum(), part), nodes[~copy], sizes[~copy], runs[~copy], tokens[kept], classes[kept], ASIDE))


def _shared(rows: pd.DataFrame, bucket: int, parts: int) -> pd.DataFrame:
    """The shingles of a bucket that several sets hold, with their classes, dealt out by set."""
    nodes, sizes, runs, tokens = _unpacked(rows)
    order = np.argsort(nodes[:, 0], kind="stable")
    copy = np.zeros(len(nodes), bool)  # sets that several tasks sent
    copy[order[1:]] = (nodes[order[1:]] == nodes[order[:-1]]).all(axis=1)
    tokens, nodes, sizes, runs = tokens[np.repeat(~copy, runs)], nodes[~copy], sizes[~copy], runs[~copy]
    by_token = np.argsort(tokens)
    first = np.flatnonzero(np.concatenate(([True], np.diff(tokens[by_token]) != 0)))
    counts = np.diff(np.append(first, len(tokens)))
    classes = np.empty(len(tokens), np.uint8)
    classes[by_token] = np.repeat(np.floor(8 * np.log2(counts)), counts)
    owner = np.repeat(np.arange(len(runs)), runs)[classes > 0]
    tokens, classes = tokens[classes > 0], classes[classes > 0]
    part = (nodes[:, 0] % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((owner, part[owner]))
    runs = np.bincount(owner, minlength=len(runs))
    chosen = np.argsort(part, kind="stable")
    chosen = chosen[runs[chosen] > 0]
    return _frame(_dealt(part[chosen], nodes[chosen], sizes[chosen], runs[chosen], tokens[order], classes[order], bucket))


def prefix_length(n: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """Shingles in the prefix of a set of ``n``: n - ceil(n num / den) + 1, and one more for the pairs."""
    return n + num * -n // den + 2


def signatures(tokens: np.ndarray, classes: np.ndarray, n: int, num: int, den: int) -> tuple[np.ndarray, int]:
    """Index keys of a set of ``n`` shingles, given those that other sets hold too, and how
    many of its prefix are rare."""
    alone = n - len(tokens)
    order = np.lexsort((tokens, classes))[: max(0, min(n, prefix_length(n, num, den)) - alone)]
    frequent = classes[order] >= FREQUENT
    rare, common = tokens[order][~frequent], tokens[order][frequent]
    largest = 64 * den // (den - num)
    keys = [rare]
    if n <= largest and len(common) > 1:
        i, j = np.triu_indices(len(common), 1)
        keys.append(_scatter(common[i] * ODD[-2] + common[j] * ODD[-3]))
    if n * den > num * largest:
        keys.append(common)
    return np.concatenate(keys), alone + len(rare)


def _selected(rows: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """node, n, rare, sigs of the sets of a part that can have a partner."""
    nodes, sizes, runs, tokens = _unpacked(rows)
    each = [len(t) // 5 for t in rows["tokens"]]
    tokens |= np.repeat(rows["bucket"].to_numpy(np.uint64), each) << np.uint64(LOW)
    classes = np.frombuffer(b"".join(rows["classes"]), np.uint8)
    ends = np.concatenate(([0], np.cumsum(runs)))
    order = np.lexsort((nodes[:, 1], nodes[:, 0]))
    first = np.flatnonzero(np.concatenate(([True], (nodes[order[1:]] != nodes[order[:-1]]).any(axis=1))))
    n, held = sizes[order[first]], np.add.reduceat(runs[order], first)
    found = []
    for at in np.flatnonzero(np.minimum(n, prefix_length(n, num, den)) - (n - held) >= 2):
        own = order[first[at] : first[at + 1] if at + 1 < len(first) else len(order)]
        where = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in own])
        keys, rare = signatures(tokens[where], classes[where], int(n[at]), num, den)
        found.append((nodes[own[0]].tobytes(), int(n[at]), rare, keys.view(np.int64)))
    return pd.DataFrame(found, columns=["node", "n", "rare", "sigs"])


def set_batches(texts: Iterator[str | None], words: int, most: int) -> Iterator[dict[bytes, np.ndarray]]:
    """The different sets of some texts by digest; a batch ends with the set that brings it to ``most`` shingles."""
    sets, size = {}, 0
    for text in texts:
        tokens = shingle_set(text, words)
        node = digest(tokens)
        if len(tokens) and node not in sets:
            sets[node], size = tokens, size + len(tokens)
        if size >= most:
            yield sets
            sets, size = {}, 0
    if sets:
        yield sets


def prefixes(docs: DataFrame, total: int, words: int, num: int, den: int, heavy: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint8)), least_unit: int = 3 << 20, least_buckets: int = 32) -> DataFrame:  # noqa: B008
    """node, n, rare, sigs of every set that can have a partner; ``total`` counts all shingles."""
    unit = max(least_unit, isqrt(8 * total))
    buckets = max(least_buckets, -(-total // unit))
    parts = max(least_buckets // 2, buckets // 4)

    shared_heavy = docs.sparkSession.sparkContext.broadcast(heavy)  # bounded, see heavy_shingles

    def sent(sets: dict[bytes, np.ndarray]) -> Iterator[pd.DataFrame]:
        tokens, classes = shared_heavy.value
        yield _bucketed(sets, buckets, tokens)
        if len(tokens):
            yield _aside(sets, buckets, parts, tokens, classes)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for sets in set_batches((text for batch in batches for text in batch["text"]), words, unit // DEALT):
            yield from sent(sets)

    def counted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        return _shared(rows, group, parts) if group < buckets else _passed(rows, group - buckets)

    dealt = docs.select("text").mapInPandas(spread, PACKED)
    shared = dealt.groupBy("grp").applyInPandas(counted, PACKED)
    return shared.groupBy("grp").applyInPandas(lambda rows: _selected(rows, num, den), "node binary, n int, rare int, sigs array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """nid, n, tokens and bitmap of ``nodes`` (nid, node, key), made anew from one of the rows of each."""

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, len(batch), 500):  # a bounded number of sets in memory
                part, rows, bitmaps = batch.iloc[at : at + 500], [], []
                for nid, node, text in zip(part["nid"], part["node"], part["text"], strict=True):
                    tokens = shingle_set(text, words)
                    if nid not in seen and digest(tokens) == bytes(node):
                        seen.add(nid)
                        rows.append((nid, len(tokens), tokens.tobytes()))
                        bitmaps.append(np.packbits((np.bincount((tokens & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(bool)))
                out = pd.DataFrame(rows, columns=["nid", "n", "tokens"])
                longs = np.array(bitmaps, np.uint8).reshape(len(rows), BITS // 8).view(np.int64)
                for i, name in enumerate(BITMAP):
                    out[name] = longs[:, i]
                yield out

    schema = "nid long, n int, tokens binary, " + ", ".join(f"{b} long" for b in BITMAP)
    found = materialize(docs.join(small_side(nodes), "key").select("nid", "node", "text").mapInPandas(sets_of, schema), "sets")
    made, wanted = found.count(), nodes.count()
    if made > wanted:  # repeated rows, met by several tasks
        found = materialize(found.dropDuplicates(["nid"]), "distinct-sets")
        made = found.count()
    if made != wanted:
        raise RuntimeError(f"{wanted - made} texts changed between two passes over them")
    return found


def _differing(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in BITMAP])


def _possible(a: str, b: str, num: int, den: int) -> Column:
    """Size and bitmap bounds allow the two sets to reach the threshold."""
    small, large = F.least(f"{a}.n", f"{b}.n").cast("long"), F.greatest(f"{a}.n", f"{b}.n").cast("long")
    return (small * den >= large * num) & (_differing(a, b) * (den + num) <= (small + large) * (den - num))


def _met_first(a: str, b: str) -> Column:
    """No smaller key than ``sig`` is among the least keys of both sets. It holds at the least key that
    they share, and at no other one unless their least keys have none in common."""
    return F.coalesce(F.array_min(F.array_intersect(f"{a}.least", f"{b}.least")) >= F.col("sig"), F.lit(True))


def meetings(entries: DataFrame, light: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of all sets of different components that share a key of ``entries`` (sig, nid, comp) and pass the screen."""
    # of two components at least one is not the entry's largest: that side alone is met with all
    main = entries.groupBy("sig", "comp").agg(F.count("*").alias("c")).groupBy("sig").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    least = entries.groupBy("nid").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, LEAST_KEYS).alias("least"))
    rest = materialize(entries.join(main, "sig").withColumn("minor", F.col("comp") != F.col("main")).drop("main").join(light.join(least, "nid"), "nid"), "rest")
    x, y = (rest.select("sig", F.struct("nid", "comp", "minor", "least", "n", *BITMAP).alias(k)) for k in ("x", "y"))
    apart = (F.col("x.comp") < F.col("y.comp")) | (~F.col("y.minor") & (F.col("x.comp") != F.col("y.comp")))
    pairs = x.where("x.minor").join(y, "sig").where(apart & _possible("x", "y", num, den) & _met_first("x", "y"))
    return pairs.select(F.least("x.nid", "y.nid").alias("a"), F.greatest("x.nid", "y.nid").alias("b"))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    a, b = (sets.select(F.col("nid").alias(k), F.col("tokens").alias(f"{k}t")) for k in ("a", "b"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["at"], batch["bt"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return materialize(materialize(pairs, "pairs").join(b, "b").join(a, "a").mapInPandas(verify, "a long, b long"), "links")


def components(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(nid, comp) of every linked node, comp the least node of its component: large-star and
    small-star steps in turn, until every node points at its component's least. Their number
    grows with the logarithm of a component's size; an error says so if they don't end."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
        if now == before:
            return edges.select(F.col("u").alias("nid"), F.col("v").alias("comp"))
        before = now
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")


def similar_components(docs: DataFrame, words: int = 3, threshold: tuple[int, int] = (90, 100), id_col: str = "doc_id", text: str = "text", leader_rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; threshold is a fraction (numerator, denominator)."""
    num, den = threshold
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    measured = materialize(profiles(docs, words), "profiles")
    profile = measured.where("n >= 0").drop("heavy")
    nodes = materialize(profile.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least_doc"), F.min("key").alias("key"), F.first("n").alias("n")).withColumn("nid", F.monotonically_increasing_id()), "nodes")
    total = nodes.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0

    able = materialize(prefixes(docs, total, words, num, den, heavy_shingles(measured)).join(nodes.select("node", "nid", "key"), "node"), "prefixes")
    sets = full_sets(docs, able.select("nid", "node", "key"), words)
    light = sets.select("nid", "n", *BITMAP)
    entries = able.select(F.explode("sigs").alias("sig"), "nid", "n", "rare")
    listed = entries.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select("sig")
    active = materialize(entries.join(listed, "sig"), "index")

    links = None
    for turn in range(leader_rounds + 1):
        if links is None:
            here = active.withColumn("comp", F.col("nid"))
        else:
            here = active.join(components(links), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
        lists = here.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct((F.col("rare") if turn == 0 else F.xxhash64(F.lit(turn), "nid")).alias("o"), "nid", "n", "comp")).alias("leader")).where("lo < hi")
        if turn < leader_rounds:
            sizes = (F.least("n", "leader.n") * den >= F.greatest("n", "leader.n") * num) & (F.col("comp") != F.col("leader.comp"))
            pairs = materialize(here.join(lists, "sig").where(sizes).select(F.col("nid").alias("a"), F.col("leader.nid").alias("b")).distinct(), "candidates")
            x, y = (light.select(F.col("nid").alias(k), F.struct("n", *BITMAP).alias(f"{k}x")) for k in ("a", "b"))
            met = pairs.join(x, "a").join(y, "b").where(_possible("ax", "bx", num, den))
            # one leader for each follower: later rounds and the last one see to the others
            found = verified(met.groupBy("a").agg(F.min_by("b", F.xxhash64(F.lit(turn), "b")).alias("b")), sets, num, den)
        else:
            pairs = meetings(materialize(here.join(lists.select("sig"), "sig").select("sig", "nid", "comp"), "open"), light, num, den)
            found = verified(pairs.distinct(), sets, num, den)
        links = found if links is None else links.unionByName(found)
    named = nodes.select("nid", "node", "least_doc").join(components(links), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    least = named.groupBy("comp").agg(F.min("least_doc").alias("component_id"))
    by_node = materialize(named.join(least, "comp").select("node", "component_id"), "components")
    out = profile.where("n > 0").join(by_node, "node").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return out.unionByName(profile.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
