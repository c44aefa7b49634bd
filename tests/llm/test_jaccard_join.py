import re
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bomspark.llm.jaccard_join import _bucketed, _selected, _shared, components, digest, prefix_length, signatures, similar_components


def brute(rows, words, threshold):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[doc] = {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and Fraction(len(x & y), len(x | y)) >= threshold:
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rng, first, n, length, edits):
    base = [f"w{v}" for v in rng.integers(0, 500, length)]
    for i in range(n):
        text = list(base)
        for at in rng.integers(0, length, rng.integers(0, edits + 1)):
            text[at] = f"x{rng.integers(0, 10**6)}"
        yield first + i, " ".join(text)


@pytest.mark.parametrize("words, threshold, rounds", [(3, (90, 100), 2), (5, (80, 100), 1), (3, (90, 100), 0)])
def test_components_equal_brute_force(spark, words, threshold, rounds):
    rng = np.random.default_rng(words)
    rows = [*near_copies(rng, 1000, 90, 120, 5), *near_copies(rng, 2000, 40, 60, 3), *near_copies(rng, 3000, 12, 900, 30), *near_copies(rng, 4000, 30, 30, 1), *near_copies(rng, 5000, 8, 2500, 60)]
    rows += [(i, " ".join(f"w{v}" for v in rng.integers(0, 500, 80))) for i in range(60)]
    rows += [(7000, None), (7001, ""), (7002, " \n"), (7003, "One"), (7004, "one"), (7005, "one two"), (7006, "ONE\ttwo"), (7007, "é É x"), (7008, "é é x"), (7009, rows[0][1].upper())]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(docs, words, threshold, leader_rounds=rounds).collect()}
    assert got == brute(rows, words, Fraction(*threshold))


@pytest.mark.parametrize("seed", range(20))
def test_similar_sets_share_a_key(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 900))
    x = np.unique(rng.integers(0, 1 << 46, n).astype(np.uint64))
    keep = -(-len(x) * 9 // 10)
    y = np.sort(rng.permutation(x)[:keep])  # the least similar that still counts
    classes = rng.integers(8, 80, len(x)).astype(np.uint8)
    alone = ~np.isin(x, y) & (rng.random(len(x)) < 0.5)
    a, _ = signatures(x[~alone], classes[~alone], len(x), 90, 100)
    b, _ = signatures(y, classes[np.isin(x, y)], len(y), 90, 100)
    assert set(a.tolist()) & set(b.tolist())


def test_buckets_and_parts_give_each_set_its_shared_shingles():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(common, 60), rng.integers(0, 1 << 63, 5).astype(np.uint64)))) for _ in range(50)]
    sets.append(np.unique(rng.integers(0, 1 << 63, 30).astype(np.uint64)))
    tasks = [sets[:20], sets[15:40], sets[38:]]  # some sets are sent twice
    dealt = pd.concat([_bucketed({digest(s): s for s in task}, 16) for task in tasks])
    shared = pd.concat([_shared(rows, bucket, 5) for bucket, rows in dealt.groupby("grp")])
    got = {r.node: r for _, rows in shared.groupby("grp") for r in _selected(rows, 80, 100).itertuples()}
    token, counts = np.unique(np.concatenate(list({digest(s): s for s in sets}.values())), return_counts=True)
    for s in sets:
        held = np.isin(s, token[counts > 1]).sum()
        able = min(len(s), prefix_length(len(s), 80, 100)) - (len(s) - held) >= 2
        assert (digest(s) in got) == able
        assert not able or got[digest(s)].n == len(s)
    assert digest(sets[-1]) not in got and got


def largest_group(sets, heavy, classes):
    """Entries of the largest group of a bucket, and of the largest of a part."""
    from bomspark.llm.jaccard_join import _aside, _unpacked

    sent = {digest(s): s for s in sets}
    light = _bucketed(sent, 32, heavy)
    aside = _aside(sent, 32, 16, heavy, classes) if len(heavy) else light.iloc[:0]
    count = lambda rows: max((len(_unpacked(g)[3]) for _, g in rows.groupby("grp")), default=0)
    return count(light), count(aside)


def test_a_shingle_of_every_set_does_not_fill_a_bucket(spark, monkeypatch):
    from bomspark.llm import jaccard_join as jj

    monkeypatch.setattr(jj, "CHUNK", 6000)
    rng = np.random.default_rng(9)
    common = np.uint64(12345)
    made = lambda n: [np.unique(np.append(rng.integers(0, 1 << 63, 30).astype(np.uint64), common)) for _ in range(n)]
    few, many = made(2000), made(20000)
    packed = jj._heavy(many[:200])
    heavy, counts = np.frombuffer(packed, np.int64).reshape(2, -1)
    assert heavy.tolist() == [12345] and counts.tolist() == [200]
    heavy, classes = heavy.view(np.uint64), np.array([200], np.uint8)
    per_set = lambda sets: [x / len(sets) for x in largest_group(sets, heavy, classes)]
    none = np.empty(0, np.uint64)
    assert largest_group(many, none, none)[0] > 20_000  # without: an entry of each set
    assert largest_group(many, heavy, classes)[0] < 1.5 * 20000 * 30 / 16  # with: an even share of the half of the buckets that these hashes meet
    assert per_set(many)[1] < 1.5 / 16 and per_set(few)[1] < 1.5 / 16


@pytest.mark.parametrize("chunk", [3000, 1 << 21])
def test_heavy_shingles_change_no_component(spark, monkeypatch, chunk):
    from bomspark.llm import jaccard_join as jj

    monkeypatch.setattr(jj, "CHUNK", chunk)
    monkeypatch.setattr(jj, "LEAST_HEAVY", 3)
    rng = np.random.default_rng(5)
    line = " ".join(f"licence{i}" for i in range(25))
    rows = [*near_copies(rng, 1000, 120, 70, 4), *near_copies(rng, 2000, 60, 40, 2)]
    rows = [(i, f"{t} {line}") for i, t in rows] + [(i, f"{line} " + " ".join(f"w{v}" for v in rng.integers(0, 900, rng.integers(1, 60)))) for i in range(150)] + [(5000 + i, line) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    measured = jj.profiles(docs.withColumn("key", F.xxhash64("text")), 3)
    tokens, classes = jj.heavy_shingles(measured)
    assert len(tokens) >= 23 and (np.diff(tokens.astype(object)) > 0).all() and classes.max() > 40
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(docs).collect()}
    assert got == brute(rows, 3, Fraction(90, 100))


def test_sets_of_many_shared_keys_meet_once(spark):
    from bomspark.llm import jaccard_join as jj

    rng = np.random.default_rng(11)
    keys = {nid: set(rng.choice(400, 250, replace=False).tolist()) for nid in range(40)}
    keys |= {40: {1000}, 41: {1000, *range(2000, 2020)}, 42: {1001}}  # few keys, beyond the least ones of 41
    comp = {nid: 0 if nid < 30 else nid for nid in keys}
    entries = spark.createDataFrame([(s if s < 2000 else s - 4000, nid, comp[nid]) for nid in keys for s in keys[nid]], "sig long, nid long, comp long")
    light = spark.createDataFrame([(nid, 100, *[0] * jj.LONGS) for nid in keys], "nid long, n int, " + ", ".join(f"{b} long" for b in jj.BITMAP))
    got = [(r.a, r.b) for r in jj.meetings(entries, light, 90, 100).collect()]
    wanted = {(a, b) for a in keys for b in keys if a < b and comp[a] != comp[b] and keys[a] & keys[b]}
    assert set(got) == wanted and (40, 41) in wanted
    assert len(got) < 1.1 * len(wanted)  # one row for each shared key before: about 150 a pair


def test_sets_are_dealt_out_in_small_batches():
    import tracemalloc

    from bomspark.llm import jaccard_join as jj

    texts = [" ".join(f"w{v}" for v in np.random.default_rng(i % 90).integers(0, 500, 60)) for i in range(100)]
    batches = list(jj.set_batches(iter(texts), 3, 500))
    assert all(sum(map(len, b.values())) < 500 + 58 for b in batches) and len(batches) > 8
    assert {k for b in batches for k in b} == {digest(jj.shingle_set(t, 3)) for t in texts}
    unit = 3 << 20
    rng = np.random.default_rng(1)
    sets = {digest(s): s for s in (np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64)) for _ in range(unit // jj.DEALT // 1000))}
    tracemalloc.start()
    jj._bucketed(sets, 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6  # a whole unit at once, as before: three times as much


def test_components_of_a_long_chain_and_a_limit(spark):
    chain = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r.comp for r in components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(chain, most_rounds=2)


def test_a_row_without_id_links_others(spark):
    base = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(base)), (None, " ".join(base[6:])), (2, " ".join(base[12:]))], "doc_id long, text string")
    assert [r.component_id for r in similar_components(docs, 3, (95, 100)).collect()] == [1, 1, 1]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "q r s t"), (None, "a b c d"), (None, "u v w"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in similar_components(docs).collect())
    assert got == [(0, 0, 0), (0, 1, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1), (1, 2, 1)]
    assert similar_components(docs.limit(0)).count() == 0


def test_large_ids_beside_null_ones_stay_exact(spark):
    big = (1 << 63) - 1
    docs = spark.createDataFrame([(big, "a b c d"), (None, "e f g h"), (big - 1, "i j k l"), (-(1 << 63), "m n o p")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in similar_components(docs).collect()} == {i: i for i in (big, None, big - 1, -(1 << 63))}
