import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bomspark.llm.common import LOWER, UPPER
from bomspark.llm.decontaminate import Scanner, contamination, normalised, places, scan_documents, united, windows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate(str.maketrans(UPPER, LOWER)))


def brute(docs, items, size=10):
    cut = [("" if i is None else str(i), w[a : a + size]) for i, t in items for w in [words_of(t)] if w for a in range(max(1, len(w) - size + 1))]
    out = []
    for i, text in docs:
        words, hit, names = words_of(text), set(), set()
        for item, window in cut:
            for a in range(len(words) - len(window) + 1):
                if words[a : a + len(window)] == window:
                    hit |= set(range(a, a + len(window)))
                    names.add(item)
        out.append((i, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def made(seed):
    rnd = random.Random(seed)
    vocabulary = ["ab", "abc", "b", "ñandú", "9", "x9", "日本", "\x85", "á"]
    text = lambda n: "".join(rnd.choice(vocabulary if rnd.random() < 0.9 else ["Ab", "B"]) + rnd.choice([" ", "  ", ", ", "-", "\n", "\x00", "_"]) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 4, 11, 30]))) for i in range(12)] + [(None, text(12)), (None, text(3)), (3, text(15)), (40, None), (41, " -- ")]
    docs = [(i, text(rnd.randint(0, 60)) + (rnd.choice(items)[1] or "").upper() + text(5)) for i in range(50)] + [(90, None), (91, ""), (None, items[2][1]), (4, "ab"), (4, "ab")]
    return docs, items


@pytest.mark.parametrize("seed, max_chars", [(0, 4_000_000), (1, 4_000_000), (2, 400), (3, 60)])
def test_query_against_brute_force_with_one_and_several_automata(spark, seed, max_chars):
    docs, items = made(seed)
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, items string").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    for size in (3, 10):
        assert sorted((tuple(r) for r in contamination(d, b, size=size, max_chars=max_chars).collect()), key=repr) == brute(docs, items, size)


def test_spans_are_places_in_the_original_text(spark):
    body = "Intro. The QUICK, brown–fox (jumps) over! rest the quick brown"
    d = spark.createDataFrame([(1, body)], "doc_id long, text string")
    b = spark.createDataFrame([("q", "the quick brown–fox jumps")], "item_id string, text string")
    row = scan_documents(d, b, size=4).first()
    assert [body[s.start : s.end] for s in row.spans] == ["The QUICK, brown–fox (jumps"] and [(s.first, s.last) for s in row.spans] == [(1, 5)] and row["items"] == ["q"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aB ñ", max_size=14), max_size=5), st.text(alphabet="aB ñ", max_size=40), st.integers(1, 4))
def test_scanner_equals_sliding_windows(items, text, size):
    patterns = {}
    for i, item in enumerate(items):
        for w in windows(normalised(item), size):
            patterns.setdefault(w, []).append(str(i))
    n, ranges, found = Scanner(list(patterns.items())).scan(text)
    (_, n_words, n_hit, n_items, _, _), = brute([(0, text)], list(enumerate(items)), size)
    assert (n, sum(b - a for a, b in ranges), len(found)) == (n_words, n_hit, n_items)
    assert all(words_of(text[s:e]) == words_of(text)[a:b] for a, b, s, e in places(text, ranges))


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6)), max_size=12))
def test_united_ranges(raw):
    ranges = [(a, a + n, 10 * a, 10 * (a + n)) for a, n in raw]
    out = united(ranges)
    covered = {i for a, b, *_ in ranges for i in range(a, b)}
    assert {i for a, b, *_ in out for i in range(a, b)} == covered and all(x[1] < y[0] for x, y in zip(out, out[1:], strict=False))
    assert all((s, e) == (10 * a, 10 * b) for a, b, s, e in out)


def test_long_text_and_dense_hits():
    item = " ".join(f"w{i % 7}" for i in range(40))
    scanner = Scanner([(w, ["1"]) for w in windows(normalised(item), 10)])
    text = "start " + " ".join(f"w{i % 7}" for i in range(300_000)) + " end"
    n, ranges, _ = scanner.scan(text)
    assert n == 300_002 and ranges == [(1, 300_001)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("i", "a b")], "item_id string, text string")
    assert [tuple(r)[:4] for r in contamination(docs, items.limit(0)).collect()] == [(1, 2, 0, 0)]
    assert contamination(docs.limit(0), items).collect() == []
