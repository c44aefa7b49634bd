import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bomspark.llm import spelling
from bomspark.llm.common import UPPER
from bomspark.llm.spelling import near_pairs, spelling_variants, word_counts, words_of

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows, least=7, least_n=2):
    seen = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c in UPPER else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += len(run) >= least
    return {w: n for w, n in seen.items() if n >= least_n}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=7, times=10):
    n = counted(rows, least)
    out = {}
    for w in n:
        close = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        form = close[0] if close and n[close[0]] >= times * n[w] else None
        out[w] = (form, n[w], len(close), n[form] if form else None)
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return sorted((w, f, root(w), a, b, c) for w, (f, a, b, c) in out.items())


def got(df, **options):
    return sorted((tuple(r) for r in spelling_variants(df, **options).collect()), key=lambda r: r[0])


@pytest.mark.parametrize("seed", range(3))
def test_query_against_brute_force(spark, seed):
    import random

    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abàÿc") for _ in range(rnd.randint(6, 8))) for _ in range(25)]
    rows = []
    for i in range(160):
        words = []
        for _ in range(40):
            w = stems[min(int(rnd.expovariate(0.4)), 24)]
            if rnd.random() < 0.1:
                at = rnd.randrange(len(w) + 1)
                w = rnd.choice([w[:at] + rnd.choice("abcà") + w[at:], w[:at] + w[at + 1 :], w[:at] + rnd.choice("xyz") + w[at + 1 :]])
            words.append(w.upper() if rnd.random() < 0.2 else w)
        rows.append((i, rnd.choice([" ", ", ", "\n"]).join(words)))
    rows += [(500, None), (501, ""), (None, " ".join(stems[:4] * 3)), (3, rows[3][1]), (3, rows[3][1]), (502, "x" * 2000), (503, "x" * 2000 + " y"), (504, "x" * 2001)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, word string").repartition(6)
    want = brute(rows)
    assert got(df) == want and any(r[1] for r in want)
    assert got(df, times=2) == brute(rows, times=2)


def test_chains_of_forms_lead_to_the_last(spark):
    words, n = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb", "abbbbbb"], 1
    rows = [(w, 2 * 3**i) for i, w in enumerate(words)]
    found = spelling.with_roots(spelling.forms(spark.createDataFrame(rows, "word string, n long"), 3)).collect()
    assert {r.word: r.root for r in found} == dict.fromkeys(words, words[-1])
    assert {r.word: r.form for r in found} == dict(zip(words, [*words[1:], None], strict=True))


def test_counts_do_not_depend_on_when_tasks_hand_them_on(spark, monkeypatch):
    rows = [(i, " ".join(f"wordnumber{'abcdefghij'[(i * 7 + j) % 10]}" for j in range(30))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(spelling, "FLUSH", 3)
    assert {r.word: r.n for r in word_counts(df).collect()} == counted(rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAzZÀÿ×ñÑ .-ßĀ¿", max_size=60), st.one_of(st.none(), st.integers(-5, 99)))
def test_runs_and_deletions(text, doc_id):
    assert {w.decode(): n for w, n in Counter(words_of(doc_id, text, 2)).items()} == counted([(doc_id, text)], 2, 1)


def test_each_pair_comes_once(spark):
    import itertools

    words = ["".join(w) for k in (3, 4, 5) for w in itertools.product("ab", repeat=k)] + ["é" * 4, "é" * 5, "éeéé"]
    found = Counter((r.a, r.b) for r in near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect())
    assert set(found.values()) == {1} and set(found) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_long_words_meet_by_digest(spark):
    import random

    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdé") for _ in range(3000))
    words = [base, base[:1500] + "x" + base[1501:], base[1:], base[:-1], base + "a", base[:64], base[:63], base[:65], base[1:65], base[:30] + "q" + base[31:64], base[:64] + "q"]
    found = Counter(tuple(sorted((r.a, r.b))) for r in near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect())
    assert set(found.values()) == {1} and set(found) == {tuple(sorted((a, b))) for a in words for b in words if a < b and near(a, b)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert got(empty) == [] and got(spark.createDataFrame([(1, None), (2, "short words")], "doc_id long, text string")) == []
    assert near_pairs(spark.createDataFrame([], "word string, n long")).agg(F.count("*")).first()[0] == 0
