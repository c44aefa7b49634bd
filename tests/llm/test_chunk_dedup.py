import numpy as np

from bomspark.llm.chunk_dedup import GEAR, borders, gear, repeated_spans


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), rng.integers(2, 10))) for _ in range(n))


def test_gear_equals_the_recurrence():
    data = np.random.default_rng(1).integers(0, 256, 300, dtype=np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(GEAR[b])) & 0xFFFF
        want.append(h)
    assert gear(data).tolist() == want
    assert gear(data[:1]).tolist() == [int(GEAR[data[0]])]


def test_borders_cover_the_text_and_resist_insertions():
    raw = words(np.random.default_rng(2), 400).encode()
    ends = borders(np.frombuffer(raw, np.uint8))
    assert ends[-1] == len(raw) and (np.diff(ends) > 0).all()
    assert all(raw[a:b].decode() is not None for a, b in zip([0, *ends[:-1]], ends))  # no split character

    def cut(x):
        e = borders(np.frombuffer(x, np.uint8)).tolist()
        return {x[a:b] for a, b in zip([0, *e[:-1]], e)}

    assert len(cut(raw) & cut(b"inserted " + raw)) > 0.9 * len(cut(raw))


def test_planted_passages_are_found_and_others_left(spark):
    rng = np.random.default_rng(5)
    passage = words(rng, 60)
    rows = [(i, words(rng, 150), "x") for i in range(40)] + [(100 + i, f"{words(rng, 80)} {passage} {words(rng, 50)}", "x") for i in range(4)]
    rows += [(200, None, "x"), (201, "", "x"), (202, "  \n", "x"), (None, passage, "x"), (203, "a" * 5000, "x")]
    got = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string, digest string")).collect()
    assert {r.doc_id for r in got if r.doc_id != 203} == {100, 101, 102, 103, None}
    text = dict((r[0], r[1]) for r in rows)
    for r in got:
        if r.doc_id != 203:
            span = text[r.doc_id][r.start : r.start + r.length]
            assert passage in span and len(span) <= len(passage) + 6  # whole, and little more than chance agrees on
    assert {r.doc_id for r in got if r.first and r.doc_id != 203} == {100} and {r.first_doc_id for r in got if r.doc_id is None} == {100}


def brute(rows, min_words):
    """Spans by a plain count of all chunks and plain comparisons of texts, for rows in table order."""
    where, cut = {}, []
    for row, (doc, text) in enumerate(rows):
        text = text or ""
        raw, at, mine = text.encode(), 0, []
        for end in borders(np.frombuffer(raw, np.uint8)).tolist():
            start = len(raw[:at].decode())
            where.setdefault(raw[at:end], []).append((doc is None, doc or 0, row, start))
            mine.append((start, start + len(raw[at:end].decode()), raw[at:end]))
            at = end
        cut.append((doc, text, mine))

    def heads(row, a, b):
        t = cut[row][1]
        return sum(not t[j].isspace() and (j == 0 or t[j - 1].isspace()) for j in range(a, b))

    islands = []
    for row, (doc, text, mine) in enumerate(cut):
        run = []
        for i in range(len(mine) + 1):
            if i < len(mine) and len(where[mine[i][2]]) > 1:
                run.append(i)
            elif run:
                lo, hi = run[0], run[-1]
                ones = [min(where[mine[j][2]]) for j in run]
                if heads(row, mine[max(lo - 1, 0)][0], mine[min(hi + 1, len(mine) - 1)][1]) >= min_words:
                    left = (ones[0][2], ones[0][3])
                    right = (ones[-1][2], ones[-1][3] + mine[hi][1] - mine[hi][0])
                    first = all(o[2:] == (row, mine[j][0]) for o, j in zip(ones, run))
                    islands.append([row, mine[lo][0], mine[hi][1], len(run), first, min((o[1] for o in ones if not o[0]), default=None), left, right])
                run = []
    more = {}
    for row, a, b, _, _, _, left, right in islands:
        for step, at, (row2, at2) in ((-1, a, left), (1, b, right)):
            t, u, n = cut[row][1], cut[row2][1], 0
            if (cut[row][0], t, at) == (cut[row2][0], u, at2):
                continue
            i, j = (at - 1, at2 - 1) if step < 0 else (at, at2)
            while n < 160 and 0 <= i < len(t) and 0 <= j < len(u) and t[i] == u[j]:
                n, i, j = n + 1, i + step, j + step
            for r, p in ((row, at), (row2, at2)):
                key = (cut[r][0], cut[r][1], step, p)
                more[key] = max(more.get(key, 0), n)
    out, last = [], None
    for k, (row, a, b, n, first, first_doc, _, _) in enumerate(islands):
        doc, text = cut[row][:2]
        after = islands[k + 1][1] if k + 1 < len(islands) and islands[k + 1][0] == row else len(text)
        floor = last[2] if last and last[0] == row else 0
        start, end = max(floor, a - more.get((doc, text, -1, a), 0)), min(after, b + more.get((doc, text, 1, b), 0))
        if last and last[0] == row and start <= last[2]:
            last[2], last[3], last[4] = end, last[3] + n, last[4] and first
            last[5] = min((x for x in (last[5], first_doc) if x is not None), default=None)
        else:
            last = [row, start, end, n, first, first_doc]
            out.append(last)
    spans = [(cut[row][0], a, b - a, heads(row, a, b), n, first, first_doc) for row, a, b, n, first, first_doc in out]
    return sorted((x for x in spans if x[3] >= min_words), key=str)


def test_spans_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    passages = [words(rng, 40) for _ in range(3)]
    rows = [(int(rng.integers(-20, 20)), f"{words(rng, 30)} {passages[rng.integers(0, 3)]}\n{words(rng, 20)}") for _ in range(40)]
    rows += [(None, rows[0][1]), (None, rows[1][1]), (rows[2][0], rows[2][1]), (rows[2][0], rows[2][1]), (1 << 62, passages[0]), (-(1 << 63), passages[1] * 3), (7, None), (8, ""), (9, "z" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = repeated_spans(docs, min_words=5)
    assert got.columns == ["doc_id", "start", "length", "words", "n_chunks", "first", "first_doc_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 5)


def test_short_passages_are_found_whole(spark):
    rng = np.random.default_rng(21)
    rows, want = [], {}
    for n in (12, 15, 20, 30):
        for i in range(60):
            passage = words(rng, n)
            for side in (0, 1):
                doc = n * 1000 + 2 * i + side
                rows.append((doc, f"{words(rng, 20)} {passage} {words(rng, 20)}"))
                want[doc] = passage
    text = dict(rows)
    got = {r.doc_id: text[r.doc_id][r.start : r.start + r.length] for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[d] in span for d, span in got.items())
    found = {n: sum(d // 1000 == n for d in got) / 120 for n in (12, 15, 20, 30)}
    assert found[12] >= 0.7 and found[15] >= 0.95 and found[20] >= 0.97 and found[30] == 1.0


def test_copies_of_one_id_and_hot_passages(spark):
    rng = np.random.default_rng(22)
    hot = words(rng, 16)
    rows = [(i % 50 if i % 3 else None, f"{words(rng, int(rng.integers(0, 9)))} {hot} {words(rng, 4)}") for i in range(300)]
    rows += rows[:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = repeated_spans(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 12) and len(got) == 340


def test_empty_table(spark):
    assert repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
