import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from bomspark.llm.registry import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        out.append(docs)
    return [{r.doc_id: r for r in d.collect()} if i < 5 else d.collect() for i, d in enumerate(out)]


def test_stages_in_order_and_schema(steps, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(list(next(iter(s.values())).asDict()) == columns for s in steps[:5])


def test_quality_keeps_good_documents(steps, spark):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in steps[0] if quality.get(i) == 1]
    bad = [i for i in steps[0] if quality.get(i) == 0]
    assert np.mean([i in steps[1] for i in good]) > 0.95 and np.mean([i in steps[1] for i in bad]) < 0.5


def test_exact_dedup_keeps_one_of_each_text(steps):
    key = lambda r: "".join(r.text.split())
    assert len({key(r) for r in steps[2].values()}) == len(steps[2]) == len({key(r) for r in steps[1].values()})


def test_near_dedup_against_all_pairs(steps):
    def shingles(text):
        w = text.lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else set(zip(w, w[1:], w[2:], w[3:], w[4:]))

    sets = {i: shingles(r.text) for i, r in steps[2].items()}
    near = lambda a, b: 10 * len(a & b) >= 8 * len(a | b) > 0
    assert not any(near(sets[a], sets[b]) for a in steps[3] for b in steps[3] if a < b)
    assert all(any(near(sets[a], sets[b]) for b in sets if b < a) for a in steps[2] if a not in steps[3])


def test_mixing_takes_what_packing_packs(steps):
    size = sum(len(r.text.split()) for r in steps[3].values())
    assert abs(sum(len(r.text.split()) for r in steps[4].values()) - size) <= len({r.source for r in steps[3].values()})
    assert all(len(r.text.split()) <= 3 * len(steps[3][i].text.split()) for i, r in steps[4].items())
    full = Tokenizer.from_file(tokenizer_path())
    whole = {}
    for r in steps[5]:
        ids = np.array([*full.encode(steps[4][r.doc_id].text, add_special_tokens=False).ids, 2], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == len(ids)
    assert whole == {r.doc_id: r.doc_tokens for r in steps[5]} and set(whole) == set(steps[4])


def test_run_gives_the_rows_of_the_last_stage(steps, spark):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[5]))


def test_dedup_decides_row_by_row(spark):
    text = lambda k, n=60: " ".join(f"{k}{j}" for j in range(n))
    rows = [(None, text("a")), (3, text("a")), (None, text("b")), (None, text("b")), (5, text("c")), (5, text("c")), (5, text("d")), (4, text("d")), (6, "e  " + text("e")), (2, "e " + text("e"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    got = corpus_pipeline.exact_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, text("a")), (None, text("b")), (5, text("c")), (4, text("d")), (6, "e  " + text("e"))], key=str)
    near = [(None, text("a")), (3, text("a", 58)), (None, text("b")), (None, text("b", 59)), (5, text("c")), (5, text("c", 59)), (5, text("d")), (4, text("d", 59)), (5, text("f")), (7, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in near], docs.schema).repartition(3)
    got = sorted(corpus_pipeline.near_dedup(spark, docs, SF).collect(), key=key)
    assert [(r.doc_id, (r.text or "-")[0]) for r in got if r.text != ""] == [(3, "a"), (4, "d"), (5, "c"), (5, "f"), (7, "-"), (None, "b")] and len(got) == 7
    mixed = corpus_pipeline.mixing(spark, docs, SF).collect()
    assert abs(sum(len(r.text.split()) for r in mixed) - sum(len((t or "").split()) for _, t in near)) <= 1


EXTRA = ("row", "class", "size", "src", "node", "key", "digest", "n")


def odd_table(spark):
    long = " ".join(f"long{j} words" for j in range(60_000))
    rows = [(1, "good text of a document about rivers and towns", "en", "a"), (None, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", None), (4, long, "en", "b"), (4, long, "en", "b"), (5, "x", "en", ""), (None, "alone without an id here", "de", "a"), (-(1 << 63), "smallest id of all documents", "en", "c"), ((1 << 63) - 1, "largest id of all documents", "en", "c")]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in EXTRA)
    return rows, spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in rows], schema).repartition(3)


def test_odd_rows_pass_every_stage(spark):
    rows, docs = odd_table(spark)
    assert corpus_pipeline.quality(spark, docs, SF).columns == docs.columns
    exact = corpus_pipeline.exact_dedup(spark, docs, SF)
    assert exact.columns == docs.columns and {tuple(r[c] for c in EXTRA) for r in exact.collect()} == {EXTRA}
    key = lambda t: "".join((t or "").split())
    assert sorted(key(r.text) for r in exact.collect()) == sorted({key(t) for _, t, _, _ in rows})
    near = corpus_pipeline.near_dedup(spark, docs, SF)
    assert near.columns == docs.columns and near.count() == len(rows) - 1  # texts without words are linked with nothing
    mixed = corpus_pipeline.mixing(spark, docs, SF)
    assert mixed.columns == docs.columns and all(r.text.split() for r in mixed.collect())
    packed = corpus_pipeline.packing(spark, docs, SF).collect()
    assert sum(r.start == 0 for r in packed) == len(rows) and max(r.doc_tokens for r in packed) > 60_000


def test_empty_tables_pass_every_stage(spark):
    docs = odd_table(spark)[1].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
