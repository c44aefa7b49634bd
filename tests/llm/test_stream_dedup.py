import hashlib
import re

import pytest

from bomspark.llm.stream_dedup import StreamingDedup, exact_duplicates


def brute(rows):
    groups, out = {}, []
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i))
    for i, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[key])
        out.append((i, best[1], len(groups[key]), (-len(text or ""), i) == best, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out)


ROWS = [(1, "a b"), (2, "ab "), (3, "a\x0bb\x0c"), (4, "a b"), (5, None), (6, ""), (7, " \n"), (8, "é" * 9000), (9, "é" * 9000 + "\r"), (10, "x"), (10, "x"), (11, "A b"), (12, "ab "), (13, "é"), (14, "é"), *((100 + i, "copy of one text") for i in range(50))]


@pytest.mark.parametrize("chars", [64, 1])
def test_decisions_equal_brute_force_even_when_digests_collide(spark, chars):
    docs = spark.createDataFrame([(*r, 0) for r in ROWS], "doc_id long, text string, digest int").repartition(3)
    got = exact_duplicates(docs, digest_chars=chars)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == brute(ROWS)


def test_later_batches_meet_the_state_of_earlier_ones(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(2)
    early, late = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    first = StreamingDedup(spark)
    first.add(early)
    second = StreamingDedup(spark, first.folder)  # as after a restart
    second.add(late)
    assert sorted(map(tuple, second.decisions(docs).collect())) == brute(ROWS)
    assert {r.keep_id for r in second.state().collect()} == {r[1] for r in brute(ROWS)}


def test_empty_table_and_null_ids(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = exact_duplicates(spark.createDataFrame([(None, "t"), (5, "t"), (None, "u")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (0, 5, 2, False), (5, 5, 2, True)]


def test_smallest_and_largest_ids(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    docs = spark.createDataFrame([(low, "t"), (high, "t"), (high, "u"), (None, "u")], "doc_id long, text string")
    got = exact_duplicates(docs).collect()
    assert sorted((r.keep_id, r.doc_id or 0, r.kept) for r in got) == [(low, low, True), (low, high, False), (high, 0, False), (high, high, True)]


@pytest.mark.parametrize("chars", [64, 1])
def test_files_are_read_by_locator_without_a_copy(spark, tmp_path, chars):
    spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs").select("doc_id", "text")
    dedup = StreamingDedup(spark, f"file://{tmp_path}/state", digest_chars=chars)
    dedup.add(docs)
    assert sorted(map(tuple, dedup.decisions(docs).collect())) == brute(ROWS)
    assert not (tmp_path / "state/texts").exists()
    at = {r.keep_id: (r.keep_file, r.keep_row) for r in dedup.state().where("n > 1").collect()}
    rows = {(r.f, r.i): r.doc_id for r in docs.selectExpr("doc_id", "_metadata.file_path AS f", "_metadata.row_index AS i").collect()}
    assert at and all(rows[where] == keep for keep, where in at.items())
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", None) is None
