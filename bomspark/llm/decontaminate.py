"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Items are cut into windows of ten consecutive normalised words (an item of fewer words is one
window). The automaton's patterns are windows with a blank before, between and after their words; a
text is normalised alike by one byte table and scanned once, so that each match begins and ends at
words. Matches are turned into ranges of words, and those into places in the original text.

The windows are broadcast, so their size is checked: they are cut into groups of at most
``max_chars`` characters, and each group makes one automaton. Usual benchmarks are one group and one
scan; with more groups there is a scan for each, written out before the next, and the ranges that
they find in equal texts are united.

Defined results: null texts and null items have no words. Items with equal ids are one item, with the
windows of all its rows; ids of null are the item ''. Repeated document rows each come out. Texts are
scanned whole, whatever their length. Empty tables: no documents give an empty result, no items no
hits. Extra columns of both tables are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Words: letters, digits and everything outside ASCII. In UTF-8 bytes, A-Z lowered and the rest blank.
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
SPANS = pa.list_(pa.struct([(name, pa.int64()) for name in ("first", "last", "start", "end")]))
HITS = "n_words long, spans array<struct<first:long,last:long,start:long,end:long>>, items array<string>"


def normalised(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def windows(words: list[bytes], size: int) -> set[str]:
    """All windows of ``size`` consecutive words; the whole of a shorter, not empty item."""
    return {f" {b' '.join(words[i : i + size]).decode('utf-8', 'surrogatepass')} " for i in range(max(1, len(words) - size + 1))} if words else set()


def united(ranges: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Sorted (first, last, ...) with those that overlap or touch as one."""
    out: list[tuple[int, ...]] = []
    for r in sorted(ranges):
        if out and r[0] <= out[-1][1]:
            if r[1] > out[-1][1]:
                out[-1] = (out[-1][0], r[1], *out[-1][2:3], *r[3:])
        else:
            out.append(r)
    return out


class Scanner:
    """The automaton, which knows for each window its number of words and its items."""

    def __init__(self, patterns: list[tuple[str, list[str]]]):
        self.automaton = ahocorasick.Automaton()
        for window, items in patterns:
            self.automaton.add_word(window, (window.count(" ") - 1, tuple(items)))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, ranges of hit words (apart from each other, in order), items with occurring windows."""
        words = normalised(text or "")
        found: set[str] = set()
        ranges: list[tuple[int, int]] = []
        if words and self.automaton.kind == ahocorasick.AHOCORASICK:
            line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
            at = word = 0
            for end, (n, items) in self.automaton.iter(line):
                word, at = word + line.count(" ", at, end), end  # words that end before this blank
                found.update(items)
                start = word - n
                while ranges and start <= ranges[-1][1]:
                    start = min(start, ranges.pop()[0])
                ranges.append((start, word))
        return len(words), ranges, found


@lru_cache(maxsize=1)
def _scanner(shared: Broadcast) -> Scanner:
    return Scanner(shared.value)


def places(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Ranges of words, and with them the ranges of code points of the original text."""
    if not ranges:
        return []
    borders, out, start = iter(ranges), [], 0
    first, last = next(borders)
    for i, m in enumerate(ORIGINAL_WORD.finditer(text)):
        if i == first:
            start = m.start()
        if i == last - 1:
            out.append((first, last, start, m.end()))
            first, last = next(borders, (-1, -1))
    return out


def _spans(rows: list[list[tuple[int, ...]]]) -> pa.Array:
    return pa.array([[dict(zip(("first", "last", "start", "end"), s, strict=True)) for s in r] for r in rows], SPANS)


def item_windows(items: DataFrame, size: int, id_col: str, text: str) -> DataFrame:
    """window, items: every distinct window with the ids of its items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted(windows(normalised(body or ""), size))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.string())], ["item", "window"])

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).mapInArrow(cut, "item string, window string")
    return rows.groupBy("window").agg(F.collect_set("item").alias("items"))


def _scan(docs: DataFrame, patterns: list[tuple[str, list[str]]]) -> DataFrame:
    """The columns of ``docs`` but for its last one, the text, and what one automaton finds in that."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    kept = docs.drop("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared)
        for batch in batches:
            n_words, spans, items = [], [], []
            for body in batch.column(batch.num_columns - 1):
                text = body.as_py() or ""
                n, ranges, found = scanner.scan(text)
                n_words.append(n)
                spans.append(places(text, ranges))
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words, pa.int64()), _spans(spans), pa.array(items, pa.list_(pa.string()))], [*batch.schema.names[:-1], "n_words", "spans", "items"])

    return docs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + f", {HITS}")


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("spans")
        spans = [united([tuple(s.values()) for s in r]) for r in batch.column(at).to_pylist()]
        yield batch.set_column(at, "spans", _spans(spans))


def scan_documents(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_chars: int = 4_000_000) -> DataFrame:
    """doc_id, n_words, spans, items of every document: the ranges of its words that stand in an
    occurring window (first, last: words; start, end: code points of the text) and the items of the windows."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"))
    found = materialize(item_windows(items, size, item_id, item_text), "windows")
    chars = found.agg(F.sum(F.length("window") + F.length(F.array_join("items", ",")))).first()[0] or 0
    if chars <= max_chars:
        return _scan(source, [tuple(r) for r in found.collect()])  # at most max_chars characters
    groups = -(-2 * chars // max_chars)
    keyed = source.select("doc_id", F.sha2(F.coalesce("t", F.lit("")), 256).alias("digest"), "t")
    parts = []
    for g in range(groups):
        patterns = [tuple(r) for r in found.where(F.pmod(F.xxhash64("window"), F.lit(groups)) == g).collect()]
        # equal texts have equal results, so one row of each digest is enough, made within tasks first
        parts.append(materialize(_scan(keyed.drop("doc_id"), patterns).dropDuplicates(["digest"]), "hits"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    hits = rows.groupBy("digest").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = hits.mapInArrow(_unite, f"digest string, {HITS}")
    return keyed.drop("t").join(hits, "digest").select("doc_id", "n_words", "spans", "items")


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan_documents(docs, items, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
