"""Sequence packing by best-fit decreasing.

Texts are tokenised where they lie. Overlong documents are first cut into full windows; the
remainders of a group are then placed, longest first, into the open window whose remaining
capacity fits tightest, found in a segment tree indexed by remaining capacity. Groups are
bounded shares of the documents (by hash), each packed by one task from lengths alone.

Defined results: null and empty texts are the end-of-document id alone. Repeated rows are
packed as often as they occur (told apart by nothing but their sequence and offset). A
null id, or any 64-bit one, is packed like any other. Texts are tokenised whole, however
long. Pieces of equal length go by id, start and checksum; any of equally tight windows may
be taken. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"
#: Where str.split and the tokenizer's white space differ, or ids depend on more than a word.
UNSURE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")


#: One run of letters, then perhaps one run of marks: two words of the tokenizer at most.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|#$%&*]*)")


def _letters_as_bytes() -> dict[int, str]:
    """Letters beyond ASCII as byte-level tokenizers spell them: a visible byte stands for
    itself, the others count up from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    spelled = [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]
    return {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordTokenizer:
    """Ids of whole texts as little-endian uint32 bytes. The tokenizer's words never span white
    space, so a word's ids are kept; plain words go to its merge model at once, others through
    all its steps. Texts with special-token marks go to it whole."""

    def __init__(self, path: str, keep: int = 200_000):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.spelled = _letters_as_bytes()
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.keep = keep

    def whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain is None:
            ids = self.whole(word)
        else:
            stem, marks = plain[1].lower(), plain[2]
            ids = self.known.get(stem)
            if ids is None:
                letters = stem if stem.isascii() else stem.translate(self.spelled)
                self.known[stem] = ids = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
            if marks:
                tail = self.marks.get(marks)
                if tail is None:
                    tail = self.whole(marks)
                    if len(self.marks) < 10_000:
                        self.marks[marks] = tail
                ids += tail
        self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(mark in text for mark in UNSURE):
            return self.whole(text)
        words, known = text.split(), self.known
        if len(known) > self.keep:
            known.clear()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join([known.get(w) or self.word(w) for w in words])


@lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer, with the words it has met, for all tasks of a Python worker."""
    return WordTokenizer(path)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, window: int = 4096, eos: int = 2, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids of every document, with a checksum and, if asked, the ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, end = worker_tokenizer(tokenizer_path), np.array([eos], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, value in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                ids = tokenizer.encode(value or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    row = (doc, start, len(piece) // 4, zlib.crc32(piece), total)
                    rows.append((*row, np.frombuffer(piece, "<u4").astype(np.int32)) if with_ids else row)
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids])

    # ids go through pandas as strings: longs beside nulls would become floats
    cut_rows = docs.select(F.col(id_col).cast("long").cast("string"), F.col(text)).mapInPandas(cut, PIECES + (", ids array<int>" if with_ids else ""))
    return cut_rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. The segment tree over capacities 0..size-1 holds at each
    leaf how many open bins have that capacity left; its least filled leaf >= length is the
    tightest fit."""
    size = 1 << window.bit_length()
    tree = [0] * (2 * size)
    open_bins: list[list[int]] = [[] for _ in range(window + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n_bins = 0

    def add(capacity: int, by: int) -> None:
        node = capacity + size
        while node:
            tree[node] += by
            node >>= 1

    def tightest(least: int) -> int:
        node = least + size
        if tree[node]:
            return least
        while node > 1:  # up until a filled right sibling, then down to its leftmost leaf
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < size:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - size
            node >>= 1
        return -1

    for at in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[at])
        capacity = tightest(need)
        if capacity < 0:
            chosen, capacity = n_bins, window
            n_bins += 1
        else:
            chosen = open_bins[capacity].pop()
            add(capacity, -1)
        bins[at], offsets[at] = chosen, window - capacity
        if capacity > need:
            open_bins[capacity - need].append(chosen)
            add(capacity - need, 1)
    return bins, offsets


def pack(pieces: DataFrame, window: int = 4096, group_pieces: int = 50_000) -> DataFrame:
    """``pieces`` with sequence_id, offset and sequence_length (padded, but not at a power of two)."""
    groups = max(1, -(-pieces.count() // group_pieces))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, rows["offset"] = best_fit_decreasing(rows["length"].to_numpy(), window)
        used = np.bincount(bins, weights=rows["length"]).astype(np.int64)
        rows["sequence_id"] = bins * groups + rows.pop("grp")
        rows["sequence_length"] = np.where((used & (used - 1)) == 0, used, window)[bins]
        return rows[[*columns, "sequence_id", "offset", "sequence_length"]]

    columns = pieces.columns
    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups))).withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = ", ".join(f"{c} {'string' if c == 'doc_id' else t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long, sequence_length long"
    return grouped.groupBy("grp").applyInPandas(place, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 4096, eos: int = 2, group_pieces: int = 50_000, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's pieces, each with its place in a sequence of at most ``window`` ids."""
    return pack(materialize(tokenized_pieces(docs, tokenizer_path, window, eos, id_col, text), "pieces"), window, group_pieces)
