"""Spelling variants by symmetric deletion.

Words are counted within tasks and then by Spark. Every word emits itself and its distinct single
deletions as hashed keys; words that share a key are joined, the shared key is checked character by
character and their distance is verified to be exactly one. Two words at distance one share exactly
one key: the shorter word itself, or what is left without the one position in which they differ. So
each pair comes out once. A key's words are its insertions and itself, at most letters x (length + 1),
which bounds the pairs that meet at a key whatever the size of the corpus. Each word's neighbours are
folded to a count and the most frequent one before they are shuffled, and chains of forms are
followed by joining the links with themselves, which doubles the distance seen in each round.

Defined results: null texts hold no words; a null id is written as an empty string before the colon;
repeated rows count each time; an empty table gives an empty result; extra columns are ignored. Ties
of frequency go to the word that is smallest in code-point order. Words of any length take part: keys
are hashes, and with those of long words go digests, not copies of the word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Letters A-Z, a-z and U+00C0 to U+00FF in UTF-8, after A-Z are lowered.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Different words that a task counts before it hands them on.
FLUSH = 1 << 17
#: Code points up to which a word itself goes with each of its keys.
SHORT = 64


def typo(run: bytes, crc: int, every: int = 31) -> bytes:
    """The run without the code point that its checksum names, where ``every`` divides that."""
    if crc % every:
        return run
    text = run.decode()
    at = crc % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def words_of(doc_id: object, text: str, least: int, every: int = 31) -> Iterator[bytes]:
    """The words of at least ``least`` code points of one text."""
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run in RUN.findall(text.encode("utf-8", "surrogatepass").lower()):  # lowers ASCII letters alone
        if len(run) >= least:
            word = typo(run, zlib.crc32(run, before), every)
            if len(word) >= least and (word.isascii() or len(word.decode()) >= least):
                yield word


def word_counts(docs: DataFrame, least: int = 7, least_n: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: words of at least ``least`` code points that occur ``least_n`` times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for doc_id, body in zip(batch.column(0), batch.column(1), strict=True):
                if body.is_valid:
                    seen.update(words_of(doc_id.as_py(), body.as_py(), least))
                    if len(seen) >= FLUSH:
                        yield handed()
        yield handed()

    parts = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _without(word: Column, at: Column) -> Column:
    """``word`` without its code point at ``at`` (from 1); the word itself for 0."""
    return F.when(at == 0, word).otherwise(F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word))))


def _meeting(words: DataFrame, name: Column) -> DataFrame:
    """Pairs that share a key: a, a_n, a_at and b, b_n, b_at, with a < b, their names."""
    letter = lambda word, at: F.substring(word, at, F.lit(1))
    # of equal letters in a row, deleting the first stands for deleting any
    places = F.filter(F.sequence(F.lit(0), F.length("word")), lambda i: (i < 2) | (letter(F.col("word"), i) != letter(F.col("word"), i - 1)))
    keys = words.select("word", "n", F.explode(places).alias("at")).select(F.xxhash64(_without(F.col("word"), F.col("at"))).alias("key"), name.alias("name"), "n", "at")
    a, b = (keys.select("key", F.col("name").alias(side), F.col("n").alias(f"{side}_n"), F.col("at").alias(f"{side}_at")) for side in "ab")
    return a.join(b, "key").where(F.col("a") < F.col("b")).drop("key")


def _near(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose shared key is the same string, not a clash of hashes, and whose distance is one."""
    same = _without(F.col(a), F.col("a_at")) == _without(F.col(b), F.col("b_at"))
    return pairs.where(same & (F.levenshtein(a, b, 1) == 1)).select(F.col(a).alias("a"), "a_n", F.col(b).alias("b"), "b_n")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each pair of words at distance one, once. Words of more than ``SHORT`` code
    points go through the join by digest."""
    short, rest = words.where(F.length("word") <= SHORT), words.where(F.length("word") >= SHORT)
    met = _meeting(rest, F.sha2("word", 256))
    for side in "ab":
        met = met.join(rest.select(F.sha2("word", 256).alias(side), F.col("word").alias(f"{side}_word")), side)
    met = met.where(F.greatest(F.length("a_word"), F.length("b_word")) > SHORT)
    return _near(_meeting(short, F.col("word")), "a", "b").unionByName(_near(met, "a_word", "b_word"))


def forms(words: DataFrame, times: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n: a word's most frequent near word if that is ``times`` as frequent."""
    pairs = near_pairs(words)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("w")).alias("near")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.struct((-F.col("a_n")).alias("m"), F.col("a").alias("w")).alias("near"))))
    rows = pairs.select(sides.alias("s")).select("s.*")
    rows = rows.unionByName(words.select("word", "n"), allowMissingColumns=True)
    best = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min("near").alias("near"))
    frequent = -F.col("near.m") >= times * F.col("n")
    return best.select("word", "n", "n_near", F.when(frequent, F.col("near.w")).alias("form"), F.when(frequent, -F.col("near.m")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """``forms`` with root: the end of each word's chain of forms. Frequencies grow by a factor at each
    step, so chains are short and have no cycles."""
    links = materialize(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "forms")
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("up"))
        if links.join(up, "root", "left_semi").isEmpty():
            break
        links = materialize(links.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root")), "forms")
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, least: int = 7, least_n: int = 2, times: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least ``least`` code points."""
    words = materialize(word_counts(docs, least, least_n, id_col, text), "words")
    return with_roots(materialize(forms(words, times), "near")).select("word", "form", "root", "n", "n_near", "form_n")
