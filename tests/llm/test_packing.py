import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from bomspark.llm.packing import WordTokenizer, best_fit_decreasing, pack_documents, tokenized_pieces
from bomspark.llm.registry import tokenizer_path


def brute_best_fit(lengths, window):
    left, bins = [], [0] * len(lengths)
    for at in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(c, b) for b, c in enumerate(left) if c >= lengths[at]]
        if fits:
            least = min(fits)[0]
            bins[at] = next(b for b, c in enumerate(left) if c == least)
        else:
            left.append(window)
            bins[at] = len(left) - 1
        left[bins[at]] -= lengths[at]
    return left


@pytest.mark.parametrize("seed", range(5))
def test_segment_tree_equals_plain_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 300)
    bins, offsets = best_fit_decreasing(lengths, 64)
    used = np.bincount(bins, weights=lengths)
    assert sorted(64 - used) == sorted(brute_best_fit(lengths.tolist(), 64))
    for b in range(len(used)):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1]]


TEXTS = ["Hello, World! it's Ünïcode　naïve\x0bx", "", None, "a\x1cb c", "<|endoftext|> x", "é ́x 'S DON'T", "w " * 9000, "日本語テキスト 12345", "  \n\t "]


def test_pieces_equal_the_plain_tokenizer_and_pack_without_loss(spark):
    rows = [(i, t, "z") for i, t in enumerate(TEXTS)] + [(3, "a\x1cb c", "z"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    full = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array([*full.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t, _ in rows}
    packed = pack_documents(docs, tokenizer_path(), 4096, 2, group_pieces=5).collect()
    seen = {}
    for r in packed:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        seen.setdefault(r.doc_id, []).append(r.length)
    assert {k: sum(v) for k, v in seen.items()} == {k: len(v) * (2 if k == 3 else 1) for k, v in ids.items()}
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    real = tokenized_pieces(docs, tokenizer_path(), with_ids=True).where("doc_id = 6").orderBy("start").collect()
    assert np.concatenate([r.ids for r in real]).tolist() == ids[6].tolist()


def test_word_by_word_equals_the_whole_text():
    full, rng = Tokenizer.from_file(tokenizer_path()), np.random.default_rng(4)
    alphabet = list("abcXYZ'.,!|#$%&*0129-_éÉßÿÀ×ªµσΣİ\u0301日\u00ad😀") + [" ", "\n", "\u3000", "\x85"] * 3
    t = WordTokenizer(tokenizer_path(), keep=50)
    for _ in range(400):
        text = "".join(rng.choice(alphabet, 60))
        assert np.frombuffer(t.encode(text), "<u4").tolist() == full.encode(text, add_special_tokens=False).ids, text
        assert len(t.known) < 300


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
