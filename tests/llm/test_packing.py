"""Packing: pieces make up the documents' ids, sequences are gapless, and few."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from worldlog.llm import packing

from . import corpus


def test_pieces_are_the_texts_and_fill_sequences(spark):
    rows = corpus.texts()
    got = packing.pack(corpus.table(spark, rows), with_ids=True).collect()
    plain = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        for piece, (start, n) in enumerate(packing.cuts(len(ids), packing.SIZE)):
            own = np.array(ids[start : start + n], "<u4").tobytes()
            want[(i, piece, start, n, zlib.crc32(own), own)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    by_sequence: dict[int, list] = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= packing.SIZE
    assert len(by_sequence) <= 1.1 * sum(r.length for r in got) / packing.SIZE + 1


def test_chunks_give_the_ids_of_whole_texts():
    encode = packing.Encoder(packing.default_tokenizer())
    for text in ["", " ", "a b", " lead", "tail ", "a\n b\tc", "don't  stop", "<|endoftext|> x", "é 日本　x", "\n \n", "a\n \nb", "\u3000 x", "a\u00a0 b", "1 2 34", "a \n b", "éa### ün*** x_y a`b c's d'", "a. B!? (c) d) <|x|>"]:
        assert encode(text) == encode.plain(text)


def test_best_fit_is_best_fit_decreasing():
    draw = random.Random(5)
    for _ in range(30):
        size = draw.choice([7, 16, 50])
        counts = Counter(draw.randint(1, size) for _ in range(draw.randint(1, 80)))
        bins: list[int] = []
        for length in sorted(counts.elements(), reverse=True):
            fits = [b for b in bins if b >= length]
            if fits:
                bins.remove(min(fits))
                bins.append(min(fits) - length)
            else:
                bins.append(size - length)
        plan = packing.best_fit(counts, size)
        used = Counter()
        for length, a, b, first, _ in plan:
            for k in range(b - a):
                used[first + k] += length
        assert sorted(used.values()) == sorted(size - b for b in bins)


def test_no_rows(spark):
    assert packing.pack(corpus.table(spark, [])).count() == 0


def test_added_tokens_are_read_as_the_library_reads_them():
    plain = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.Encoder(packing.default_tokenizer())
    for text in ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>"]:
        want = plain.encode(text, add_special_tokens=False).ids
        assert encode(text) == np.array(want, "<u4").tobytes()
    assert 50256 in plain.encode("a <|endoftext|> b", add_special_tokens=False).ids
