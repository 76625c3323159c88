"""Byte-level BPE: the ids of another library, byte for byte, and back."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import tiktoken

from worldlog.llm import bpe

from . import corpus


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def ids_of(pieces: bpe.Pieces, text: str) -> list[int]:
    return np.frombuffer(pieces.encode([text])[0], np.int32).tolist()


def test_awkward_rows_against_another_library(spark, plain):
    rows = [*corpus.texts(), (71, "x" * 50_000), (72, " \n" * 3_000), (73, "<|endoftext|> a"), (74, "don't I'LL"), (75, "日本 🙂‍🙂 é")]
    got = bpe.round_trip(corpus.table(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want


def test_every_token_is_reached_by_merges_or_whole(ranks):
    codec = bpe.Codec(ranks)
    assert codec.merged(list(ranks)) == [[i] for i in ranks.values()]
    assert all(codec.decode(np.array([i])) == t for t, i in ranks.items())


def test_random_characters_of_every_plane(ranks, plain):
    draw = random.Random(4)
    planes = [(0, 0x80), (0x80, 0xD800), (0xE000, 0x10000), (0x10000, 0x20000), (32, 33), (9, 14)]
    text = "".join(chr(draw.randrange(*draw.choice(planes))) for _ in range(60_000))
    split, codec = bpe.Splitter(bpe.default_pattern()), bpe.Codec(ranks)
    assert "".join(split(text)) == text
    want = plain.encode_ordinary(text)
    assert np.frombuffer(b"".join(codec.encode_all(split(text))), np.int32).tolist() == want
    for cuts in (True, False):
        assert ids_of(bpe.Pieces(codec, split, cuts), text) == want


def test_texts_cut_before_spaces(ranks, plain):
    known = bpe.Pieces(bpe.Codec(ranks), bpe.Splitter(bpe.default_pattern()), True)
    draw = random.Random(6)
    for _ in range(300):
        text = "".join(draw.choices(["a", " ", "  ", "\n", "\u00a0", "\x1c", "'s", "9", "!", "é", "\u3000", "it's", "\x85"], k=30))
        assert ids_of(known, text) == plain.encode_ordinary(text), text
        known.held = draw.choice([known.held, bpe.KEPT_CHARS + 1])  # it may begin anew at any time


def test_a_token_that_no_merges_lead_to():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"xyz": 300, b"abc": 301}
    codec = bpe.Codec(ranks)
    plain = tiktoken.Encoding("small", pat_str=r"\w+|\W", mergeable_ranks=ranks, special_tokens={})
    for text in ["abc", "xyz", "xyza", "abcabc", "bcab", "aabbcc", "abcd", "z"]:
        assert np.frombuffer(codec.encode_all([text])[0], np.int32).tolist() == plain.encode_ordinary(text), text
    assert codec.merged([b"xyz"]) != [[300]]


def test_vocabularies_that_cannot_be_written():
    with pytest.raises(ValueError, match="every byte"):
        bpe.model_bytes({b"a": 0})
    with pytest.raises(ValueError, match="ranks"):
        bpe.model_bytes({bytes([b]): b + (1 << 24) for b in range(256)})


def test_columns_and_empty_tables(spark):
    docs = corpus.table(spark, [(1, "a b"), (1, "a b"), (2, None)]).selectExpr("*", "1 AS token_ids", "2 AS decoded")
    both = bpe.decoded(bpe.encoded(docs))
    assert set(both.columns) == set(docs.columns)
    assert sorted((r.doc_id, r.token_ids, bytes(r.decoded)) for r in both.collect()) == [(1, [64, 275], b"a b")] * 2 + [(2, [], b"")]
    assert bpe.round_trip(docs.limit(0)).collect() == []
    assert bpe.encoded(docs.limit(0)).count() == 0
