"""Token counts against a plain read of the files."""

from __future__ import annotations

import random
import tempfile
from pathlib import Path

import numpy as np
import pytest
import sentencepiece

from worldlog.llm import token_files

from . import corpus


def brute(ids: list[int], end: int) -> list[tuple]:
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((len(out), start, i - start, True))
            start = i + 1
    return out + [(len(out), start, len(ids) - start, False)] * (start < len(ids))


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_boundaries_across_blocks(spark, block):
    draw, folder = random.Random(block), Path(tempfile.mkdtemp(prefix="spark-"))
    want = []
    for k in range(6):
        ids = [] if k == 0 else [2, 2] if k == 1 else draw.choices([2, 5, 6, 7, 512, 2 << 8], k=draw.randint(1, 60))
        (folder / f"f{k}.bin").write_bytes(np.array(ids, "<u2").tobytes() + b"x" * (k == 3))
        want += [(f"f{k}.bin", *x) for x in brute(ids, 2)]
    got = token_files.count_tokens(spark, str(folder), block=block).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_files_of_documents(spark):
    rows = corpus.texts()
    model = sentencepiece.SentencePieceProcessor(model_file=token_files.default_tokenizer())
    got = token_files.corpus_counts(corpus.table(spark, rows)).collect()
    assert all(r.closed for r in got)
    assert sorted(r.n_tokens for r in got) == sorted(len(model.encode(t or "")) for _, t in rows)
    assert token_files.corpus_counts(corpus.table(spark, [])).count() == 0
