"""Operator 11, byte-level BPE: a sentencepiece model written straight from a vocabulary of ranks, and its inverse.

A vocabulary of ranks (bytes to rank) becomes the protobuf bytes of a sentencepiece BPE model: each token's bytes are
written as letters, one for each byte, and score the negative of their rank, so that the library merges the pair of
least rank first and the leftmost of equals, as byte-level BPE does. The model neither changes nor splits what it is
given: texts are cut by the vocabulary's pattern before. Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .packing import byte_letters
from .words import slices

#: Characters of texts' chunks and matches whose ids a task keeps; beyond them it begins anew.
KEPT_CHARS = 12_000_000
_SPACES, _CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")
# Fixed values of sentencepiece's model format: field numbers, types of pieces, the kind of model.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _SCORE, _TYPE = 1, 2, 3
_NORMAL, _UNKNOWN = 1, 2
_MODEL_TYPE, _BPE = 3, 2
_NAME, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPED_SPACES = 1, 3, 4, 5


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token: lines of a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(tag: int, n: int) -> bytes:
    return _varint(tag << 3) + _varint(n)


def _bytes(tag: int, raw: bytes) -> bytes:
    return _varint(tag << 3 | 2) + _varint(len(raw)) + raw


def _piece(letters: str, score: float, kind: int) -> bytes:
    body = _bytes(_PIECE, letters.encode()) + _varint(_SCORE << 3 | 5) + struct.pack("<f", score) + _number(_TYPE, kind)
    return _bytes(_PIECES, body)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose n-th piece is the token of n-th least rank; the last stands for the unknown.

    Its normalisation is the identity: no prefix, no spaces taken away or rewritten. Ranks have to be exact as 32-bit
    floats, below 2**24.
    """
    if not ranks or max(ranks.values()) >= 1 << 24 or min(ranks.values()) < 0:
        raise ValueError("ranks must be from 0 to 2**24 - 1")
    letters = byte_letters()
    if any(bytes([b]) not in ranks for b in letters):
        raise ValueError("every byte must have a rank")
    pieces = [_piece("".join(map(letters.__getitem__, t)), -float(ranks[t]), _NORMAL) for t in sorted(ranks, key=ranks.get)]
    trainer = _bytes(_TRAINER, _number(_MODEL_TYPE, _BPE))
    normalizer = _bytes(_NORMALIZER, _bytes(_NAME, b"identity") + _number(_DUMMY_PREFIX, 0) + _number(_EXTRA_SPACES, 0) + _number(_ESCAPED_SPACES, 0))
    return b"".join([*pieces, _piece("<unk>", 0.0, _UNKNOWN), trainer, normalizer])


class Splitter:
    """Matches of a pattern in whole texts, with letters, numbers and spaces as the ``tiktoken`` library classes them.

    The two regular-expression libraries follow different editions of Unicode. Characters that they class unlike are
    replaced for the search by a letter, a number or a sign, one for one, so that places stay.
    """

    def __init__(self, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.unlike = stand_ins()
        self._odd = np.zeros(0x110000, bool)
        self._odd[list(self.unlike)] = True

    def alike(self, texts: list[str]) -> bool:
        """Whether both libraries class all characters of the texts alike."""
        return not any(self._odd[np.frombuffer(t.encode("utf-32-le"), np.uint32)].any() for t in texts if not t.isascii())

    def __call__(self, text: str) -> list[str]:
        if self.alike([text]):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.unlike))]


@functools.cache
def stand_ins() -> dict[int, str]:
    """A character of the class that ``tiktoken`` sees, for each that ``regex`` classes otherwise."""
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    each_byte = {bytes([b]): b for b in range(256)}
    out: dict[int, str] = {}
    for one, instead in ((r"\p{L}", "a"), (r"\p{N}", "0"), (r"\s", " ")):
        reader = tiktoken.Encoding("class", pat_str=one, mergeable_ranks=each_byte, special_tokens={})
        here, there = set(regex.findall(one, every)), set(reader.decode(reader.encode_ordinary(every)))
        out |= {ord(c): instead for c in there - here}
        for c in here - there:
            out.setdefault(ord(c), "#")
    return out


class Codec:
    """Encodes pre-tokens by the model that ``model_bytes`` writes, and decodes ids by the inverse mapping."""

    def __init__(self, ranks: dict[bytes, int]):
        import sentencepiece

        self.ranks = ranks
        self.letters = str.maketrans({b: c for b, c in byte_letters().items()})
        self.ids = sorted(ranks.values())  # by place of the piece
        self.plain = self.ids == list(range(len(ranks)))
        self.tokens = {i: t for t, i in ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))

    def encode_all(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as 32-bit bytes; one that is a token as a whole is that token, even where no merges lead to it."""
        raw = [p.encode() for p in pieces]
        ids = [[self.ranks[r]] if r in self.ranks else None for r in raw]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, found in zip(rest, self.merged([raw[i] for i in rest]), strict=True):
            ids[i] = found
        return [struct.pack(f"<{len(x)}i", *x) for x in ids]

    def merged(self, raw: list[bytes]) -> list[list[int]]:
        """The ids that merging leads to."""
        found = self.model.encode([r.decode("latin-1").translate(self.letters) for r in raw], num_threads=1)
        return found if self.plain else [[self.ids[i] for i in x] for x in found]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class Pieces:
    """Encodes whole texts, and keeps the ids (32-bit bytes) of what it has met: matches of the pattern, and chunks of them.

    Where ``cuts`` says that no match of the pattern joins a space to a character before it that is no white space, texts
    are cut into chunks before such spaces; a chunk is split by the pattern only when it is first met.
    """

    def __init__(self, codec: Codec, split: Splitter, cuts: bool):
        self.codec, self.split, self.cuts = codec, split, cuts
        self.whole: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # chunks that follow a space and begin with it
        self.matches: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, known: dict[str, bytes], lead: str, chunks: set[str], alike: bool) -> None:
        new = list(chunks.difference(known))
        split = list(map(self.split.pattern.findall if alike else self.split, [lead + c for c in new]))
        fresh = list(set(itertools.chain.from_iterable(split)).difference(self.matches))
        self.matches.update(zip(fresh, self.codec.encode_all(fresh), strict=True))
        known.update((c, b"".join(map(self.matches.__getitem__, s))) for c, s in zip(new, split, strict=True))
        self.held += sum(map(len, new)) + sum(map(len, fresh))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if self.held > KEPT_CHARS:
            self.held = 0
            for known in (self.whole, self.spaced, self.matches):
                known.clear()
        cut = []
        for text in texts:
            if not self.cuts:
                cut.append(([text], []))
            elif _SPACES.search(text):
                cut.append((_CUT.split(text), []))
            else:
                first, *rest = text.split(" ")
                cut.append(([first], rest))
        alike = self.split.alike(texts)
        self._learn(self.whole, "", set().union(*(whole for whole, _ in cut)), alike)
        self._learn(self.spaced, " ", set().union(*(spaced for _, spaced in cut)), alike)
        return [b"".join([*map(self.whole.__getitem__, whole), *map(self.spaced.__getitem__, spaced)]) for whole, spaced in cut]


def joins_no_space(pattern: str) -> bool:
    """Whether a pattern is known to begin a match at each space that follows another character than white space."""
    return pattern == default_pattern()


def encoded(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the column ``token_ids`` (array of int): the ids of the whole text, without special tokens.

    Each match of the pattern is encoded for itself. Null and empty texts have no ids, texts may be of any length,
    repeated rows are encoded each for itself, no rows give no rows; other columns are kept, one called ``token_ids``
    is replaced. ``vocabulary`` names a file of ranks that every executor can read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = pattern or default_pattern()
        known = Pieces(Codec(read_ranks(vocabulary or default_vocabulary())), Splitter(said), joins_no_space(said))
        for batch in batches:
            for at, part in slices(batch.column(place)):
                ids = known.encode(part.to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(part)) for c in batch.columns), column], names=names)

    rows = docs.drop("token_ids").withColumn(text, F.col(text).cast("string"))
    place, names = rows.columns.index(text), [*rows.columns, "token_ids"]
    return rows.mapInArrow(read, StructType([*rows.schema.fields, StructField("token_ids", ArrayType(IntegerType()))]))


def decoded(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``tokens`` with the column ``decoded`` (binary): the bytes that ``token_ids`` stand for.

    Bytes, since ids that were cut need not end with a character. Null or no ids give no bytes; an id outside the
    vocabulary, or a null one, is an error. Other columns are kept, one called ``decoded`` is replaced.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(vocabulary or default_vocabulary()))
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                column = part.column(place)
                flat, ends = column.flatten().to_numpy(), np.cumsum([0, *pc.fill_null(pc.list_value_length(column), 0).to_pylist()])
                said = [codec.decode(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.binary())], names=names)

    rows = tokens.drop("decoded")
    place, names = rows.columns.index("token_ids"), [*rows.columns, "decoded"]
    return rows.mapInArrow(read, StructType([*rows.schema.fields, StructField("decoded", BinaryType())]))


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text).

    The first digest is of the decimal ids joined by one space, the second of the bytes that the ids decode to. Null
    and empty texts have 0 tokens and the digests of nothing; null ids stay null; repeated rows are told each for
    itself; further columns are left alone.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    both = decoded(encoded(rows, vocabulary, pattern).drop("text"), vocabulary)
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
