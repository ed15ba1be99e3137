"""Byte-level BPE encoding and decoding with a sentencepiece model written straight from a rank file.

A rank file lists byte strings with their merge ranks. Each byte string becomes a piece of printable characters (one
for each byte), scored by its negative rank, in a BPE model whose normalisation is the identity. sentencepiece then
joins the neighbouring pair whose union has the lowest rank, leftmost first: the merge order of the rank file. Texts
are cut into pre-tokens by a pattern, each pre-token is encoded alone, and ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Distinct pre-tokens whose ids a worker remembers before it starts afresh: bounds its memory, not what is encoded.
CACHE = 300_000
#: Characters of text cut into pre-tokens at a time.
PORTION = 1_000_000


def printable_bytes() -> list[str]:
    """For each byte a printable character: itself where it is one in Latin-1, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model. Piece numbers are ranks where those run from 0 without gaps."""
    shown = printable_bytes()
    normal, unknown, bpe = 1, 2, 2
    parts = []
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        body = _field(1, "".join(shown[b] for b in piece).encode()) + _field(2, float(-rank)) + _field(3, normal)
        parts.append(_field(1, body))
    parts.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    parts.append(_field(2, _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, len(ranks))))
    parts.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(parts)


class ByteBpe:
    """Encodes texts to ids and ids back to bytes."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(rank_file)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the rank file lacks the bytes {missing}")
        self._of_piece = [rank for rank in sorted(ranks.values())]
        self._bytes = {rank: piece for piece, rank in ranks.items()}
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self._find = regex.compile(pattern).findall
        self._shown = {b: c for b, c in enumerate(printable_bytes())}
        self._known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self._known]
        if len(self._known) + len(new) > CACHE:
            self._known, new = {}, list(words)
        shown = [w.encode().decode("latin-1").translate(self._shown) for w in new]
        of_piece = self._of_piece
        for word, pieces in zip(new, self._model.encode(shown, num_threads=1), strict=True):
            self._known[word] = struct.pack(f"<{len(pieces)}I", *[of_piece[p] for p in pieces])

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in common.portions(texts, PORTION):
            words = [self._find(t) for t in part]
            self._learn(set().union(*words))
            out += [b"".join(map(self._known.__getitem__, w)) for w in words]
        return out

    def encode(self, text: str) -> list[int]:
        (packed,) = self.encode_packed([text])
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, memoryview(packed).cast("I")))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


def _codec(rank_file, pattern: str):
    """One codec for each worker process and vocabulary."""
    key = (hash(rank_file.value), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = ByteBpe(rank_file.value, pattern)
    return _CODECS[key]


_CODECS: dict[tuple, ByteBpe] = {}


def encode(df: DataFrame, rank_file: bytes, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`df` with a binary column `out`: the ids of the whole text as little-endian unsigned 32-bit integers.

    A null or empty text has no ids (an empty binary). Repeated rows stay as they are; an empty table gives an empty
    table; a column already named `out` is an error. Nothing is shuffled: a task holds one batch of texts.
    """
    _free(df, out)
    shared = df.sparkSession.sparkContext.broadcast(rank_file)

    def make():
        codec = _codec(shared, pattern)
        return lambda texts: [pa.array(codec.encode_packed([t or "" for t in texts.to_pylist()]), pa.binary())]

    return common.map_arrow(df, [common.quoted(text).cast("string")], [(out, T.BinaryType())], make, df.columns)


def decode(df: DataFrame, rank_file: bytes, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with a binary column `out`: the bytes that the packed ids stand for. Null ids give an empty binary."""
    _free(df, out)
    shared = df.sparkSession.sparkContext.broadcast(rank_file)

    def make():
        codec = _codec(shared, pattern)
        return lambda column: [pa.array([codec.decode_packed(x) if x else b"" for x in column.to_pylist()], pa.binary())]

    return common.map_arrow(df, [common.quoted(ids)], [(out, T.BinaryType())], make, df.columns)


def round_trip(df: DataFrame, rank_file: bytes, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with both columns, of encode() and of decode() of what it gave, made by one worker for each task."""
    _free(df, ids)
    _free(df, decoded)
    shared = df.sparkSession.sparkContext.broadcast(rank_file)

    def make():
        codec = _codec(shared, pattern)

        def run(texts):
            packed = codec.encode_packed([t or "" for t in texts.to_pylist()])
            return [pa.array(packed, pa.binary()), pa.array(list(map(codec.decode_packed, packed)), pa.binary())]

        return run

    return common.map_arrow(df, [common.quoted(text).cast("string")], [(ids, T.BinaryType()), (decoded, T.BinaryType())], make, df.columns)


def _free(df: DataFrame, out: str) -> None:
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table already has a column {out}")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        rank_file = f.read()
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    both = round_trip(docs, rank_file, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
