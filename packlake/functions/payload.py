"""Column functions over payloads: what they look like, their checksums, and ranges of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First bytes of formats, in the order they are tried. Fixed values.
MAGIC = [
    ("JPEG", "FFD8FF"), ("PNG", "89504E470D0A1A0A"), ("GIF", "474946383761"), ("GIF", "474946383961"), ("BMP", "424D"), ("FLAC", "664C6143"),
    ("Ogg", "4F676753"), ("Matroska/WebM", "1A45DFA3"), ("PDF", "255044462D"), ("ZIP", "504B0304"),
]


def _hex(text: str) -> Column:
    return F.unhex(F.lit(text))


def kind_of(payload) -> Column:
    """The format that the first 16 bytes tell; 'empty' for none, 'unrecognized' for others, null for null."""
    payload = payload if isinstance(payload, Column) else F.col(payload)
    head = F.substring(payload, 1, 16)
    kind = F.when(F.octet_length(head) == 0, "empty")
    for name, magic in MAGIC:
        kind = kind.when(F.substring(head, 1, len(magic) // 2) == _hex(magic), name)
    kind = kind.when(F.substring(head, 5, 4) == _hex("66747970"), "MP4/MOV")
    riff = F.substring(head, 9, 4)
    inside = F.when(riff == _hex("57454250"), "WebP").when(riff == _hex("57415645"), "WAV").otherwise("RIFF")
    kind = kind.when(F.substring(head, 1, 4) == _hex("52494646"), inside).otherwise("unrecognized")
    return F.when(payload.isNotNull(), kind)


def range_of(payload, start: int | Column, length: int | Column) -> Column:
    """Up to `length` bytes from `start` (from 0); empty past the end, null if start or length is negative."""
    payload = payload if isinstance(payload, Column) else F.col(payload)
    start = start if isinstance(start, Column) else F.lit(start)
    length = length if isinstance(length, Column) else F.lit(length)
    cut = F.substring(payload, (start + 1).cast("int"), length.cast("int"))
    return F.when((start >= 0) & (length >= 0), F.when(start < F.octet_length(payload), cut).otherwise(F.unhex(F.lit("")).cast("binary")))
