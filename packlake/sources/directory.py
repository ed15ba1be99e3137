"""The directory of a zip archive as columns, found by offsets from the archive's end.

One request fetches the end of the file, which holds the end record and nearly always the whole directory; the rest of a
larger directory takes one more. All numbers of the format are those of the zip specification.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from ..errors import CorruptPack
from .ranges import TAIL, Ranges

END = struct.Struct("<4s4H2LH")  # signature, two disk numbers, two counts, bytes and place of the directory, comment
LOCATOR = struct.Struct("<4sLQL")  # of the zip64 end record: signature, disk, place, disks
END64 = struct.Struct("<4sQ2H2L4Q")  # signature, length, versions, disks, two counts, bytes and place of the directory
MEMBER = struct.Struct("<4s6H3L5H2L")  # one record of the directory, without what varies in length
FULL = 0xFFFFFFFF  # stands for a number that is in the zip64 field
UTF8 = 0x800


@dataclass
class Directory:
    """Members but folders, in directory order. raw: names as they are stored; numbers: (place, size, crc, flags, method)
    of each; begin: where the directory itself begins."""

    names: list[str]
    raw: list[bytes]
    numbers: np.ndarray
    begin: int


def read_directory(source: Ranges) -> Directory:
    size = source.size()
    tail_at = max(0, size - TAIL)
    tail = source.read(tail_at, size - tail_at)
    end_at, count, length, place = _end(source, tail, tail_at)
    begin = end_at - length  # bytes in front of the archive move everything by as much
    if begin < 0:
        raise CorruptPack(f"{source.path}: the directory is longer than the file")
    data = tail[begin - tail_at : end_at - tail_at] if begin >= tail_at else source.read(begin, length)
    moved = begin - place
    names, raw, numbers = [], [], []
    at = 0
    for _ in range(count):
        if at + MEMBER.size > length or data[at : at + 4] != b"PK\x01\x02":
            raise CorruptPack(f"{source.path}: the directory breaks off after {len(raw)} of {count} members")
        _, _, _, flags, method, _, _, crc, packed, plain, n, extra, comment, _, _, _, offset = MEMBER.unpack_from(data, at)
        name_at = at + MEMBER.size
        name = data[name_at : name_at + n]
        if FULL in (plain, packed, offset):
            plain, offset = _large(data[name_at + n : name_at + n + extra], plain, packed, offset)
        at = name_at + n + extra + comment
        text = name.decode("utf-8" if flags & UTF8 else "cp437", "replace")
        if not text.endswith("/"):
            names.append(text)
            raw.append(name)
            numbers.append((offset + moved, plain, crc, flags, method))
    return Directory(names, raw, np.array(numbers, np.int64).reshape(-1, 5), begin)


def _end(source: Ranges, tail: bytes, tail_at: int) -> tuple[int, int, int, int]:
    """Where the directory ends, its members, bytes and stated place."""
    at = len(tail)
    while (at := tail.rfind(b"PK\x05\x06", 0, at)) >= 0:
        if at + END.size <= len(tail) and at + END.size + END.unpack_from(tail, at)[7] == len(tail):
            break
    else:
        raise CorruptPack(f"{source.path}: no zip archive")
    _, _, _, _, count, length, place, _ = END.unpack_from(tail, at)
    end = tail_at + at
    if count == 0xFFFF or FULL in (length, place):
        before = end - LOCATOR.size - END64.size
        both = source.read(before, LOCATOR.size + END64.size) if before >= 0 else b""
        if both[:4] == b"PK\x06\x06" and both[END64.size : END64.size + 4] == b"PK\x06\x07":
            *_, count, length, place = END64.unpack_from(both)
            end = before
    return end, count, length, place


def _large(extra: bytes, plain: int, packed: int, offset: int) -> tuple[int, int]:
    """Size and place from the zip64 field, which holds only those numbers that the record has no room for."""
    while len(extra) >= 4:
        kind, n = struct.unpack_from("<HH", extra)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra[: 4 + n], 4)) if len(extra) >= 4 + n else iter(())
            plain, packed, offset = (next(values, v) if v == FULL else v for v in (plain, packed, offset))
            break
        extra = extra[4 + n :]
    return plain, offset
