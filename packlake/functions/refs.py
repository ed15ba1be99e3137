"""References to blobs as column functions, with the same rules for single Python strings.

A reference is ``zip://<key>::<pack path>``; it is split at the first ``::``. Keys are relative POSIX paths.
"""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME, SEPARATOR = "zip://", "::"
#: Java has no class for what Python's strip() removes, so it is listed: fixed values.
SPACES = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
REFERENCE = r"(?s)^zip://(.+?)::(.+)$"


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def make_ref(key, pack_path) -> Column:
    """The reference to a key in a shard; nothing is checked, null if either is null."""
    return F.concat(F.lit(SCHEME), _column(key), F.lit(SEPARATOR), _column(pack_path))


def is_ref(x) -> Column:
    return F.coalesce(_column(x).rlike(REFERENCE), F.lit(False))


def _part(ref, group: int, strict: bool) -> Column:
    ref = _column(ref)
    found = F.when(is_ref(ref), F.regexp_extract(ref, REFERENCE, group))
    if strict:
        found = F.when(ref.isNotNull() & ~is_ref(ref), F.raise_error(F.concat(F.lit("not a blob reference: "), ref)).cast("string")).otherwise(found)
    return found


def ref_key(ref, strict: bool = False) -> Column:
    """The key of a reference; of anything else null, or an error if strict."""
    return _part(ref, 1, strict)


def ref_path(ref, strict: bool = False) -> Column:
    """The pack path of a reference."""
    return _part(ref, 2, strict)


def ref_shard(ref, strict: bool = False) -> Column:
    """The shard's name: what follows the last slash of the pack path."""
    return F.element_at(F.split(ref_path(ref, strict), "/"), -1)


def ref_dir(ref, strict: bool = False) -> Column:
    """The pack path without the shard's name; empty for a shard alone."""
    return F.regexp_extract(ref_path(ref, strict), "(?s)^(.*)/[^/]*$", 1)


def base_matches(ref, ref_base: str) -> Column:
    """Whether a reference belongs to packs under `ref_base`; an empty base accepts any."""
    return F.lit(True) if ref_base == "" else ref_dir(ref) == F.lit(ref_base)


def key_problem(key) -> Column:
    """What is wrong with a key; null if nothing."""
    key = _column(key)
    bad_part = F.exists(F.split(key, "/"), lambda p: p.isin("", ".", ".."))
    return (
        F.when(key.isNull(), "null")
        .when(key == "", "empty")
        .when(key.rlike("^" + SPACES) | key.rlike(SPACES + r"\z"), "white space at an end")
        .when(key.contains("\\"), "backslash")
        .when(key.startswith("/"), "absolute")
        .when(key.contains(SEPARATOR), "separator")
        .when(bad_part, "empty or dotted part")
    )


def valid_key(key) -> Column:
    return key_problem(key).isNull()


def split_ref(text: str) -> tuple[str, str]:
    """Key and pack path of one reference."""
    m = re.match(REFERENCE, text)
    if not m:
        raise ValueError(f"not a blob reference: {text!r}")
    return m[1], m[2]


def check_key(key: str) -> None:
    """Raise ValueError for a key that must not name a blob."""
    parts = key.split("/")
    if key != key.strip() or "\\" in key or SEPARATOR in key or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a relative path that may name a blob: {key!r}")


def default_base(pack_dir: str) -> str:
    return posixpath.basename(pack_dir.rstrip("/"))


def normal_base(ref_base: str | None, pack_dir: str) -> str:
    return default_base(pack_dir) if ref_base is None else posixpath.normpath(ref_base)
