"""Shards as a stream: each micro-batch lists the members of shards that have arrived since the one before.

    spark.dataSource.register(PackArrivals)
    spark.readStream.format("pack_arrivals").load(folder)

Shards don't change, and appear under their names only when they are whole. An offset says which have been seen, whatever
the order they came in: of names <prefix>-<number>.zip the number below which all were there, and every other name.
"""

from __future__ import annotations

import re

from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from ..sources.formats import INDEX, FilePartition, _IndexReader
from ..sources.ranges import list_files


NUMBERED = re.compile(r"(.+)-(\d{4,})\.zip")


def _number(name: str) -> tuple[str, int] | None:
    m = NUMBERED.fullmatch(name)
    return (m[1], int(m[2])) if m and f"{int(m[2]):04d}" == m[2] else None


def offset_of(names: list[str]) -> dict:
    """The offset after which exactly these names have been seen."""
    numbers: dict[str, set[int]] = {}
    for found in filter(None, map(_number, names)):
        numbers.setdefault(found[0], set()).add(found[1])
    below = {p: next(i for i in range(len(n) + 1) if i not in n) for p, n in numbers.items()}
    return {"below": below, "others": sorted(n for n in names if not (m := _number(n)) or m[1] >= below[m[0]])}


def seen(offset: dict, name: str) -> bool:
    found = _number(name)
    return bool(found and found[1] < offset["below"].get(found[0], 0)) or name in offset["others"]


class _Arrivals(DataSourceStreamReader):
    def __init__(self, options):
        self.options = options

    def initialOffset(self):
        return offset_of([])

    def latestOffset(self):
        return offset_of([n for n, _ in list_files(self.options["path"], self.options.get("pattern", "*.zip"))])

    def partitions(self, start, end):
        files = list_files(self.options["path"], self.options.get("pattern", "*.zip"))
        return [FilePartition(n, p) for n, p in files if seen(end, n) and not seen(start, n)]

    def read(self, partition):
        yield from _IndexReader(self.options).read(partition)

    def commit(self, end):
        pass


class PackArrivals(DataSource):
    @classmethod
    def name(cls):
        return "pack_arrivals"

    def schema(self):
        return INDEX

    def streamReader(self, schema):
        return _Arrivals(self.options)
