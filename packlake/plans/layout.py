"""Which shard each blob goes to.

The exact layout is a greedy fold over the blobs in order. It looks at sizes, keys and groups only: about a hundred
bytes for each blob, sorted and folded by one task, while payloads stay where they are. Its result is one row for each
shard (the first place in order), as few as there are shards; rows find their shard by comparison with these places.
The parallel layout folds ranges of the order separately, so nothing is serial; shards at the ends of ranges are less
full, and references differ.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..sources.shards import END_RECORD, projected

#: Limits by default: the largest classic zip file.
MAX_BYTES, MAX_BLOBS, GROUP_FILL = 4 << 30, 65_535, 0.5


@dataclass(frozen=True)
class Limits:
    max_bytes: int = MAX_BYTES
    max_blobs: int = MAX_BLOBS
    group_fill: float = GROUP_FILL

    def __post_init__(self):
        if self.max_bytes < 1 or self.max_blobs < 1 or not 0 <= self.group_fill <= 1:
            raise ValueError("limits must be positive, and group_fill between 0 and 1")


class Roller:
    """Deals blobs to shards, one after the other."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.shard, self.bytes, self.blobs = -1, END_RECORD, 0
        self.group: str | None = None  # of the last blob that had one
        self.group_began = -1
        self.splits = 0

    def _next_shard(self) -> None:
        self.shard, self.bytes, self.blobs = self.shard + 1, END_RECORD, 0

    def place(self, size: int, key: str, group: str | None = None) -> int:
        """The shard of the next blob.

        A group that begins gets a new shard if the open one is full to `group_fill`. Whatever the group, a shard ends
        when the next blob would exceed a limit; a blob too large for any has one of its own. A group that is cut counts
        as split once.
        """
        add, lim = projected(size, key), self.limits
        begins = group is not None and group != self.group
        if begins and self.blobs and self.bytes >= lim.max_bytes * lim.group_fill:
            self._next_shard()
        if self.shard < 0 or self.blobs >= lim.max_blobs or (self.blobs and self.bytes + add > lim.max_bytes):
            if group is not None and not begins and self.group_began == self.shard:
                self.splits += 1
            self._next_shard()
        if begins:
            self.group, self.group_began = group, self.shard
        self.bytes += add
        self.blobs += 1
        return self.shard


PLANNED = "shard_id int, shard_bytes long, splits long"


def _fold(limits: Limits):
    def run(batches):
        roller = Roller(limits)
        for batch in batches:
            size, key, group = (batch.column(n).to_pylist() for n in ("size", "key", "group"))
            placed = []
            for s, k, g in zip(size, key, group, strict=True):
                placed.append((roller.place(s, k, g), roller.bytes, roller.splits))
            ids, used, splits = zip(*placed, strict=True) if placed else ((), (), ())
            extra = [pa.array(ids, pa.int32()), pa.array(used, pa.int64()), pa.array(splits, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "shard_id", "shard_bytes", "splits"])

    return run


def plan(blobs: DataFrame, limits: Limits = Limits(), layout: str = "exact") -> DataFrame:
    """`blobs` (ord, key, size, and group or not) with shard_id, and as they were after each blob the projected bytes of
    its shard and the groups split so far. ord: anything that can be ordered, without ties."""
    has_group = "group" in blobs.columns
    meta = blobs.select("ord", "key", F.col("size").cast("long").alias("size"), (F.col("group") if has_group else F.lit(None)).cast("string").alias("group"))
    kind = dict(meta.dtypes)["ord"]
    schema = f"ord {kind}, key string, size long, group string, {PLANNED}"
    if layout == "exact":
        return meta.repartition(1).sortWithinPartitions("ord").mapInArrow(_fold(limits), schema)
    if layout != "parallel":
        raise ValueError(f"no such layout: {layout}")
    # the limits of the ranges are fixed first, so that a range is the same whenever it is computed
    n = int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = meta.repartitionByRange(n, "ord").withColumn("range", F.spark_partition_id())
    limits_of = [r[0] for r in ranged.groupBy("range").agg(F.min("ord").alias("ord")).orderBy("ord").select("ord").collect()]
    dealt = meta.withColumn("range", shard_of(F.col("ord"), limits_of or [None], kind)).repartition(n, "range").sortWithinPartitions("range", "ord")
    folded = dealt.mapInArrow(_fold_ranges(limits), f"ord {kind}, key string, size long, group string, range int, {PLANNED}")
    counts = folded.groupBy("range").agg((F.max("shard_id") + 1).alias("n")).orderBy("range").collect()  # one row for each range
    before, total = {}, 0
    for r in counts:
        before[r[0]], total = total, total + r[1]
    offset = F.get(F.array(*[F.lit(before.get(i, 0)) for i in range(len(limits_of) or 1)]), F.col("range"))
    return folded.withColumn("shard_id", (F.col("shard_id") + offset).cast("int")).drop("range")


def _fold_ranges(limits: Limits):
    """As _fold, beginning anew with every range."""

    def run(batches):
        roller, current = None, None
        for batch in batches:
            size, key, group, part = (batch.column(n).to_pylist() for n in ("size", "key", "group", "range"))
            placed = []
            for s, k, g, r in zip(size, key, group, part, strict=True):
                if r != current:
                    roller, current = Roller(limits), r
                placed.append((roller.place(s, k, g), roller.bytes, roller.splits))
            ids, used, splits = zip(*placed, strict=True) if placed else ((), (), ())
            extra = [pa.array(ids, pa.int32()), pa.array(used, pa.int64()), pa.array(splits, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "shard_id", "shard_bytes", "splits"])

    return run


def shard_starts(planned: DataFrame) -> list:
    """The first place of each shard in order: as many values as shards."""
    return [r[0] for r in planned.groupBy("shard_id").agg(F.min("ord").alias("ord")).orderBy("shard_id").select("ord").collect()]


def _literal(value) -> Column:
    """A value as it was collected, structs included."""
    if isinstance(value, Row):
        return F.struct(*[_literal(v).alias(n) for n, v in value.asDict().items()])
    return F.lit(value)


def shard_of(ord: Column, starts: list, kind: str) -> Column:
    """The shard of a place in order: two comparisons of about sqrt(shards) places each."""
    step = max(1, int(len(starts) ** 0.5))
    groups = [starts[i : i + step] for i in range(0, len(starts), step)]

    def literal(values):
        return F.array(*map(_literal, values)).cast(f"array<{kind}>")

    reached = lambda x: ord >= x
    group = F.size(F.filter(literal([g[0] for g in groups]), reached)) - 1
    inside = F.get(F.array(*[literal(g) for g in groups]), group)
    return (group * step + F.size(F.filter(inside, reached)) - 1).cast("int")


def ref_path_of(shard_id: Column, ref_base: str, prefix: str = "pack") -> Column:
    name = F.format_string(prefix.replace("%", "%%") + "-%04d.zip", shard_id)
    return name if ref_base == "" else F.concat(F.lit(ref_base + "/"), name)
