"""Placement by a permutation-filled lookup table.

Each shard has an order of preference over the slots of a table whose size is prime: it starts at an offset and goes on
by a skip, both taken from digests of its name, so it visits every slot once. Shards take turns, each claiming its next
free slot, until the table is full; a shard of greater weight gets more turns. A row belongs to the slot that its key's
digest gives and so to the slot's shard. Shards differ by few slots in number, and when one leaves or joins, few slots
but its own change hands.

The table's size is a parameter and doesn't depend on the rows, which is why it is broadcast: placement takes constant
time for each row and nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SLOTS = 65_537
SHARDS = 96
#: The largest table that is broadcast.
MOST_SLOTS = 4_000_000


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preferences(name: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % slots, int(digest[16:31], 16) % (slots - 1) + 1


def fill(shards: dict[str, int] | list[str], slots: int = SLOTS) -> np.ndarray:
    """The number of the shard, in the order given, that owns each slot. shards: names, or names and whole weights."""
    weights = shards if isinstance(shards, dict) else dict.fromkeys(shards, 1)
    if not weights or len(weights) != len(shards) or min(weights.values()) < 1:
        raise ValueError("shards must have distinct names and weights of at least one")
    if not is_prime(slots) or not len(weights) <= slots <= MOST_SLOTS:
        raise ValueError(f"the table's size must be a prime of at most {MOST_SLOTS}, and no less than the number of shards")
    at, skip = (np.array(x, np.int64) for x in zip(*[preferences(s, slots) for s in weights], strict=True))
    turns = [i for r in range(max(weights.values())) for i, w in enumerate(weights.values()) if w > r]
    owner = [-1] * slots
    at, skip = at.tolist(), skip.tolist()
    left = slots
    while left:
        for i in turns:
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + skip[i]) % slots
            owner[slot] = i
            at[i] = slot
            left -= 1
            if not left:
                break
    return np.array(owner, np.int32)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo the table's size."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, owners: dict[str, np.ndarray], slot: str = "slot") -> DataFrame:
    """Lookup tables as a DataFrame of (slot, *owners); as long as the table, however many rows are placed."""
    import pandas as pd

    size = len(next(iter(owners.values())))
    if size > MOST_SLOTS:
        raise ValueError(f"a table of {size} slots is too large to broadcast")
    return spark.createDataFrame(pd.DataFrame({slot: np.arange(size, dtype=np.int32), **owners}))


def place(df: DataFrame, owners: dict[str, np.ndarray], key: str = "doc_id", spread: str | None = "text") -> DataFrame:
    """`df` with an int column `slot` and one int column for each of `owners` (name of the column: filled table).

    Rows of equal keys share a slot. Null keys have no common place: such rows are spread by the digest of the column
    `spread`, or all have the slot of an empty key where that is null too or not given. Empty keys are keys like any
    other. Repeated rows stay, an empty table gives an empty table, a column of a name to be added is an error.
    """
    low = {c.lower() for c in df.columns}
    if "slot" in low or low & {c.lower() for c in owners}:
        raise ValueError("the table already has a column of that name")
    size = len(next(iter(owners.values())))
    by = common.quoted(key).cast("string")
    if spread is not None:
        by = F.coalesce(by, common.quoted(spread).cast("string"))
    lookup = table_frame(df.sparkSession, owners)
    return df.withColumn("slot", slot_of(F.coalesce(by, F.lit("")), size)).join(F.broadcast(lookup), "slot").select(*[common.quoted(c) for c in df.columns], "slot", *owners)


def write_shards(df: DataFrame, path: str, owners: np.ndarray, key: str = "doc_id", files: int = 1) -> None:
    """Write `df` as Parquet in one folder for each shard, each of about `files` files; rows of a hot shard go to
    several tasks, by a second digest of the row."""
    placed = place(df, {"shard": owners}, key)
    salt = F.pmod(F.xxhash64(*[common.quoted(c) for c in df.columns if not dict(df.dtypes)[c].startswith("map")]), F.lit(files))
    placed.drop("slot").repartition("shard", salt).write.partitionBy("shard").parquet(path)


def names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document among 96 shards, and its shard after the last of them has left."""
    every = names(SHARDS)
    owners = {"shard": fill(every), "shard_after": fill(every[:-1])}
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return place(docs, owners).drop("text")


def _oracle() -> str:
    """The table is filled here too, in SQL's place: by listing every shard's whole order of preference."""

    def listed(n: int) -> str:
        orders = [[(o + j * s) % SLOTS for j in range(SLOTS)] for o, s in (preferences(x, SLOTS) for x in names(n))]
        owner, at = {}, [0] * n
        while len(owner) < SLOTS:
            for i in range(n):
                while at[i] < SLOTS and orders[i][at[i]] in owner:
                    at[i] += 1
                if at[i] < SLOTS:
                    owner[orders[i][at[i]]] = i
        return ",".join(str(owner[k]) for k in range(SLOTS))

    return f"""
        WITH t AS (SELECT '{listed(SHARDS)}' AS a, '{listed(SHARDS - 1)}' AS b),
        l AS (SELECT unnest(generate_series(0, {SLOTS - 1}))::INTEGER AS slot, unnest(string_split(a, ','))::INTEGER AS shard,
                     unnest(string_split(b, ','))::INTEGER AS shard_after FROM t),
        d AS (SELECT doc_id, (('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), text, ''))[1:15])::BIGINT % {SLOTS})::INTEGER AS slot FROM documents)
        SELECT doc_id, slot, shard, shard_after FROM d JOIN l USING (slot)"""


QUERIES = {"op1_sharding": op1_sharding}


def oracles() -> dict[str, str]:
    return {"op1_sharding": _oracle()}
