"""What a binary column holds, from a systematic sample, and which columns could move into packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PackError
from ..functions.payload import kind_of
from .numbering import numbered


def measure(df: DataFrame, column: str, order: str, sample: int = 32) -> DataFrame:
    """One row (rows, mean_bytes, min_bytes, max_bytes, kinds) about every step-th row by `order`, `sample` at most, where
    step is rows // sample. Nulls aren't measured; the mean is rounded down; kinds are the first three by name."""
    rows = df.count()
    step = max(rows // sample, 1)
    # the places are found among the order column alone; payloads are joined for the sample only
    chosen = numbered(df.select(order), order).where((F.col("__row") % step == 0) & (F.col("__row") < step * sample)).select(order)
    payload = df.join(F.broadcast(chosen), order, "left_semi").select(F.col(column).alias("p")).where("p is not null")
    kinds = F.slice(F.sort_array(F.collect_set(F.when(F.octet_length("p") > 0, kind_of("p")))), 1, 3)
    size = F.octet_length("p").cast("long")
    found = payload.agg(F.count("*").alias("n"), F.floor(F.sum(size) / F.count("*")).alias("mean_bytes"), F.min(size).alias("min_bytes"), F.max(size).alias("max_bytes"), kinds.alias("kinds"))
    none = F.array(F.lit("empty")) if rows else F.array().cast("array<string>")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select(F.lit(rows).cast("long").alias("rows"), zero("mean_bytes"), zero("min_bytes"), zero("max_bytes"), F.when(F.col("n") == 0, none).otherwise(F.col("kinds")).alias("kinds"))


def candidates(df: DataFrame, order: str, columns: list[str] | None = None, sample: int = 32) -> DataFrame:
    """One row (column, chosen, rows, mean_bytes, min_bytes, max_bytes, kinds) for each binary column; chosen are those in
    `columns`, which have to be binary ones and can't be none at all."""
    there = [f.name for f in df.schema.fields if f.dataType == T.BinaryType()]
    wrong = [c for c in columns or [] if c not in there]
    if not there or wrong or columns == []:
        raise PackError(f"binary columns are {there}; asked for {columns}")
    each = [measure(df, c, order, sample).select(F.lit(c).alias("column"), F.lit(c in (columns or [])).alias("chosen"), "*") for c in there]
    return reduce(DataFrame.union, each)


def report(found: DataFrame) -> DataFrame:
    """A line of text for each row of candidates()."""
    sizes = F.format_string("%d bytes on average, from %d to %d", "mean_bytes", "min_bytes", "max_bytes")
    kinds = F.when(F.size("kinds") > 0, F.array_join("kinds", ", ")).otherwise("no payloads")
    goes = F.when(F.col("chosen"), "goes into packs").otherwise("stays")
    return found.select(F.concat_ws("; ", F.concat("column", F.lit(" "), goes), F.concat(F.col("rows").cast("string"), F.lit(" rows")), kinds, sizes).alias("line"))
