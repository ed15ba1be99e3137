"""Numbers for rows in the order of a column, without sorting all of them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.layout import shard_of


def numbered(df: DataFrame, order: str) -> DataFrame:
    """`df` with __row, from 0 in the order of a column: ranges are sorted and counted, then offset; no single task."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = df.select(order).repartitionByRange(n, order).groupBy(F.spark_partition_id()).agg(F.min(order).alias("m"))
    limits = [r[0] for r in ranges.orderBy("m").select("m").collect()]
    kind = dict(df.dtypes)[order]
    part = F.greatest(shard_of(F.col(order), limits or [None], kind), F.lit(0))
    counts = dict(df.groupBy(part.alias("p")).count().collect())  # one row for each range
    before, total = [], 0
    for p in range(len(limits) or 1):
        before.append(total)
        total += counts.get(p, 0)
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    first = F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("__part"))
    return df.withColumn("__part", part).withColumn("__row", (first + inner).cast("long")).drop("__part")
