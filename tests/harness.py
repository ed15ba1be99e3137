"""A session for tests, and the comparison of a query with its SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def make_session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    return x


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = db.sql(sql)
    return list(got.columns), got.fetchall()


def ordered(columns: list[str], rows) -> list[tuple]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in at) for r in rows), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> int:
    columns, want = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns), (df.columns, columns)
    a, b = ordered(df.columns, df.collect()), ordered(columns, want)
    assert len(a) == len(b), (len(a), len(b))
    differ = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not differ, (len(differ), differ[:3])
    return len(a)
