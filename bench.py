"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query's rows are all computed (written to Spark's noop sink); the best of two runs after one that warms up counts.
"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from packlake.operators.packs import Pack, write_pack
    from packlake.plans import catalog
    from packlake.plans.layout import Limits

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="packlake-bench-")
    docs = catalog._docs(spark, sf_dir)
    folder = f"{work}/media"
    planned = write_pack(docs, folder, limits=Limits(2_000_000)).cache()
    pack = Pack(spark, folder)
    docs.select("key", "payload").write.parquet(f"{work}/embedded")
    loose = f"{work}/loose"
    os.makedirs(loose)
    for r in docs.toLocalIterator():
        Path(loose, r.key.replace("/", "_")).write_bytes(r.payload)
    asked = planned.orderBy(F.xxhash64("key")).limit(4000).select("key", "ref").cache()
    asked.count()
    writes = iter(range(10**6))
    digest = lambda df, c: df.select(F.sum(F.crc32(c)))
    runs = {
        "pack_write": lambda: write_pack(docs, f"{work}/again-{next(writes)}", limits=Limits(2_000_000)),
        "pack_index": lambda: pack.index(),
        "pack_scan": lambda: digest(pack.blobs(), "payload"),
        "loose_scan": lambda: digest(spark.read.format("binaryFile").load(loose), "content"),
        "parquet_scan": lambda: digest(spark.read.parquet(f"{work}/embedded"), "payload"),
        "pack_random_4000": lambda: digest(pack.resolve(asked.select("ref"), "ref"), "payload"),
        "parquet_random_4000": lambda: digest(spark.read.parquet(f"{work}/embedded").join(asked.select("key"), "key", "left_semi"), "payload"),
        "plan_exact": lambda: catalog.QUERIES["pack_plan_exact"](spark, sf_dir),
        "verify": lambda: catalog.integrity.verify(spark, folder)[0],
        "ordered_scan_w3": lambda: pack.scan(worker=1, workers=3),
    }
    try:
        from packlake.llm import registry

        more = registry.queries()
    except ImportError:
        more = {}
    runs |= {name: (lambda f=f: f(spark, sf_dir)) for name, f in more.items()}
    found = {}
    for name, f in runs.items():
        times = []
        for _ in range(3 if name not in more else 2):
            begin = time.time()
            f().write.format("noop").mode("overwrite").save()
            times.append(time.time() - begin)
        found[name] = round(min(times[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
