"""Whether packs at rest are whole: problems of shards, and manifests of their digests."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PackError
from ..sources.ranges import filesystem, list_files
from ..sources.shards import SECRET

MANIFEST = "pack.manifest.json"
PROBLEMS = "shard string, key string, kind string, detail string"


def _files(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    files = list_files(folder, pattern)
    if not files:
        raise PackError(f"no shards in {folder}")
    return spark.createDataFrame(files, "shard string, path string").repartition(min(len(files), 10_000))


def _digests(batches):
    for batch in batches:
        sums, sizes = [], []
        for path in batch.column("path").to_pylist():
            fs, at = filesystem(path)
            digest, n = hashlib.sha256(), 0
            with fs.open_input_stream(at, compression=None) as f:
                while piece := f.read(4 << 20):
                    digest.update(piece)
                    n += len(piece)
            sums.append(digest.hexdigest())
            sizes.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(sums, pa.string()), pa.array(sizes, pa.int64())], names=["shard", "sha256", "bytes"])


def digests(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """(shard, sha256, bytes) of the files as they are."""
    return _files(spark, folder, pattern).mapInArrow(_digests, "shard string, sha256 string, bytes long")


def write_manifest(spark: SparkSession, folder: str, force: bool = False) -> str:
    """Record the digests beside the shards; an existing record is only replaced by force."""
    path = os.path.join(folder, MANIFEST)
    if os.path.exists(path) and not force:
        raise FileExistsError(f"{path} exists; packs don't change")
    shards = {r.shard: {"sha256": r.sha256, "bytes": r.bytes} for r in digests(spark, folder).collect()}
    temporary = path + ".part"
    with open(temporary, "w") as f:
        f.write(json.dumps({"algorithm": "sha256", "shards": shards}, indent=1, sort_keys=True) + "\n")
    os.replace(temporary, path)
    return path


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, sha256, bytes) as recorded; no rows without a record."""
    path = os.path.join(folder, MANIFEST)
    rows = []
    if os.path.exists(path):
        with open(path) as f:
            rows = [(n, e["sha256"], e["bytes"]) for n, e in json.load(f)["shards"].items()]
    return spark.createDataFrame(rows, "shard string, sha256 string, bytes long")


def compare_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Problems: shards that are missing, not listed, or not as recorded. None if nothing is recorded."""
    if not os.path.exists(os.path.join(folder, MANIFEST)):
        return spark.createDataFrame([], PROBLEMS)
    then, now = manifest(spark, folder).alias("a"), digests(spark, folder).alias("b")
    both = then.join(now, F.col("a.shard") == F.col("b.shard"), "full")
    kind = F.when(F.col("b.shard").isNull(), "listed in manifest but missing").when(F.col("a.shard").isNull(), "not listed in manifest")
    kind = kind.when((F.col("a.sha256") != F.col("b.sha256")) | (F.col("a.bytes") != F.col("b.bytes")), "does not match manifest")
    found = both.select(F.coalesce("a.shard", "b.shard").alias("shard"), F.lit(None).cast("string").alias("key"), kind.alias("kind"))
    return found.where("kind is not null").withColumn("detail", F.lit(""))


def _members(first_only: bool):
    """Rows about every member: its size, and what is wrong with it."""

    def look(name, path):
        try:
            fs, at = filesystem(path)
            with fs.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
                broken = False
                for m in z.infolist():
                    if m.is_dir():
                        continue
                    problems = []
                    if m.compress_type != zipfile.ZIP_STORED:
                        problems.append("not STORED")
                    if m.flag_bits & SECRET:
                        problems.append("encrypted")
                    elif not (broken and first_only):
                        try:
                            crc = 0
                            with z.open(m) as f:
                                while piece := f.read(1 << 20):
                                    crc = zlib.crc32(piece, crc)
                        except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError) as e:
                            problems.append("CRC mismatch" if "CRC" in str(e) else f"unreadable: {e}")
                            broken = True
                    yield name, m.filename, m.file_size, "; ".join(problems) or None, None
        except Exception as e:  # a shard that can't be read is a finding
            yield name, None, 0, "unreadable", str(e)

    def run(batches):
        for batch in batches:
            for name, path in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist(), strict=True):
                rows = list(look(name, path))
                if rows:
                    columns = zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["shard", "key", "size", "problem", "detail"])

    return run


def verify(spark: SparkSession, folder: str, *, pattern: str = "*.zip", first_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(problems, totals): what is wrong with shards and members, and (blobs, bytes, shards).

    Every byte is read for its CRC, one task for each shard. first_only stops checking CRCs in a shard after the first
    bad one. Keys must differ within and across shards; the manifest, if there is one, must agree.
    """
    members = _files(spark, folder, pattern).mapInArrow(_members(first_only), "shard string, key string, size long, problem string, detail string")
    detail = F.coalesce("detail", F.lit("")).alias("detail")
    own = members.where("problem is not null").select("shard", "key", F.explode(F.split("problem", "; ")).alias("kind"), detail)
    twice = members.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("shard")).alias("shards"))
    twice = twice.where("n > 1").select(F.element_at("shards", -1).alias("shard"), "key", F.lit("duplicate key").alias("kind"), F.array_join("shards", ", ").alias("detail"))
    problems = own.unionByName(twice).unionByName(compare_manifest(spark, folder))
    totals = members.agg(F.count("key").alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.countDistinct("shard").alias("shards"))
    return problems, totals
