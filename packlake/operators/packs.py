"""Writing packs and resolving references to what is in them."""

from __future__ import annotations

import json
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import PackError, UnknownBlob
from ..functions import refs
from ..plans.layout import Limits, plan, ref_path_of, shard_of, shard_starts
from ..sources.formats import BYTES, ROWS, register
from ..sources.ranges import Handles, Ranges, carry, list_files, list_states, with_options
from ..sources.shards import Shard

#: Shards that references may name for only these to be listed; beyond, all are.
MOST_NAMED = 10_000
#: References into one shard are dealt to tasks by stretches of it this long, so that a hot shard is read by many.
STRETCH = 64 << 20


def check_keys(blobs: DataFrame) -> None:
    """Raise for keys that may not name blobs or occur twice, naming a few of them."""
    bad = blobs.select("key", refs.key_problem("key").alias("problem")).where("problem is not null").limit(5).collect()
    if bad:
        raise ValueError("keys that may not name blobs: " + ", ".join(f"{r.key!r} ({r.problem})" for r in bad))
    twice = blobs.groupBy("key").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError("duplicate keys: " + ", ".join(repr(r.key) for r in twice))


def with_sizes(blobs: DataFrame) -> DataFrame:
    """Blobs that are there, with their sizes."""
    if "payload" in blobs.columns:
        blobs = blobs.where("payload is not null").withColumn("size", F.octet_length("payload").cast("long"))
    return blobs


def write_planned(blobs: DataFrame, starts: list, folder: str, prefix: str = "pack") -> None:
    """Write blobs, shuffled once by the shard that `starts` (the first place of each in order) gives."""
    spark = register(blobs.sparkSession)
    if not starts:
        raise PackError("nothing to pack")
    content = [c for c in ("payload", "path", "size", "offset") if c in blobs.columns]
    dealt = blobs.withColumn("shard_id", shard_of(F.col("ord"), starts, dict(blobs.dtypes)["ord"])).select("shard_id", "ord", "key", *content)
    n = min(len(starts), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    dealt = dealt.repartition(n, "shard_id").sortWithinPartitions("shard_id", "ord").drop("ord")
    dealt.write.format("pack").option("path", folder).option("prefix", prefix).mode("append").save()


def write_pack(blobs: DataFrame, folder: str, *, ref_base: str | None = None, prefix: str = "pack", limits: Limits = Limits(), layout: str = "exact") -> DataFrame:
    """Write blobs into a new pack; returns (ord, key, size, shard_id, ref) for each.

    blobs: (ord, key, payload) or (ord, key, path, size[, offset]), and group or not. ord orders them and has no ties. Sizes, keys
    and groups are planned first; then payloads are shuffled once, by shard. A null payload is no blob and is left out;
    an empty one is a blob of no bytes. Nothing appears under a shard's name before all tasks have succeeded.
    """
    blobs = with_sizes(blobs)
    check_keys(blobs)
    starts = shard_starts(plan(blobs, limits, layout))
    write_planned(blobs, starts, folder, prefix)
    base = refs.normal_base(ref_base, folder)
    found = blobs.select("ord", "key", "size").withColumn("shard_id", shard_of(F.col("ord"), starts, dict(blobs.dtypes)["ord"]))
    return found.withColumn("ref", refs.make_ref("key", ref_path_of(F.col("shard_id"), "" if base == "." else base, prefix)))


class Pack:
    """A folder of shards. Nothing is opened before it is needed, and then only the shards that are."""

    def __init__(
        self, spark: SparkSession, folder: str, *, ref_base: str | None = None, pattern: str = "*.zip", validate: bool = False, options: dict | None = None
    ):
        """options: of the store that holds the folder, for remote ones."""
        self.ref_base = refs.default_base(folder) if ref_base is None else ref_base
        self.spark, self.folder, self.pattern = register(spark), with_options(folder.rstrip("/"), options), pattern
        files = list_files(self.folder, pattern)
        if not files:
            raise PackError(f"no shards in {folder}")
        self.paths = dict(files)
        self._counted: tuple[list, dict[str, int]] | None = None
        if validate:
            self.index(validate=True).agg(F.count("*")).collect()
            self.check_unique()

    @classmethod
    def from_fs(cls, spark: SparkSession, fs, folder: str, *, ref_base: str | None = None, **how) -> Pack:
        """A pack on a ready filesystem, which tasks get a copy of."""
        base = refs.default_base(folder) if ref_base is None else ref_base
        return cls(spark, carry(fs, folder.rstrip("/")), ref_base=base, **how)

    def assignments(self, workers: int) -> DataFrame:
        """(worker, position, shard, ordinal, key, size) of all members: which of so many workers scan() gives each to."""
        position, total = F.col("position"), self.index().count()
        return self.scan(payload=False).select(F.floor(((position + 1) * workers - 1) / max(1, total)).cast("long").alias("worker"), "*")

    def _reader(self, name: str, shards, **options):
        reader = self.spark.read.format(name).option("pattern", self.pattern)
        if shards is not None:
            reader = reader.option("shards", json.dumps(sorted(shards)))
        for k, v in options.items():
            reader = reader.option(k, v)
        return reader.load(self.folder)

    def index(self, shards=None, validate: bool = False) -> DataFrame:
        """One row for each member, without payloads."""
        return self._reader("pack_index", shards, validate=str(validate).lower())

    def blobs(self, shards=None, mode: str = "strict") -> DataFrame:
        """One row for each member, with its payload."""
        return self._reader("pack_blobs", shards, mode=mode)

    def keys(self) -> DataFrame:
        self.check_unique()
        return self.index().select("key")

    def duplicate_keys(self) -> DataFrame:
        """Keys of several members, and how many."""
        return self.index().groupBy("key").agg(F.count("*").alias("n")).where("n > 1")

    def check_unique(self) -> None:
        found = self.duplicate_keys().limit(3).collect()
        if found:
            raise PackError("duplicate key in the pack: " + ", ".join(repr(r.key) for r in found))

    def _counts(self) -> dict[str, int]:
        """Members of each shard, of a pack without duplicate keys. Read again only when names, sizes or times of the files
        have changed, so that the scans of several workers read the whole index once."""
        state = list_states(self.folder, self.pattern)
        if self._counted is None or self._counted[0] != state or any(s[3] is None for s in state):
            self.check_unique()
            self._counted = state, {r[0]: r[1] for r in self.index().groupBy("shard").agg(F.count("*")).collect()}
        return self._counted[1]

    def _located(self, df: DataFrame, column: str, unique: bool) -> DataFrame:
        """`df` with __shard, __key and where the member is, null where there is none."""
        ref = F.col(column)
        whole = refs.is_ref(ref)
        own = whole & refs.base_matches(ref, self.ref_base)
        df = df.withColumn("__key", F.when(own, refs.ref_key(ref)).when(~whole, ref)).withColumn("__shard", F.when(own, refs.ref_shard(ref)))
        asked = df.where(ref.isNotNull()).select((~whole).alias("bare"), "__shard").distinct()
        asked = asked.orderBy(F.desc("bare")).limit(MOST_NAMED + 2).collect()
        bare = bool(asked) and asked[0].bare
        named = {r[1] for r in asked if r[1] is not None}
        shards = [s for s in named if s in self.paths] if not bare and len(named) <= MOST_NAMED else None
        if bare and unique:
            self.check_unique()
        index = self.index(shards).select("shard", F.col("key").alias("__ikey"), "ordinal", "header_offset", "size")
        index = index.withColumnsRenamed({"shard": "__ishard", "ordinal": "__ordinal", "header_offset": "__offset", "size": "__size"})
        if not bare:
            return df.join(index, (df["__key"] == index["__ikey"]) & (df["__shard"] == index["__ishard"]), "left")
        full = df.where(F.col("__shard").isNotNull()).join(index, (F.col("__key") == F.col("__ikey")) & (F.col("__shard") == F.col("__ishard")), "left")
        rest = df.where(F.col("__shard").isNull()).join(index, F.col("__key") == F.col("__ikey"), "left")
        return full.unionByName(rest)

    def resolve(self, df: DataFrame, column: str, *, out: str = "payload", mode: str = "strict", start: Column | None = None, length: Column | None = None) -> DataFrame:
        """`df` with the payload that `column` (references, or bare keys) names, or a range of it.

        References are joined with the index, and only they are shuffled: payloads are read afterwards, by tasks that
        have the same stretches of shards and read them in order. Null references have null payloads. strict: anything
        else that names nothing, or can't be read, is an error; lenient: it has a null payload and its class and text in
        <out>_error_class and <out>_error. Repeated references are read as often as they occur.
        """
        if mode not in ("strict", "lenient"):
            raise ValueError(f"no such mode: {mode}")
        columns = df.columns
        if {out, f"{out}_error", f"{out}_error_class"} & set(columns):
            raise ValueError(f"the table already has a column {out}")
        whole = F.lit(None).cast("long")
        df = df.withColumn("__start", whole if start is None else start.cast("long")).withColumn("__length", whole if length is None else length.cast("long"))
        found = self._located(df.where(F.col(column).isNotNull()), column, unique=True)
        stretch = F.coalesce((F.col("__offset") / STRETCH).cast("int"), F.pmod(F.hash("__key"), F.lit(64)))
        found = found.repartition("__ishard", stretch).sortWithinPartitions("__ishard", "__offset")
        schema = df.select(*columns).schema.add(out, "binary").add(f"{out}_error_class", "string").add(f"{out}_error", "string")
        read = found.select(*columns, F.col(column).alias("__ref"), "__ishard", "__ordinal", "__start", "__length").mapInArrow(
            _reader(dict(self.paths), len(columns), mode == "lenient", schema.names), schema
        )
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[len(columns) :]]
        read = read.union(df.where(F.col(column).isNull()).select(*columns, *none))  # as they are, where they are
        return read if mode == "lenient" else read.drop(f"{out}_error_class", f"{out}_error")

    def contains(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of `df` whose reference or key names a blob of this pack."""
        return self._located(df, column, unique=True).where("__ordinal is not null").select(*df.columns)

    def missing(self, df: DataFrame, column: str) -> DataFrame:
        """The rows whose reference or key is not null and names nothing here."""
        return self._located(df, column, unique=True).where(F.col("__ordinal").isNull() & F.col(column).isNotNull()).select(*df.columns)

    def read_many(self, items: list[str]) -> list[bytes]:
        """Payloads in the order asked for; repeated items are allowed. All of them come to the driver: for more than fits
        there, resolve() a table."""
        asked = self.spark.createDataFrame(list(enumerate(items)), "n long, item string")
        return [bytes(r.payload) for r in self.resolve(asked, "item").orderBy("n").select("payload").collect()]

    def read(self, item: str) -> bytes:
        """One payload, read right here: a reference opens its own shard alone."""
        shard, i = self._find(item)
        try:
            return shard.read(i)
        finally:
            shard.close()

    def open(self, item: str):
        """One payload as a seekable file."""
        shard, i = self._find(item)
        return shard.open(i)

    def _find(self, item: str) -> tuple[Shard, int]:
        if item.startswith(refs.SCHEME):
            key, path = refs.split_ref(item)
            folder, _, name = path.rpartition("/")
            if (self.ref_base and folder != self.ref_base) or name not in self.paths:
                raise UnknownBlob(f"not of this pack: {item!r}")
        else:
            self.check_unique()
            key = item
            row = self.index().where(F.col("key") == key).select("shard").first()
            if row is None:
                raise UnknownBlob(f"no blob {item!r}")
            name = row[0]
        shard = Shard(self.paths[name])
        return shard, shard.index_of(key)

    def scan_until(self, max_bytes: int, *, shuffle: bool = False, seed: int = 0, payload: bool = True) -> DataFrame:
        """The members of an ordered scan that begin before max_bytes of payloads have passed: (position, shard, ordinal,
        key, size[, payload]). Shards that come later aren't opened for their payloads."""
        self.check_unique()
        index = self.index()
        totals = {r[0]: (r[1], r[2]) for r in index.groupBy("shard").agg(F.count("*"), F.sum("size")).collect()}
        order = sorted(self.paths)
        if shuffle:
            random.Random(seed).shuffle(order)
        begins, rows, passed = [], 0, 0
        for s in order:
            if passed >= max_bytes:
                break
            begins.append((s, rows, passed))
            rows, passed = rows + totals.get(s, (0, 0))[0], passed + (totals.get(s, (0, 0))[1] or 0)
        first = self.spark.createDataFrame(begins, "shard string, first long, passed long")
        earlier = Window.partitionBy("shard").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
        chosen = index.join(F.broadcast(first), "shard").withColumn("before", F.col("passed") + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        chosen = chosen.where(F.col("before") < max_bytes).withColumn("position", F.col("first") + F.col("ordinal"))
        chosen = chosen.select("position", "shard", "ordinal", "key", "size")
        if not payload:
            return chosen
        blobs = self.blobs([s for s, *_ in begins]).select("shard", "ordinal", "payload")
        return chosen.join(blobs, ["shard", "ordinal"]).select("position", "shard", "ordinal", "key", "size", "payload")

    def scan(self, *, shuffle: bool = False, seed: int = 0, worker: int = 0, workers: int = 1, payload: bool = True) -> DataFrame:
        """Members in shard order (by name, or shuffled by the seed), then directory order, with their position.

        Worker w of W has the positions from w * T // W to (w + 1) * T // W: all workers together have every member
        once, and one may have none. Only the counts of the shards come to the driver.
        """
        if not 0 <= worker < workers:
            raise ValueError("worker must be one of the workers")
        counts = self._counts()
        order = sorted(self.paths)
        if shuffle:
            random.Random(seed).shuffle(order)
        total = sum(counts.values())
        lo, hi = worker * total // workers, (worker + 1) * total // workers
        begins, at = [], 0
        for s in order:
            if at < hi and at + counts.get(s, 0) > lo:
                begins.append((s, at))
            at += counts.get(s, 0)
        first = self.spark.createDataFrame(begins, "shard string, first long")
        rows = (self.blobs if payload else self.index)([s for s, _ in begins] if begins else [])
        rows = rows.join(F.broadcast(first), "shard").withColumn("position", F.col("first") + F.col("ordinal"))
        keep = ["position", "shard", "ordinal", "key", "size", *(["payload"] if payload else [])]
        return rows.where((F.col("position") >= lo) & (F.col("position") < hi)).select(*keep)


def read_spans(df: DataFrame, path: str = "path", offset: str = "data_offset", size: str = "size", out: str = "payload") -> DataFrame:
    """`df` with the bytes of a file from an offset on, such as a tar index has; stretches of files are read in order."""
    columns = df.columns
    if out in columns:
        raise ValueError(f"the table already has a column {out}")
    dealt = df.repartition(path, (F.col(offset) / STRETCH).cast("int")).sortWithinPartitions(path, offset)
    schema = df.schema.add(out, "binary")

    def run(batches):
        handles = Handles(Ranges)
        try:
            for batch in batches:
                asked = list(zip(*(c.to_pylist() for c in batch.columns[-3:]), strict=True))
                rows = batch.select(batch.schema.names[:-3])
                at = 0
                while at < len(asked):
                    got, held, begin = [], 0, at
                    while at < len(asked) and len(got) < ROWS and held < BYTES:
                        where, start, n = asked[at]
                        data = None if where is None else handles.get(where).read(start, n)
                        if data is not None and len(data) != n:
                            raise PackError(f"{where}: short read, {len(data)} of {n} bytes")
                        got.append(data)
                        held += len(data or b"")
                        at += 1
                    part = rows.slice(begin, at - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], names=schema.names)
        finally:
            handles.close()

    asked = dealt.select(*columns, F.col(path).alias("__path"), F.col(offset).cast("long").alias("__offset"), F.col(size).cast("long").alias("__size"))
    return asked.mapInArrow(run, schema)


def _reader(paths: dict[str, str], n_keep: int, lenient: bool, names: list[str]):
    def read(handles, ref, shard, ordinal, start, length):
        if ref is None:
            return None, None, None
        try:
            if shard is None:
                raise UnknownBlob(f"nothing in this pack is named {ref!r}")
            opened = handles.get(shard)
            if start is None and length is None:
                return opened.read(ordinal), None, None
            return opened.read_range(ordinal, start or 0, opened.span(ordinal)[1] if length is None else length), None, None
        except (PackError, ValueError, OSError) as e:
            if not lenient:
                raise
            return None, type(e).__name__, str(e)

    def run(batches):
        handles = Handles(lambda name: Shard(paths[name]))
        try:
            for batch in batches:
                asked = list(zip(*(c.to_pylist() for c in batch.columns[n_keep:]), strict=True))
                at = 0
                while at < len(asked):
                    got, held, begin = [], 0, at
                    while at < len(asked) and len(got) < ROWS and held < BYTES:
                        got.append(read(handles, *asked[at]))
                        held += len(got[-1][0] or b"")
                        at += 1
                    kept = [c.slice(begin, at - begin) for c in batch.columns[:n_keep]]
                    payload, kind, text = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(payload, pa.binary()), pa.array(kind, pa.string()), pa.array(text, pa.string())], names=names)
        finally:
            handles.close()

    return run
