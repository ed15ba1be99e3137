"""Named queries over the driver's tables, and SQL that gives the same rows.

Packs are built in a folder of the run; within a session, queries over the same pack share it.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import payload as payloads
from ..functions import refs
from ..operators import convert, integrity, measure
from ..operators.packs import Pack, read_spans, write_pack, write_planned
from ..sources.formats import register
from .layout import Limits, plan

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MAX, COUNT = 200_000, 100
_BUILT: dict[tuple, object] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _workspace(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one; only where all runs on one machine, a temporary folder does too."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or ""
    local = shared.removeprefix("file://") if shared.startswith(("/", "file://")) else None
    if local:
        os.makedirs(local, exist_ok=True)
    elif not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("packs of these queries need spark.checkpoint.dir in a folder that all machines share")
    return tempfile.mkdtemp(prefix="packlake-", dir=local)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    key = F.concat(F.lit("doc/"), F.format_string("%06d", "doc_id"), F.lit(".txt"))
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), key.alias("key"), F.col("text").cast("binary").alias("payload"))


def _conversations(spark, sf_dir):
    key = F.concat(F.lit("conv/"), F.format_string("%06d", "conv_id"), F.lit("/"), F.format_string("%02d", "turn"), F.lit(".txt"))
    place = F.struct("conv_id", "turn")
    return _table(spark, sf_dir, "conversations").select(
        place.alias("ord"), key.alias("key"), F.col("text").cast("binary").alias("payload"), F.col("conv_id").cast("string").alias("group")
    )


def _pages(spark, sf_dir):
    key = F.concat(F.lit("page/"), F.format_string("%06d", "page_id"), F.lit(".html"))
    return _table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), key.alias("key"), F.col("html").cast("binary").alias("payload"))


def _built(spark: SparkSession, sf_dir: str, blobs=_docs) -> tuple[Pack, DataFrame]:
    """A pack of a table, and (ord, key, size, shard_id, ref) of its blobs."""
    key = (spark.sparkContext.applicationId, sf_dir, blobs.__name__)
    if key not in _BUILT:
        folder = os.path.join(_workspace(spark), "media")
        planned = write_pack(blobs(spark, sf_dir), folder, ref_base="media", limits=Limits(MAX))
        _BUILT[key] = Pack(spark, folder), planned
    return _BUILT[key]


_DOC_KEY = "printf('doc/%06d.txt', doc_id)"
_DOC = f"o AS (SELECT row_number() OVER (ORDER BY doc_id) rn, doc_id, {_DOC_KEY} AS key, strlen(text)::BIGINT AS size, strlen(text) + 76 + 2 * strlen({_DOC_KEY}) AS m, NULL AS g FROM documents)"
_CONV_KEY = "printf('conv/%06d/%02d.txt', conv_id, turn)"
_CONV = f"o AS (SELECT row_number() OVER (ORDER BY conv_id, turn) rn, conv_id, turn, {_CONV_KEY} AS key, strlen(text)::BIGINT AS size, strlen(text) + 76 + 2 * strlen({_CONV_KEY}) AS m, conv_id AS g FROM conversations)"


def _fold(o: str, most: int, count: int = 65_535, fill: float = 0.5) -> str:
    """The layout as a recursive query; g is null throughout, or never."""
    begins = f"CASE WHEN o.g IS NOT NULL AND o.g <> w.grp AND w.b >= {most * fill} THEN 1 ELSE 0 END"
    return f"""WITH RECURSIVE {o},
        w AS (SELECT rn, 0 shard, 22 + m b, 1 c, g grp, 0 gs, 0 sp FROM o WHERE rn = 1 UNION ALL
          SELECT rn, s2 + r2, CASE WHEN r2 = 1 THEN 22 ELSE b1 END + m, CASE WHEN r2 = 1 THEN 1 ELSE c1 + 1 END, g,
                 CASE WHEN g <> grp THEN s2 + r2 ELSE gs END, sp + CASE WHEN r2 = 1 AND g = grp AND gs = s2 THEN 1 ELSE 0 END
          FROM (SELECT *, CASE WHEN c1 >= {count} OR (c1 > 0 AND b1 + m > {most}) THEN 1 ELSE 0 END r2 FROM
            (SELECT *, shard + r1 s2, CASE WHEN r1 = 1 THEN 22 ELSE b END b1, CASE WHEN r1 = 1 THEN 0 ELSE c END c1 FROM
              (SELECT o.rn, o.m, o.g, w.shard, w.b, w.c, w.grp, w.gs, w.sp, {begins} r1 FROM w JOIN o ON o.rn = w.rn + 1)))),
        p AS (SELECT o.*, w.shard, w.b, w.sp, printf('pack-%04d.zip', w.shard) AS name,
                     'zip://' || o.key || '::media/' || printf('pack-%04d.zip', w.shard) AS ref FROM o JOIN w USING (rn))"""


def _planned(df: DataFrame) -> DataFrame:
    return df.select("key", F.col("shard_id").cast("int").alias("shard"), F.col("shard_bytes").alias("bytes"), F.col("splits"))


_PLAN = "SELECT key, shard::INTEGER AS shard, b::BIGINT AS bytes, sp::BIGINT AS splits FROM p"


# references


@_query("ref_make", f"SELECT doc_id, 'zip://' || {_DOC_KEY} || '::media/pack-0000.zip' AS ref FROM documents")
def _(spark, sf_dir):
    key = F.concat(F.lit("doc/"), F.format_string("%06d", "doc_id"), F.lit(".txt"))
    return _table(spark, sf_dir, "documents").select("doc_id", refs.make_ref(key, F.lit("media/pack-0000.zip")).alias("ref"))


@_query("ref_parse", "SELECT page_id, url AS key, 'a::b/' || page_id || '.zip' AS path, page_id || '.zip' AS shard, 'a::b' AS dir FROM pages")
def _(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    ref = refs.make_ref("url", F.concat(F.lit("a::b/"), F.col("page_id").cast("string"), F.lit(".zip")))
    return pages.withColumn("ref", ref).select("page_id", refs.ref_key("ref").alias("key"), refs.ref_path("ref").alias("path"), refs.ref_shard("ref").alias("shard"), refs.ref_dir("ref").alias("dir"))


_MALFORMED = "CASE doc_id % 6 WHEN 0 THEN 'zip://::p.zip' WHEN 1 THEN 'zip://k::' WHEN 2 THEN 'zip://k' WHEN 3 THEN 'http://k::p.zip' WHEN 4 THEN 'zip://a' || chr(10) || 'b::p.zip' ELSE 'zip://a::b::c.zip' END"


@_query(
    "ref_parse_malformed",
    "SELECT doc_id, doc_id % 6 >= 4 AS is_ref, CASE doc_id % 6 WHEN 4 THEN 'a' || chr(10) || 'b' WHEN 5 THEN 'a' END AS key, "
    "CASE doc_id % 6 WHEN 4 THEN 'p.zip' WHEN 5 THEN 'b::c.zip' END AS path FROM documents",
)
def _(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("ref", F.expr(_MALFORMED))
    return docs.select("doc_id", refs.is_ref("ref").alias("is_ref"), refs.ref_key("ref").alias("key"), refs.ref_path("ref").alias("path"))


_KEYS = "CASE doc_id % 12 WHEN 0 THEN '' WHEN 1 THEN ' a' WHEN 2 THEN 'a' || chr(160) WHEN 3 THEN 'a/../b' WHEN 4 THEN './a' WHEN 5 THEN '/a' WHEN 6 THEN 'a//b' WHEN 7 THEN 'a::b' WHEN 8 THEN 'a/' WHEN 9 THEN 'a' || chr(92) || 'b' WHEN 10 THEN 'a b/c.d' ELSE 'x/' || doc_id || '..y' END"


@_query("key_valid", "SELECT doc_id, doc_id % 12 >= 10 AS valid FROM documents")
def _(spark, sf_dir):
    key = F.expr(_KEYS.replace("doc_id || '..y'", "cast(doc_id AS string) || '..y'"))
    return _table(spark, sf_dir, "documents").select("doc_id", refs.valid_key(key).alias("valid"))


# layout and writing


def _sized(df: DataFrame) -> DataFrame:
    return df.withColumn("size", F.octet_length("payload"))


@_query("pack_plan_exact", f"{_fold(_DOC, MAX)} {_PLAN}")
def _(spark, sf_dir):
    return _planned(plan(_sized(_docs(spark, sf_dir)), Limits(MAX)))


@_query("pack_plan_count_limit", f"{_fold(_DOC, 1 << 30, COUNT)} {_PLAN}")
def _(spark, sf_dir):
    return _planned(plan(_sized(_docs(spark, sf_dir)), Limits(1 << 30, COUNT)))


@_query("pack_plan_singleton", f"{_fold(_DOC, 2_000)} {_PLAN}")
def _(spark, sf_dir):
    return _planned(plan(_sized(_docs(spark, sf_dir)), Limits(2_000)))


@_query("pack_plan_groups", f"{_fold(_CONV, 5_000, fill=0.5)} {_PLAN}")
def _(spark, sf_dir):
    return _planned(plan(_sized(_conversations(spark, sf_dir)), Limits(5_000, group_fill=0.5)))


@_query("pack_plan_groups_full", f"{_fold(_CONV, 20_000, 30, 0.9)} {_PLAN}")
def _(spark, sf_dir):
    return _planned(plan(_sized(_conversations(spark, sf_dir)), Limits(20_000, 30, 0.9)))


@_query("pack_plan_parallel", "SELECT count(*)::BIGINT AS blobs, sum(strlen(text))::BIGINT AS bytes, true AS fits FROM documents")
def _(spark, sf_dir):
    found = plan(_sized(_docs(spark, sf_dir)), Limits(MAX), "parallel")
    by_shard = found.groupBy("shard_id").agg(F.max("shard_bytes").alias("used"), F.count("*").alias("n"), F.sum("size").alias("bytes"))
    fits = F.every((F.col("used") <= MAX) | (F.col("n") == 1))
    return by_shard.agg(F.sum("n").cast("long").alias("blobs"), F.sum("bytes").cast("long").alias("bytes"), fits.alias("fits"))


@_query("pack_roundtrip_docs", f"{_fold(_DOC, MAX)} SELECT doc_id, ref, sha256(text) AS sha256, size AS n_bytes FROM p JOIN documents USING (doc_id)")
def _(spark, sf_dir):
    pack, planned = _built(spark, sf_dir)
    read = pack.resolve(planned.select(F.col("ord").alias("doc_id"), "ref"), "ref")
    return read.select("doc_id", "ref", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("n_bytes"))


@_query("pack_roundtrip_pages", "SELECT page_id, sha256(html) AS sha256, strlen(html)::BIGINT AS n_bytes FROM pages")
def _(spark, sf_dir):
    pack, planned = _built(spark, sf_dir, _pages)
    read = pack.resolve(planned.select(F.col("ord").alias("page_id"), "key"), "key")  # by bare keys
    return read.select("page_id", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("n_bytes"))


@_query("pack_roundtrip_conversations", f"{_fold(_CONV, MAX)} SELECT p.conv_id, p.turn, ref, sha256(text) AS sha256 FROM p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn")
def _(spark, sf_dir):
    pack, planned = _built(spark, sf_dir, _conversations)
    read = pack.resolve(planned.select("ord.conv_id", "ord.turn", "ref"), "ref")
    return read.select("conv_id", "turn", "ref", F.sha2("payload", 256).alias("sha256"))


def _some_null(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    empty = F.unhex(F.lit(""))
    return docs.withColumn("payload", F.when(F.col("ord") % 7 == 0, None).when(F.col("ord") % 7 == 1, empty).otherwise(F.col("payload")))


@_query("pack_roundtrip_nulls", "SELECT doc_id, doc_id % 7 <> 0 AS packed, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN sha256('') ELSE sha256(text) END AS sha256 FROM documents")
def _(spark, sf_dir):
    pack, planned = _built(spark, sf_dir, _some_null)
    docs = _table(spark, sf_dir, "documents").select("doc_id").join(planned.select(F.col("ord").alias("doc_id"), "ref"), "doc_id", "left")
    return pack.resolve(docs, "ref").select("doc_id", F.col("ref").isNotNull().alias("packed"), F.sha2("payload", 256).alias("sha256"))


# listing and resolving


@_query("shard_stats", f"{_fold(_DOC, MAX)} SELECT name AS shard, count(*)::BIGINT AS blobs, sum(size)::BIGINT AS bytes FROM p GROUP BY name")
def _(spark, sf_dir):
    return _built(spark, sf_dir)[0].index().groupBy("shard").agg(F.count("*").alias("blobs"), F.sum("size").alias("bytes"))


@_query("index_ls", f"{_fold(_DOC, MAX)} SELECT size, name AS shard, key FROM p")
def _(spark, sf_dir):
    return _built(spark, sf_dir)[0].index().select("size", "shard", "key").orderBy("shard", "ordinal")


@_query("index_one_shard", f"{_fold(_DOC, MAX)} SELECT size, key FROM p WHERE shard = 1")
def _(spark, sf_dir):
    return _built(spark, sf_dir)[0].index().where("shard = 'pack-0001.zip'").select("size", "key")


@_query("index_validated", f"{_fold(_DOC, MAX)} SELECT count(*)::BIGINT AS members, sum(size)::BIGINT AS bytes, true AS in_bounds FROM p")
def _(spark, sf_dir):
    index = _built(spark, sf_dir)[0].index(validate=True)
    fits = F.col("header_offset") + 30 + F.octet_length("key") + F.col("size") <= F.col("next_bound")
    return index.agg(F.count("*").alias("members"), F.sum("size").alias("bytes"), F.every(fits & (F.col("header_offset") >= F.col("prev_min_end"))).alias("in_bounds"))


@_query("resolve_refs_join_labels", "SELECT quality, count(*)::BIGINT AS n, sum(strlen(text))::BIGINT AS bytes FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def _(spark, sf_dir):
    pack, planned = _built(spark, sf_dir)
    labels = _table(spark, sf_dir, "labels").join(planned.select(F.col("ord").alias("doc_id"), "ref"), "doc_id")
    read = pack.resolve(labels.select("quality", "ref"), "ref")
    return read.groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload").cast("long")).alias("bytes"))


def _asked(planned: DataFrame) -> DataFrame:
    """References of which some are of another folder, another shard, or of nothing."""
    kind = F.col("ord") % 4
    ref = F.when(kind == 1, F.regexp_replace("ref", "::media/", "::elsewhere/")).when(kind == 2, F.regexp_replace("ref", "doc/", "no/")).when(kind == 3, F.col("key"))
    return planned.select(F.col("ord").alias("doc_id"), ref.otherwise(F.col("ref")).alias("ref"))


@_query("resolve_foreign", "SELECT doc_id, doc_id % 4 NOT IN (1, 2) AS found, CASE WHEN doc_id % 4 IN (1, 2) THEN 'UnknownBlob' END AS error_class FROM documents")
def _(spark, sf_dir):
    pack, planned = _built(spark, sf_dir)
    read = pack.resolve(_asked(planned), "ref", mode="lenient")
    return read.select("doc_id", F.col("payload").isNotNull().alias("found"), F.col("payload_error_class").alias("error_class"))


@_query("resolve_missing", "SELECT doc_id FROM documents WHERE doc_id % 4 IN (1, 2)")
def _(spark, sf_dir):
    pack, planned = _built(spark, sf_dir)
    return pack.missing(_asked(planned), "ref").select("doc_id")


@_query("contains_semi", "SELECT doc_id FROM documents WHERE doc_id % 4 NOT IN (1, 2)")
def _(spark, sf_dir):
    pack, planned = _built(spark, sf_dir)
    return pack.contains(_asked(planned), "ref").select("doc_id")


@_query("keys", f"SELECT {_DOC_KEY} AS key FROM documents")
def _(spark, sf_dir):
    return _built(spark, sf_dir)[0].keys()


@_query("pack_len", "SELECT count(*)::BIGINT AS n FROM documents")
def _(spark, sf_dir):
    return _built(spark, sf_dir)[0].index().agg(F.count("*").alias("n"))


def _range(name: str, start: str, length: str, sql: str):
    @_query(name, f"WITH b AS (SELECT doc_id, strlen(text) AS n, hex(encode(text)) AS h FROM documents) SELECT doc_id, {sql} AS bytes FROM b")
    def _(spark, sf_dir):
        pack, planned = _built(spark, sf_dir)
        asked = planned.select(F.col("ord").alias("doc_id"), "ref", "size")
        return pack.resolve(asked, "ref", start=F.expr(start), length=F.expr(length)).select("doc_id", F.hex("payload").alias("bytes"))


_range("range_read_head", "0", "16", "substr(h, 1, 32)")
_range("range_read_tail", "greatest(size - 10, 0)", "100", "substr(h, 2 * greatest(n - 10, 0)::BIGINT + 1)")
_range("range_past_end", "size + 5", "8", "''")


@_query("range_column", "SELECT doc_id, substr(hex(encode(text)), 7, 10) AS bytes FROM documents")
def _(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.hex(payloads.range_of(F.col("text").cast("binary"), 3, 5)).alias("bytes"))


# ordered scans


@_query("iter_shuffled", f"{_fold(_DOC, MAX)} SELECT key, name AS shard, (row_number() OVER (PARTITION BY name ORDER BY rn) - 1)::BIGINT AS place, sha256(text) AS sha256 FROM p JOIN documents USING (doc_id)")
def _(spark, sf_dir):
    found = _built(spark, sf_dir)[0].scan(shuffle=True, seed=7)  # shards in any order, each one's members in their own
    first = F.min("position").over(Window.partitionBy("shard"))
    return found.select("key", "shard", (F.col("position") - first).alias("place"), F.sha2("payload", 256).alias("sha256"))


@_query("scan_until", f"{_fold(_DOC, MAX)}, c AS (SELECT *, sum(size) OVER (ORDER BY rn) - size AS before FROM p) SELECT (rn - 1)::BIGINT AS position, key, size FROM c WHERE before < 300000")
def _(spark, sf_dir):
    return _built(spark, sf_dir)[0].scan_until(300_000).select("position", "key", F.octet_length("payload").cast("long").alias("size"))


@_query("sql_functions", f"{_fold(_DOC, MAX)} SELECT doc_id, p.key, p.name AS shard, substr(hex(encode(text)), 5, 16) AS bytes FROM p JOIN documents USING (doc_id)")
def _(spark, sf_dir):
    from ..functions import sql

    pack, planned = _built(spark, sf_dir)
    sql.register_refs(spark)
    sql.register_reader(spark, pack.folder)
    planned.select(F.col("ord").alias("doc_id"), "ref").createOrReplaceTempView("packlake_refs")
    return spark.sql("SELECT doc_id, ref_key(ref) AS key, ref_shard(ref) AS shard, hex(x.payload) AS bytes FROM packlake_refs, LATERAL read_range(ref, 2, 8) AS x")


@_query("read_many_order", "SELECT doc_id * 2 + k AS n, sha256(text) AS sha256 FROM documents, (SELECT unnest([0, 1]) AS k)")
def _(spark, sf_dir):
    pack, planned = _built(spark, sf_dir)
    asked = planned.select((F.col("ord") * 2).alias("n"), F.col("ref").alias("item")).union(planned.select(F.col("ord") * 2 + 1, "key"))
    return pack.resolve(asked, "item").orderBy("n").select("n", F.sha2("payload", 256).alias("sha256"))


def _split(name: str, workers: int | None):
    w = workers or "(t.n + 5)"
    sql = f"""{_fold(_DOC, MAX)}, t AS (SELECT count(*) AS n FROM p), k AS (SELECT unnest(generate_series(0, {w} - 1)) AS w FROM t)
        SELECT k.w::BIGINT AS worker, key, (rn - 1)::BIGINT AS position FROM p, t, k WHERE rn - 1 >= k.w * t.n // {w} AND rn - 1 < (k.w + 1) * t.n // {w}"""

    @_query(name, sql)
    def _(spark, sf_dir):
        pack, _ = _built(spark, sf_dir)
        return pack.assignments(workers or pack.index().count() + 5).select("worker", "key", "position")


_split("iter_split_w3", 3)
_split("iter_split_w_gt_t", None)


@_query(
    "iter_split_scans",
    f"""{_fold(_DOC, MAX)}, t AS (SELECT count(*) AS n FROM p)
        SELECT k.w::BIGINT AS worker, key, (rn - 1)::BIGINT AS position FROM p, t, (SELECT unnest(generate_series(0, 6)) AS w) k
        WHERE rn - 1 >= k.w * t.n // 7 AND rn - 1 < (k.w + 1) * t.n // 7""",
)
def _(spark, sf_dir):
    pack, _ = _built(spark, sf_dir)
    parts = [pack.scan(worker=i, workers=7, payload=False).select(F.lit(i).cast("long").alias("worker"), "key", "position") for i in range(7)]
    return reduce(DataFrame.union, parts)


# integrity


@_query("verify_clean", "SELECT strlen(text) > -1 AND false AS problem, 0::BIGINT AS n FROM documents WHERE false")
def _(spark, sf_dir):
    problems, _ = integrity.verify(spark, _built(spark, sf_dir)[0].folder)
    return problems.groupBy(F.lit(True).alias("problem")).agg(F.count("*").alias("n"))


@_query("verify_totals", f"{_fold(_DOC, MAX)} SELECT count(*)::BIGINT AS blobs, sum(size)::BIGINT AS bytes, count(DISTINCT shard)::BIGINT AS shards FROM p")
def _(spark, sf_dir):
    return integrity.verify(spark, _built(spark, sf_dir)[0].folder)[1].select("blobs", F.col("bytes").cast("long"), "shards")


@_query("manifest_roundtrip", f"{_fold(_DOC, MAX)} SELECT DISTINCT name AS shard, true AS agrees FROM p")
def _(spark, sf_dir):
    folder = _built(spark, sf_dir)[0].folder
    integrity.write_manifest(spark, folder, force=True)
    now = integrity.digests(spark, folder)
    then = integrity.manifest(spark, folder).withColumnsRenamed({"sha256": "s", "bytes": "b"})
    return now.join(then, "shard").select("shard", ((F.col("sha256") == F.col("s")) & (F.col("bytes") == F.col("b"))).alias("agrees"))


@_query("verify_corrupt", "SELECT 'pack-0000.zip' AS shard, unnest(['CRC mismatch', 'does not match manifest']) AS kind")
def _(spark, sf_dir):
    folder = os.path.join(_workspace(spark), "copy")
    shutil.copytree(_built(spark, sf_dir)[0].folder, folder)
    integrity.write_manifest(spark, folder, force=True)
    with open(os.path.join(folder, "pack-0000.zip"), "r+b") as f:
        f.seek(60)
        byte = f.read(1)
        f.seek(60)
        f.write(bytes([byte[0] ^ 1]))
    return integrity.verify(spark, folder)[0].select("shard", "kind")


@_query("dup_keys", "SELECT 'k/' || doc_id % m AS key, count(*)::BIGINT AS n FROM documents, (SELECT max(doc_id) // 2 + 1 AS m FROM documents) GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf_dir):
    docs, folder = _docs(spark, sf_dir), os.path.join(_workspace(spark), "twice")
    half = docs.agg(F.max("ord")).first()[0] // 2 + 1  # two shards, each with its own keys, many of them in both
    again = docs.withColumn("key", F.concat(F.lit("k/"), (F.col("ord") % half).cast("string")))
    write_planned(again, [0, half], folder)
    return Pack(spark, folder).duplicate_keys()


# what payloads are, and moving columns


_HEADS = "['FFD8FF', '89504E470D0A1A0A', '474946383761', '474946383961', '424D', '664C6143', '4F676753', '1A45DFA3', '255044462D', '504B0304', '0000001866747970', '524946460000000057454250', '524946460000000057415645', '5249464600000000', '']"
_KINDS = "['JPEG', 'PNG', 'GIF', 'GIF', 'BMP', 'FLAC', 'Ogg', 'Matroska/WebM', 'PDF', 'ZIP', 'MP4/MOV', 'WebP', 'WAV', 'RIFF', 'unrecognized']"


@_query("sniff_kinds", f"SELECT doc_id, ({_KINDS})[doc_id % 15 + 1] AS kind FROM documents")
def _(spark, sf_dir):
    head = F.unhex(F.get(F.expr(_HEADS.replace("[", "array(").replace("]", ")")), (F.col("doc_id") % 15).cast("int")))
    blob = F.concat(head, F.unhex(F.lit("00")), F.col("text").cast("binary"))
    return _table(spark, sf_dir, "documents").select("doc_id", payloads.kind_of(blob).alias("kind"))


@_query(
    "measure_column",
    """WITH n AS (SELECT count(*) AS n, greatest(count(*) // 32, 1) AS step FROM documents),
    s AS (SELECT strlen(text) AS b FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), n WHERE i % step = 0 AND i < step * 32)
    SELECT any_value(n)::BIGINT AS rows, (sum(b) // count(*))::BIGINT AS mean_bytes, min(b)::BIGINT AS min_bytes, max(b)::BIGINT AS max_bytes,
           ['unrecognized'] AS kinds FROM s, n""",
)
def _(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("blob"))
    return measure.measure(docs, "blob", "doc_id")


_ROW = "o AS (SELECT row_number() OVER (ORDER BY doc_id, c) rn, * FROM (SELECT *, strlen(t) + 76 + 2 * strlen(key) AS m, r AS g FROM (SELECT doc_id, r, c, t, name || '/' || printf('%012d', r) || '.bin' AS key FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, text, source FROM documents), LATERAL (SELECT unnest([0, 1]) AS c, unnest(['body', 'origin']) AS name, unnest([CASE WHEN doc_id % 5 <> 0 THEN text END, source]) AS t)) WHERE t IS NOT NULL))"


@_query(
    "extract_binary_column",
    f"{_fold(_ROW, MAX)} SELECT d.doc_id, d.lang, a.ref AS body, b.ref AS origin FROM documents d LEFT JOIN p a ON a.doc_id = d.doc_id AND a.c = 0 LEFT JOIN p b ON b.doc_id = d.doc_id AND b.c = 1",
)
def _(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    body = F.when(F.col("doc_id") % 5 != 0, F.col("text").cast("binary"))
    table = docs.select("doc_id", body.alias("body"), F.col("source").cast("binary").alias("origin"), "lang")
    return convert.extract_columns(table, ["body", "origin"], "doc_id", os.path.join(_workspace(spark), "media"), ref_base="media", limits=Limits(MAX))


@_query("replace_struct_leaf", "SELECT doc_id, doc_id % 7 = 0 AS is_null, CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang, CASE WHEN doc_id % 7 <> 0 THEN 'x' || doc_id END AS ref FROM documents")
def _(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    media = F.when(F.col("doc_id") % 7 != 0, F.struct(F.col("text").cast("binary").alias("the.bytes"), "lang"))
    new = convert.replace_leaf(docs.select("doc_id", media.alias("media")), ["media", "the.bytes"], F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    return new.select("doc_id", F.col("media").isNull().alias("is_null"), F.col("media.lang").alias("lang"), F.col("media.`the.bytes`").alias("ref"))


_LEAF = "o AS (SELECT row_number() OVER (ORDER BY doc_id) rn, doc_id, printf('000000/0000/%012d', i // 128 * 128 + row_number() OVER (PARTITION BY i // 128 ORDER BY i) - 1) AS key, strlen(text) + 76 + 2 * 24 AS m, NULL AS g FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE doc_id % 7 > 1)"


@_query(
    "extract_struct_leaf",
    f"{_fold(_LEAF, MAX)} SELECT d.doc_id, d.doc_id % 7 = 0 AS is_null, CASE WHEN d.doc_id % 7 <> 0 THEN lang END AS lang, ref, CASE WHEN ref IS NOT NULL THEN sha256(text) END AS sha256 FROM documents d LEFT JOIN p USING (doc_id)",
)
def _(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    blob = F.when(F.col("doc_id") % 7 > 1, F.col("text").cast("binary"))
    media = F.when(F.col("doc_id") % 7 != 0, F.struct(blob.alias("bytes"), "lang"))
    work = _workspace(spark)
    docs.select("doc_id", media.alias("media")).repartition(1).sortWithinPartitions("doc_id").write.parquet(f"{work}/in")
    convert.convert_parquet(spark, f"{work}/in", f"{work}/out", fields=[["media", "bytes"]], limits=Limits(MAX))
    table = spark.read.parquet(f"{work}/out/tables").select("doc_id", F.col("media").isNull().alias("is_null"), "media.lang", F.col("media.bytes").alias("ref"))
    read = Pack(spark, f"{work}/out/media").resolve(table, "ref")
    return read.select("doc_id", "is_null", "lang", "ref", F.sha2("payload", 256).alias("sha256"))


def _tree(spark: SparkSession, sf_dir: str, tar: bool) -> str:
    """The pages as files in folders, or in two tar archives."""
    import io
    import tarfile

    root = os.path.join(_workspace(spark), "tree")
    os.makedirs(root)
    rows = _table(spark, sf_dir, "pages").orderBy("page_id").select("page_id", "html").toLocalIterator()
    tars = [tarfile.open(f"{root}/{n}.tar", "w") for n in "ab"] if tar else []
    for r in rows:
        data, name = r.html.encode(), f"g{r.page_id % 3}/{r.page_id:06d}.html"
        if tar:
            info = tarfile.TarInfo("./" + name)
            info.size = len(data)
            tars[r.page_id % 2].addfile(info, io.BytesIO(data))
        else:
            os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
            with open(f"{root}/{name}", "wb") as f:
                f.write(data)
    for t in tars:
        t.close()
    return root


_FILES = "SELECT printf('g%d/%06d.html', page_id % 3, page_id) AS key, sha256(html) AS sha256 FROM pages"


@_query("pack_files", _FILES)
def _(spark, sf_dir):
    out = os.path.join(_workspace(spark), "media")
    convert.pack_files(spark, _tree(spark, sf_dir, False), out, limits=Limits(MAX))
    return Pack(spark, out).blobs().select("key", F.sha2("payload", 256).alias("sha256"))


@_query("pack_tars", _FILES)
def _(spark, sf_dir):
    out = os.path.join(_workspace(spark), "media")
    convert.pack_tars(spark, _tree(spark, sf_dir, True), out, limits=Limits(MAX))
    return Pack(spark, out).blobs().select("key", F.sha2("payload", 256).alias("sha256"))


@_query("tar_index_read", _FILES)
def _(spark, sf_dir):
    register(spark)
    index = spark.read.format("tar_index").load(_tree(spark, sf_dir, True))
    return read_spans(index).select("key", F.sha2("payload", 256).alias("sha256"))


@_query("unpack_files", f"SELECT {_DOC_KEY} AS key, sha256(text) AS sha256 FROM documents")
def _(spark, sf_dir):
    out = os.path.join(_workspace(spark), "files")
    convert.unpack(_built(spark, sf_dir)[0], out)
    return _loose(spark, out)


def _loose(spark: SparkSession, folder: str) -> DataFrame:
    """What reading files one by one gives."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.substring_index("path", f"{os.path.basename(folder)}/", -1).alias("key"), F.sha2("content", 256).alias("sha256"))


@_query("loose_reads", _FILES)
def _(spark, sf_dir):
    return _loose(spark, _tree(spark, sf_dir, False))


_PROBES = "SELECT doc_id, sha256(text) AS sha256 FROM documents ORDER BY sha256(doc_id || ':7'), doc_id LIMIT 400"


def _probes(df: DataFrame) -> DataFrame:
    """400 seeded random places, the same for every way of reading them."""
    return df.orderBy(F.sha2(F.concat("doc_id", F.lit(":7")), 256), "doc_id").limit(400)


@_query("random_reads", _PROBES)
def _(spark, sf_dir):
    pack, planned = _built(spark, sf_dir)
    asked = _probes(planned.select(F.col("ord").alias("doc_id"), "ref"))
    return pack.resolve(asked, "ref").select("doc_id", F.sha2("payload", 256).alias("sha256"))


@_query("embedded_random_reads", _PROBES)
def _(spark, sf_dir):
    path = os.path.join(_workspace(spark), "embedded")
    _docs(spark, sf_dir).write.parquet(path)
    table = spark.read.parquet(path).withColumnRenamed("ord", "doc_id")
    return table.join(_probes(table.select("doc_id")), "doc_id", "left_semi").select("doc_id", F.sha2("payload", 256).alias("sha256"))


@_query("embedded_scan", f"SELECT {_DOC_KEY} AS key, sha256(text) AS sha256 FROM documents")
def _(spark, sf_dir):
    path = os.path.join(_workspace(spark), "embedded")
    _docs(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path).select("key", F.sha2("payload", 256).alias("sha256"))


@_query("stream_arrivals", f"{_fold(_DOC, MAX)} SELECT name AS shard, count(*)::BIGINT AS blobs FROM p GROUP BY name")
def _(spark, sf_dir):
    from ..streaming.arrivals import PackArrivals

    spark.dataSource.register(PackArrivals)
    work, name = _workspace(spark), f"arrivals_{os.urandom(4).hex()}"
    stream = spark.readStream.format("pack_arrivals").load(_built(spark, sf_dir)[0].folder)
    query = stream.writeStream.format("parquet").option("path", f"{work}/{name}").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{work}/{name}").groupBy("shard").agg(F.count("*").alias("blobs"))
