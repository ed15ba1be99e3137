"""Document fingerprints from closed syncmers.

The units are words (single characters in scripts without spaces). A run of K words is an anchor if, of the hashes of
the runs of S words inside it, the smallest is the first or the last one. Whether it is depends on these K words alone,
not on what stands around them, so a passage keeps its anchors wherever it is moved. The fingerprint holds all anchors,
each hash with its first place, and so grows with the text.

Fingerprints are compared by position: anchors that both have vote for an offset, the place in one minus the place in the
other, and those count whose offset another shares, as the anchors of a common passage do. The likeness is the share of
anchors that count, of those of both together.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words of an anchor, and of the runs compared inside it.
K, S = 8, 2
#: An anchor is a number: HASH bits of its hash, one bit to tell two texts apart, and PLACE bits of its place in words.
HASH, PLACE = 38, 24
#: Scripts written without spaces: each character is a unit.
SOLID = r"[฀-໿က-႟ក-៿⺀-꓏豈-﫿\x{20000}-\x{3FFFF}]"
#: Ranges of ids into which rows are dealt for finding neighbours; two for each shuffle partition, but no more.
MOST_RANGES = 50_000


def words(text: Column) -> Column:
    """The units of a text."""
    plain = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    mixed = F.regexp_extract_all(text, F.lit(SOLID + r"|(?:(?!" + SOLID + r")\S)+"), F.lit(0))
    return F.when(text.rlike(SOLID), mixed).otherwise(plain)


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with an array of (pos, hash), the anchors in text order; pos in units from 0.

    A text with units but without an anchor has one of them all, at 0; null and empty texts have none.
    """
    w, h = (common.unique_name([*df.columns, out], c) for c in ("__words", "__runs"))
    free = [common.quoted(c) for c in df.columns]
    found = df.select(*free, words(F.coalesce(common.quoted(text).cast("string"), F.lit(""))).alias(w))
    runs = F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(0), F.size(w) - S), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(S)])))
    found = found.select(*free, w, F.coalesce(runs, F.array().cast("array<bigint>")).alias(h))
    inner = [lambda i, j=j: F.get(h, i + j) for j in range(K - S + 1)]
    closed = lambda i: F.least(inner[0](i), inner[-1](i)) <= F.least(*[g(i) for g in inner[1:-1]])
    places = F.filter(F.sequence(F.lit(0), F.size(w) - K), closed)
    anchors = F.transform(places, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[g(i) for g in inner[::S]]).alias("hash")))
    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    whole = F.when(F.size(w) > 0, F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(w).alias("hash")))).otherwise(none)
    found = found.select(*free, w, F.when(F.size(w) >= K, anchors).otherwise(none).alias(out))
    return found.select(*free, F.when(F.size(common.quoted(out)) > 0, common.quoted(out)).otherwise(whole).alias(out))


def codes(anchors: Column) -> Column:
    """Anchors as sorted numbers, of equal hashes the first alone. Places beyond what PLACE bits hold begin anew."""
    code = lambda a: F.shiftleft(F.shiftrightunsigned(a["hash"], 64 - HASH), PLACE + 1) + a["pos"].bitwiseAND((1 << PLACE) - 1)
    every = F.sort_array(F.transform(anchors, code))
    new = lambda x, before: F.when(before.isNull() | (F.shiftright(x, PLACE + 1) != F.shiftright(before, PLACE + 1)), x)
    before = F.concat(F.array(F.lit(None).cast("bigint")), every)
    return F.filter(F.zip_with(every, F.slice(before, 1, F.size(every)), new), lambda x: x.isNotNull())


def offsets(a: Column, b: Column) -> Column:
    """Of every hash that two fingerprints share: its place in b minus its place in a, sorted."""
    both = F.sort_array(F.concat(a, F.transform(b, lambda x: x + (1 << PLACE))))
    same = lambda x, y: F.when(F.shiftright(x, PLACE + 1) == F.shiftright(y, PLACE + 1), y - x - (1 << PLACE))
    found = F.zip_with(both, F.slice(both, 2, F.greatest(F.size(both), F.lit(1))), same)
    return F.sort_array(F.filter(found, lambda x: x.isNotNull()))


def in_company(sorted_offsets: Column) -> Column:
    """How many of the offsets occur more than once."""

    def step(seen, x):
        times = F.when(x == seen["last"], seen["times"] + 1).otherwise(F.lit(1))
        more = F.when(times == 2, 2).when(times > 2, 1).otherwise(0)
        return F.struct(x.alias("last"), times.alias("times"), (seen["n"] + more).alias("n"))

    start = F.struct(F.lit(1 << 62).cast("bigint").alias("last"), F.lit(0).alias("times"), F.lit(0).alias("n"))
    return F.aggregate(sorted_offsets, start, step)["n"]


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, of two fingerprints; 1 for two empty ones. One anchor alone needs no company where it is all of a
    fingerprint."""
    size = F.size(a) + F.size(b)
    shared = offsets(a, b)
    counted = F.when((F.size(a) == 1) | (F.size(b) == 1), F.size(shared)).otherwise(in_company(shared))
    return F.when(size == 0, 1.0).when(a == b, 1.0).otherwise(2 * counted / size)


def as_text(codes: Column) -> Column:
    """A fingerprint as hexadecimal digits, sixteen for each anchor."""
    return F.lower(F.array_join(F.transform(codes, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """`df` with an array column `out` of numbers: the fingerprint of the whole text.

    Equal texts have equal fingerprints; those of null, empty and white-space texts are empty. A text too short for an
    anchor is one by itself. Repeated rows stay; an empty table gives an empty table; a column already named `out` is an
    error. Very long texts are read whole. Nothing is shuffled.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table already has a column {out}")
    keep = [common.quoted(c) for c in df.columns]
    found = common.unique_name([*df.columns, out], "__anchors")
    return with_anchors(df, text, found).select(*keep, codes(F.col(found)).alias(out))


def with_next(df: DataFrame, columns: list[str], id: str, tie: Column, make=lambda x: x) -> DataFrame:
    """make(df) with the columns next_* of the next row by descending id, of the first row after the last one.

    make() may add columns (`columns` may name them), but keeps rows and ids. Rows of equal ids follow each other by the
    number `tie`, nulls come last. Rows are dealt by ranges of ids, about equally filled, and sorted within each; the
    first row of every range also goes to the range before it. So whole rows are shuffled once, whatever their number.
    Only the limits of the ranges, as many as the shuffle has partitions, come to the driver.
    """
    spark = df.sparkSession
    _place, _tie, _to, _late = (common.unique_name([*df.columns, *columns], f"__{c}") for c in ("place", "tie", "to", "late"))
    n = min(MOST_RANGES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = common.quoted(id)
    asked = [i / n for i in range(1, n)]
    limits = df.agg(F.percentile_approx(key, asked, 20 * n)).first()[0] or []
    limits = sorted(set(limits))
    step = max(1, int(len(limits) ** 0.5))
    groups = [limits[i : i + step] for i in range(0, len(limits), step)]
    if limits:  # two steps: the group of limits, then the place in it
        reached = lambda x: key >= x
        firsts = F.array(*[F.lit(g[0]) for g in groups])
        table = F.array(*[F.array(*map(F.lit, g)) for g in groups])
        group = F.size(F.filter(firsts, reached)) - 1
        place = group * step + F.size(F.filter(F.get(table, group), reached))
        place = F.when(key.isNull(), -1).when(group < 0, 0).otherwise(place)
    else:
        place = F.when(key.isNull(), -1).otherwise(0)
    head = {r[0]: r[1] for r in df.groupBy(place.alias("place")).agg(F.max(key)).collect()}  # at most n + 1 rows
    order = sorted(head, reverse=True)
    if not order:
        order, head = [0], {0: None}
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True))
    lowest, highest = min(order), max(order)
    every = range(lowest, highest + 1)
    at = F.col(_place) - lowest
    first = key.eqNullSafe(F.get(F.array(*[F.lit(head.get(p)) for p in every]), at))
    back = F.get(F.array(*[F.lit(before.get(p)) for p in every]), at)
    wrapped = F.when(F.col(_place) == highest, 2).otherwise(1)
    targets = F.when(first, F.array(_target(F.col(_place), F.lit(0)), _target(back, wrapped))).otherwise(F.array(_target(F.col(_place), F.lit(0))))
    dealt = df.withColumn(_place, place).withColumn(_tie, tie).withColumn(_to, F.explode(targets))
    dealt = dealt.select(*map(common.quoted, df.columns), _tie, F.col(f"{_to}.place").alias(_place), F.col(f"{_to}.late").alias(_late))
    dealt = make(dealt.repartition(_place))
    along = Window.partitionBy(_place).orderBy(_late, key.desc_nulls_last(), F.desc(_tie))
    following = [F.lead(common.quoted(c)).over(along).alias(f"next_{c}") for c in columns]
    keep = [common.quoted(c) for c in dealt.columns if c not in (_place, _tie, _late)]
    return dealt.select(*keep, _late, *following).where(f"{_late} = 0").drop(_late)


def _target(place: Column, late: Column) -> Column:
    return F.struct(place.alias("place"), late.alias("late"))


def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike it is to that and to the next document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(docs, ["text", "own"], "doc_id", F.xxhash64("text"), lambda d: fingerprint(d, out="own"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    both = fingerprint(both, "edited", "changed")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


QUERIES = {"op7_syncmer_fingerprints": op7_syncmer_fingerprints}
