"""Benchmark decontamination by template canonicalisation.

Texts become sequences of words in which numbers, units and capitalised words (names, and whatever begins a sentence)
are replaced by placeholders of their kind; a second form keeps words in lower case and replaces numbers and units only.
Windows of WINDOW such words are hashed, those of the benchmark are joined by hash to those of the documents, and hits
are gathered by document, item and offset. On each offset the placeholders' values must agree: one value of the item
stands for one value of the document throughout, and the other way round. Offsets near each other are taken together, so
that a word more or less doesn't part an item; hits strewn over a long text are not. So a question counts as found when
its words, or its words but for consistently other names and numbers, stand together in the text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import MARKS, SOLID

WINDOW = 6
#: Words below which an item can't be told from chance inside a text and is looked for as a whole line or sentence; items shorter than
#: WINDOW use all their words.
LEAST_WORDS = 5
#: Words of a window that must not be placeholders.
LITERALS = 3
#: An item is in a document if this share of its windows is, and more words than chance gives unless all of it is; or so
#: many of its words in a row.
SHARE, LEAST_FOUND, RUN = 0.4, 9, 13
#: Share of the placeholder values on an offset that must agree.
AGREE = 0.8
#: Offsets this near to each other are taken together.
REACH = 12
#: Bits of a window's hash by which tasks tell what may be in the benchmark before the join, and of a first, small table.
#: The tables have this size whatever the benchmark's.
BITS, FIRST_BITS = 27, 22
CACHE = 400_000
PORTION = 1_000_000

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,:/]\d+)*")
#: Of texts in scripts without spaces each character of these is a word.
UNSPACED = re.compile(f"[{SOLID}]")
MIXED = re.compile(rf"(?=[{SOLID}])[^\W\d_][{MARKS}]*|(?:(?![{SOLID}])[^\W\d_])+(?:['’](?:(?![{SOLID}])[^\W\d_])+)*|\d+(?:[.,:/]\d+)*")
#: What stands between lines or sentences.
SENTENCES = re.compile(r"(?<=[.?!;:])\s+|[\r\n]+|(?<=[。？！；])")
#: Forms of windows beside those with placeholders: words and numbers as they are; a whole line of few words.
LITERAL, LINE = 2, 3
#: Words that stand for numbers and units of measure.
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "mm cm m km metre metres meter meters kilometre kilometres kilometer kilometers inch inches foot feet yard yards mile miles "
    "mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l litre litres liter liters second seconds "
    "minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent "
    "degree degrees kmh mph".split()
)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str) -> list[str]:
    return (TOKEN if text.isascii() or not UNSPACED.search(text) else MIXED).findall(text)


def kind(token: str) -> str:
    """n: a number, u: a unit, c: a capitalised word, else empty."""
    low = token.lower()
    if token[0].isdigit() or low in NUMBERS:
        return "n"
    if low in UNITS:
        return "u"
    return "c" if token[0] != token[0].lower() else ""


class _Words(dict):
    """Number of each token; makes rows of hashes for the two forms of texts when a token is first met (forms: the new ones)."""

    def __init__(self):
        self.forms: list[tuple[int, int, int, int, int]] = []

    def __missing__(self, token: str) -> int:
        from xxhash import xxh64_intdigest

        k = kind(token)
        low = token.lower()
        plain = xxh64_intdigest(low, 1)
        slot = xxh64_intdigest(k, 2)
        self.forms.append((slot if k else plain, slot if k in ("n", "u") and k else plain, plain, bool(k), k in ("n", "u") and bool(k)))
        self[token] = len(self)
        return len(self) - 1


class Windows:
    """Hashes of the windows of texts: of `sizes` in both forms, of `literal` sizes with all values."""

    def __init__(self, sizes: list[int], literal: list[int]):
        self.sizes, self.literal = sizes, literal
        self._reset()

    def _reset(self) -> None:
        self._words = _Words()
        self._table = np.zeros((0, 3), np.uint64)
        self._slots = np.zeros((0, 2), np.int64)

    def of(self, texts: list[str]):
        """(form, size, starts, hashes, tokens, owner of each token, first token of each text) for all windows."""
        if len(self._words) > CACHE:
            self._reset()
        tokens: list[str] = []
        ends = []
        for t in texts:
            tokens += tokens_of(t)
            ends.append(len(tokens))
        number = np.fromiter(map(self._words.__getitem__, tokens), np.int64, len(tokens))
        if self._words.forms:
            new, self._words.forms = self._words.forms, []
            self._table = np.concatenate([self._table, np.array([f[:3] for f in new], np.uint64).reshape(-1, 3)])
            self._slots = np.concatenate([self._slots, np.array([f[3:] for f in new], np.int64).reshape(-1, 2)])
        ends = np.array(ends, np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        left = ends[owner] - np.arange(len(tokens)) if len(tokens) else np.zeros(0, np.int64)
        first = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        for form in (0, 1, LITERAL):
            h = self._table[number, form]
            slots = np.concatenate([[0], np.cumsum(self._slots[number, form])]) if form != LITERAL else np.zeros(len(tokens) + 1, np.int64)
            for size in self.sizes if form != LITERAL else self.literal:
                n = len(tokens) - size + 1
                if n <= 0:
                    continue
                rolled = np.full(n, size * 2 + form, np.uint64)
                for j in range(size):
                    rolled = rolled * FACTOR + h[j : j + n]
                rolled ^= rolled >> np.uint64(29)
                rolled *= FACTOR
                rolled ^= rolled >> np.uint64(32)
                good = (left[:n] >= size) & (size - (slots[size : size + n] - slots[:n]) >= min(LITERALS, size - 1))
                starts = np.flatnonzero(good)
                yield form, size, starts, rolled[starts], tokens, owner, first

    def values(self, tokens: list[str], form: int) -> list[str]:
        """Kind and value of each placeholder of a window, in order."""
        at = self._slots
        return [] if form == LITERAL else [f"{kind(t)}:{t.lower()}" for t in tokens if at[self._words[t], form]]


def _lines(texts: list[str]):
    """(LINE, size, starts, hashes, owner) of the lines and sentences of fewer than LEAST_WORDS words; every start is 0."""
    from xxhash import xxh64_intdigest

    found: dict[int, list[tuple[int, int]]] = {}
    for i, text in enumerate(texts):
        for line in SENTENCES.split(text):
            tokens = tokens_of(line)
            if 0 < len(tokens) < LEAST_WORDS:
                found.setdefault(len(tokens), []).append((i, xxh64_intdigest("\0".join(tokens).lower(), 3)))
    for size, rows in found.items():
        yield LINE, size, np.zeros(len(rows), np.int64), np.array([h for _, h in rows], np.uint64), np.array([i for i, _ in rows], np.int64)


def _packed_bits(batches):
    """For rows (hash): the bits of BITS that they set, compressed, in one row for each partition."""
    bits = np.zeros(1 << BITS - 3, np.uint8)
    for batch in batches:
        at = batch.column("hash").to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])


def _filter_of(hashes: DataFrame) -> bytes:
    """The bits that the hashes (column hash) set, compressed. They come to the driver one partition at a time."""
    bits = np.zeros(1 << BITS - 3, np.uint8)
    for row in hashes.coalesce(16).mapInArrow(_packed_bits, "bits binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return zlib.compress(bits.tobytes(), 1)


def _hits(sizes: list[int], wanted=None, literal: list[int] = [], lines: bool = False):  # noqa: B006
    """For rows (id, unit, text): (id, unit, form, size, pos, hash, slots) of the windows whose hash may be wanted (by a
    broadcast filter), or of all."""

    def run(batches):
        windows = Windows(sizes, literal)
        table = bits = None
        if wanted is not None:
            bits = np.frombuffer(zlib.decompress(wanted.value), np.uint8)
            table = np.bitwise_or.reduce(bits.reshape(1 << FIRST_BITS, -1), axis=1) != 0
        for part in common.slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            at = 0
            for portion in common.portions(texts, PORTION):
                yield from found(part.slice(at, len(portion)), portion, windows, table, bits)
                at += len(portion)

    def found(part, texts, windows, table, bits):
        for form, size, starts, hashes, *rest in (*windows.of(texts), *(_lines(texts) if lines else ())):
            if table is not None:
                near = np.flatnonzero(table[(hashes >> np.uint64(64 - FIRST_BITS)).astype(np.int64)])
                if len(near):
                    place = hashes[near] >> np.uint64(64 - BITS)
                    near = near[(bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            else:
                near = np.arange(len(starts))
            starts, hashes = starts[near], hashes[near]
            if not len(starts):
                continue
            if form == LINE:
                own, slots = rest[0][near], [[]] * len(starts)
            else:
                tokens, owner, first = rest
                own = owner[starts]
                slots = [windows.values(tokens[s : s + size], form) for s in starts.tolist()]
                starts = starts - first[own]
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(take),
                    part.column("unit").take(take),
                    pa.array(np.full(len(own), form, np.int32)),
                    pa.array(np.full(len(own), size, np.int32)),
                    pa.array(starts),
                    pa.array(hashes.view(np.int64)),
                    pa.array(slots, pa.list_(pa.string())),
                ],
                names=["id", "unit", "form", "size", "pos", "hash", "slots"],
            )

    return common.frugal(run)


SCHEMA = "id long, unit long, form int, size int, pos long, hash long, slots array<string>"


def _prepared(df: DataFrame, id: str, text: str) -> DataFrame:
    plain = F.coalesce(common.quoted(text).cast("string"), F.lit(""))
    return df.select(common.quoted(id).cast("long").alias("id"), F.xxhash64(plain).alias("unit"), plain.alias("text"))


def matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, unit, item, coverage, run, agreement, verbatim) for every document and item found in it.

    Ids are whole numbers. unit is a hash of the text, so that rows of equal ids and different texts stay apart; rows of
    equal id and text are one. Items of equal texts are looked for once, under the smallest id. coverage is the share of
    the item's windows found near one place of the text on offsets whose placeholders agree, run the most words of the
    item that stand there in a row, agreement the least agreement of placeholder values there, verbatim whether all values
    are the same; of equally good places the one that agrees best counts. Very long texts are read whole, in portions. Items whose windows are nearly all placeholders
    match with all their words and values in a row only, items of fewer than LEAST_WORDS words as a whole line or
    sentence only. Null
    and empty texts match nothing; null ids of items are left out, null ids of documents stay.
    """
    spark = docs.sparkSession
    items = _prepared(benchmark.where(common.quoted(item).isNotNull()), item, item_text)
    items = items.groupBy("text").agg(F.min("id").alias("id"), F.min("unit").alias("unit"))

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([min(WINDOW, len(tokens_of(t))) for t in batch.column("text").to_pylist()], pa.int32())], names=["n"])

    lengths = [r[0] for r in items.select("text").mapInArrow(count, "n int").distinct().collect()]  # at most WINDOW + 1
    sizes = sorted({WINDOW, *(n for n in lengths if LEAST_WORDS <= n < WINDOW)})
    columns = ["id", "unit", "text"]
    theirs = common.checkpoint(items.select(*columns).mapInArrow(_hits(sizes, None), SCHEMA))
    # items without a window that has words enough: as they are, whole
    bare = items.join(theirs.select("id").distinct(), "id", "left_anti").withColumn("text", F.regexp_replace("text", r"\s+", " "))
    bare = common.checkpoint(bare.select(*columns).mapInArrow(_hits([], None, [LEAST_WORDS, WINDOW], True), SCHEMA))
    kinds = [tuple(r) for r in bare.select("form", "size").distinct().collect()]
    theirs = theirs.union(bare)
    # an item is looked for by its windows of the usual size; by the largest shorter one where it has none
    longest = theirs.groupBy(F.col("id").alias("item")).agg(F.max("size").alias("size"))
    theirs = theirs.withColumnsRenamed({"id": "item", "pos": "item_pos", "slots": "item_slots"}).drop("unit").join(longest, ["item", "size"])
    total = theirs.groupBy("item").agg(F.countDistinct("item_pos").alias("windows"))
    wanted = spark.sparkContext.broadcast(_filter_of(theirs.select("hash")))
    ours = _prepared(docs, id, text).mapInArrow(_hits(sizes, wanted, sorted({n for f, n in kinds if f == LITERAL}), any(f == LINE for f, _ in kinds)), SCHEMA)
    both = ours.join(theirs, ["hash", "form", "size"])
    pairs = F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("own"))
    by = ["id", "unit", "item", "form", "size", (F.col("pos") - F.col("item_pos")).alias("offset")]
    offsets = both.groupBy(*by).agg(
        F.collect_set("item_pos").alias("places"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    values = F.least(F.size(F.array_distinct("pairs.item")), F.size(F.array_distinct("pairs.own")))
    offsets = offsets.withColumn("agreement", F.when(F.size("pairs") == 0, 1.0).otherwise(values / F.size("pairs"))).where(F.col("agreement") >= AGREE)
    offsets = offsets.withColumn("verbatim", F.forall("pairs", lambda p: p["item"] == p["own"])).withColumn("run", longest_run(F.col("places")) + F.col("size") - 1)
    near = Window.partitionBy("id", "unit", "item").orderBy("offset").rangeBetween(-REACH, REACH)
    offsets = offsets.join(total, "item").select(
        "id", "unit", "item", "windows", "run",
        F.size(F.array_distinct(F.flatten(F.collect_list("places").over(near)))).alias("found"),
        F.min("agreement").over(near).alias("agreement"),
        F.min("verbatim").over(near).alias("verbatim"),
        (F.col("form") < LITERAL).alias("usual"),
    ).where("usual or found = windows")
    best = F.max(F.struct("found", "agreement", "verbatim")).alias("best")
    found = offsets.groupBy("id", "unit", "item").agg(F.max("windows").alias("windows"), F.max("run").alias("run"), best)
    found = found.select("id", "unit", "item", "windows", "run", "best.*").withColumn("coverage", F.col("found") / F.col("windows"))
    enough = (F.col("coverage") >= SHARE) & ((F.col("found") + WINDOW - 1 >= LEAST_FOUND) | (F.col("coverage") == 1))
    return found.where(enough | (F.col("run") >= RUN)).select("id", "unit", "item", "coverage", "run", "agreement", "verbatim")


def longest_run(places: Column) -> Column:
    """The most numbers of an array of distinct ones that follow each other without a gap."""

    def step(seen, x):
        now = F.when(x == seen["last"] + 1, seen["now"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("last"), now.alias("now"), F.greatest(seen["most"], now).alias("most"))

    zero = F.lit(0).cast("long")
    return F.aggregate(F.array_sort(places), F.struct(F.lit(-9).cast("long").alias("last"), zero.alias("now"), zero.alias("most")), step)["most"]


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, in which no item was found. Repeated rows all stay or all go, so do rows
    without an id by their texts; null and empty texts stay; an empty table, or an empty benchmark, changes nothing."""
    own, of = common.unique_name(docs.columns, "__id"), common.unique_name(docs.columns, "__unit")
    hit = matches(docs, benchmark, id, text).select(F.col("id").alias(own), F.col("unit").alias(of)).distinct()
    unit = F.xxhash64(F.coalesce(common.quoted(text).cast("string"), F.lit("")))
    same = common.quoted(id).cast("long").eqNullSafe(F.col(own)) & (unit == F.col(of))
    return docs.join(hit, same, "left_anti")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    found = matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "coverage", "run", "agreement", "verbatim")


QUERIES = {"op6_benchmark_decontamination": op6_benchmark_decontamination}
