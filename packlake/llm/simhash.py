"""SimHash fingerprints and near duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. Its positions are dealt to the non-zero vectors of radius + 1 bits; for every such vector v
there is a mask that keeps the positions whose vector has an odd product with v. Up to `radius` vectors never span the
whole space, so for any set of that many positions some v is orthogonal to all of them: its mask drops just these
positions, and two fingerprints that differ there alone agree on what it keeps. With 2 ** (radius + 1) - 1 tables every
pair within the radius thus collides in one of them, for certain.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

BITS = 64
#: Fingerprints under one key that a task compares by itself; those of larger groups are linked through shared
#: neighbours instead (see `_link_wide`).
MOST_IN_TASK = 20_000
#: Up to so many fingerprints under one key are compared by shifting whole columns.
FEW = 3
PORTION = 4_000_000
#: Texts, about, in the sample that tells common shingles, and the most of these that are sent to all tasks.
SAMPLE, MOST_COMMON = 5_000, 100_000
#: Texts under one shingle that the others are compared with in the first round; in later ones each time 16 times more.
HUBS = 4
#: Bits of the filters by which tables of texts are thinned out before they are joined, at most.
FILTER_BITS = 1 << 25


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The kept positions of each table, as unsigned numbers."""
    last = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if (v & (i % last + 1)).bit_count() % 2) for v in range(1, last + 1)]


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def fingerprints(texts: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """SimHash of the word shingles of each text, repeats included."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    ends: list[int] = []
    owners: list[int] = []

    def flush() -> None:
        if owners:
            h = np.array(hashes, np.uint64)
            start = 0
            for i, end in zip(owners, ends, strict=True):
                out[i] = _majority(h[start:end])
                start = end
            hashes.clear(), ends.clear(), owners.clear()

    for i, text in enumerate(texts):
        words = text.lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
        if not words:
            continue
        if len(words) <= size:
            hashes.append(xxh64_intdigest(b" ".join(words), seed))
        else:
            joined = b" ".join(words)
            at = [0]
            for w in words:
                at.append(at[-1] + len(w) + 1)
            hashes += [xxh64_intdigest(joined[x : y - 1], seed) for x, y in zip(at, at[size:], strict=False)]
        ends.append(len(hashes))
        owners.append(i)
        if len(hashes) > 100_000:
            flush()
    flush()
    return out


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; a text of fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(words[i : i + size])) for i in range(len(words) - size + 1)), np.uint64, len(words) - size + 1))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(df: DataFrame, size: int = 4, seed: int = 42, text: str = "text", out: str = "simhash", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) with a long column `out`: the 64 bits of the whole text's fingerprint.

    A null or empty text, or one of white space alone, has fingerprint zero; a text of fewer words than `size` is one
    shingle. Repeated rows stay; an empty table gives an empty table; a column already named `out` is an error.
    """
    keep = df.columns if keep is None else keep
    if out.lower() in {c.lower() for c in keep}:
        raise ValueError(f"the table already has a column {out}")

    def make():
        def run(texts):
            got = [x or b"" for x in texts.to_pylist()]
            found = [fingerprints(part, size, seed) for part in common.portions(got, PORTION)]
            return [pa.array(np.concatenate(found).view(np.int64))]

        return run

    return common.map_arrow(df, [common.quoted(text).cast("string").cast("binary")], [(out, T.LongType())], make, keep)


def _middle(values: np.ndarray) -> int:
    """The place of the value that differs least from the majority of all, bit by bit."""
    return int(np.argmin(np.bitwise_count(values ^ np.uint64(_majority(values)))))


def link_run(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, middle) for every value tied by a chain of links to the middle one of its group; memory in proportion to
    the run. A dense group has the same middle in most tables, so most of its links are found again, not new ones."""
    members, firsts = [], []
    rest, tries = values, 16
    while len(rest) > 1:
        at, tries = (_middle(rest) if tries else 0), max(0, tries - 1)
        first, rest = rest[at], np.delete(rest, at)
        frontier = [first]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                members.append(found)
                firsts.append(np.full(len(found), first))
                frontier.extend(found)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(members), np.concatenate(firsts)) if members else (none, none)


def _link_sorted(radius: int, most: int):
    """For rows (key, value) sorted by both: links (a, b, false), and (value, key, true) for runs of over `most`."""

    def run(batches):
        held_key, held, wide = None, [], False  # the run that the last batch ended in

        def close():
            if not wide and len(held) and (n := sum(map(len, held))) > 1:
                values = np.unique(np.concatenate(held)) if n > 1 else held[0]
                yield from emit(*link_run(values, radius))

        def emit(a, b, is_wide=False):
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), is_wide))], names=["a", "b", "wide"]
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            key, value = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            first = 0
            if held_key is not None and key[0] == held_key:
                part = value[: ends[0]]
                if wide:
                    yield from emit(part, np.full(len(part), held_key), True)
                else:
                    held.append(part)
                first = 1
                if len(starts) > 1:
                    yield from close()
            elif held_key is not None:
                yield from close()
            inner = slice(first, len(starts) - 1)  # runs that lie wholly in this batch
            size = ends[inner] - starts[inner]
            few = np.zeros(len(key) + 1, np.int64)
            short = (size > 1) & (size <= FEW)
            few[starts[inner][short]] += 1
            few[ends[inner][short]] -= 1
            at = np.flatnonzero(np.cumsum(few)[:-1])
            k, v = key[at], value[at]
            for d in range(1, FEW):
                if len(k) <= d:
                    break
                near = np.flatnonzero((k[d:] == k[:-d]) & (np.bitwise_count(v[d:] ^ v[:-d]) <= radius))
                yield from emit(v[near + d], v[near])
            for s, e in zip(starts[inner][size > FEW], ends[inner][size > FEW], strict=True):
                if e - s > most:
                    yield from emit(value[s:e], key[s:e], True)
                else:
                    yield from emit(*link_run(np.unique(value[s:e]), radius))
            if len(starts) > first:
                held_key, held, wide = key[-1], [value[starts[-1] :]], False
            if not wide and sum(map(len, held)) > most:
                wide = True
                for part in held:
                    yield from emit(part, np.full(len(part), held_key), True)
                held = []
        if held_key is not None:
            yield from close()

    return run


def _star_sorted(batches):
    """For rows (key, value) sorted by both: each value but the first of its key, with that first one."""
    key, first = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, v = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
        where = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        head = np.where(where >= 0, v[np.maximum(where, 0)], first if first is not None else 0)
        key, first = k[-1], head[-1]
        other = v != head
        yield pa.RecordBatch.from_arrays([pa.array(v[other]), pa.array(head[other])], names=["a", "b"])


def _link_wide(values: DataFrame, radius: int) -> DataFrame:
    """Links of a large dense group without comparing pairs: two values are within the radius exactly if some word lies
    within half of it of both, so each value is put under all words that near, and those under one word form a star."""
    words = {0}
    for _ in range(radius // 2):
        words |= {w ^ (1 << i) for w in words for i in range(BITS)}
    ball = F.array(*[F.lit(_signed(w)) for w in sorted(words)])
    keyed = values.select(F.explode(F.transform(ball, lambda w: w.bitwiseXOR(F.col("v")))).alias("key"), "v")
    return keyed.repartition("key").sortWithinPartitions("key", "v").mapInArrow(_star_sorted, "a long, b long").distinct()


def links(values: DataFrame, radius: int = 4, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """Links (a, b) between distinct 64-bit values (column v): not all pairs within the radius, but enough of them, or
    of pairs tied by a chain of them, that the same values are connected. Nothing is left out, however many values share
    a key: a task compares up to `most_in_task` of them by itself, larger groups are linked through shared neighbours.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    keys = F.array(*[F.col("v").bitwiseAND(F.lit(_signed(m))) for m in masks(radius)])
    keyed = values.select(F.explode(keys).alias("key"), "v")
    found = keyed.repartition("key").sortWithinPartitions("key", "v").mapInArrow(common.frugal(_link_sorted(radius, most_in_task)), "a long, b long, wide boolean")
    found = common.checkpoint(found.distinct())
    near = found.where("not wide").select("a", "b")
    wide = found.where("wide").select(F.col("a").alias("v")).distinct()
    if wide.isEmpty():
        return near
    return near.union(_link_wide(wide, radius))


def near_duplicates(
    df: DataFrame, size: int = 4, radius: int = 4, seed: int = 42, id: str = "doc_id", text: str = "text", most_in_task: int = MOST_IN_TASK
) -> DataFrame:
    """(id, simhash, component) for every row: component is the smallest id reachable over links of fingerprints that
    differ in at most `radius` bits, the row's own id included.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with equal fingerprints are one node,
    so copies are never compared with one another. A null id keeps its row; it is smaller than none. Repeated rows give
    repeated rows; an empty table gives an empty table. Columns other than id and text are not read.
    """
    prints = common.checkpoint(fingerprint(df.select(common.quoted(id).alias("id"), common.quoted(text).alias("text")), size, seed, keep=["id"]))
    distinct = common.checkpoint(prints.groupBy(F.col("simhash").alias("v")).agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("v"), radius, most_in_task))
    known = distinct.join(roots, distinct.v == roots.node, "left").select("v", "least", F.coalesce("root", "v").alias("root"))
    groups = known.groupBy("root").agg(F.min("least").alias("component"))
    of_value = known.join(groups, "root").select("v", "component")
    return prints.join(of_value, prints.simhash == of_value.v).select(F.col("id").alias(id), "simhash", "component")


def keep_one(df: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df`, with all their columns, that stay when of each group of near duplicates one does: the one of
    the smallest id. Texts are near duplicates if the Jaccard likeness of their sets of `size`-word shingles is at least
    `similarity`; groups are what such pairs connect.

    Pairs come from two searches, and all are verified by their whole sets. Fingerprints that covering tables link within
    `radius` bits join what differs least, so that dense groups fall together early. Likeness alone decides about the
    rest: with shingles in any one order, two sets of that likeness share one among the first n - ceil(similarity * n) + 1
    of each, so no pair is left out. Shingles common in a sample come last in that order, so that few texts meet under
    one; the sample steers cost alone.

    Ids are whole numbers. Equal texts are one node from the start, however many; null and empty texts are equal texts.
    Of repeated rows one stays. Of rows without an id one stays for each text that no row with an id has, and they are
    compared for equal texts only. Very long texts are compared whole. An empty table gives an empty table; other
    columns, of whatever names, are kept as they are.
    """
    plain = F.coalesce(common.quoted(text).cast("string"), F.lit(""))
    number = common.quoted(id).cast("long")
    key = [F.xxhash64(plain).alias("k1"), F.xxhash64(plain, F.lit(1)).alias("k2")]
    mine = df.select(number.alias("id"), *key, plain.alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(_common_shingles(mine, size))

    def make():
        known, counts = shared.value

        def run(texts):
            n, prefix, parity, prints = [], [], [], []
            for t in texts.to_pylist():
                s = shingle_set(t, size)
                n.append(len(s))
                prefix.append(_prefix(s, similarity, known, counts).tobytes())
                parity.append(_parity(s).tobytes())
                prints.append(_majority(s))
            return [pa.array(n, pa.int32()), pa.array(prefix, pa.binary()), pa.array(parity, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64))]

        return run

    kinds = [("n", T.IntegerType()), ("prefix", T.BinaryType()), ("parity", T.BinaryType()), ("v", T.LongType())]
    prints = common.map_arrow(mine, [F.col("text").cast("binary")], kinds, make, ["id", "k1", "k2"])
    some = [F.first(c).alias(c) for c in ("n", "prefix", "parity", "v")]
    texts = common.checkpoint(prints.groupBy("k1", "k2").agg(F.min("id").alias("id"), *some).withColumn("node", F.col("k1")))
    common.release(df.sparkSession)
    posts, pairs, heads = _candidates(texts.where("id is not null"), similarity, radius)
    texts = common.checkpoint(texts.select("k1", "k2", "id", "node"))  # what the search needs of the rest is in heads
    common.release(df.sparkSession)
    roots = _grouped(mine, posts, pairs, heads, size, similarity)
    common.release(df.sparkSession)
    grouped = texts.where("id is not null").select("node", "id", "k1", "k2").join(roots, "node")
    best = grouped.groupBy("root").agg(F.min(F.struct("id", "k1", "k2")).alias("best")).select("best.*")
    alone = texts.join(roots, "node", "left_anti").select("id", "k1", "k2")
    # what goes, by id and text: of a group all but its first, of a text all but its smallest id
    k1, k2, k3 = (common.unique_name(df.columns, f"__k{i}") for i in (1, 2, 3))
    rows = mine.groupBy("id", "k1", "k2").agg(F.count("*").alias("times"))
    kept = alone.union(best).toDF("j", "j1", "j2")
    same = F.col("id").eqNullSafe(F.col("j")) & (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2"))
    rows = rows.join(kept, same, "left").select(F.col("id").alias(k3), F.col("k1").alias(k1), F.col("k2").alias(k2), "times", F.col("j1").isNotNull().alias("stays"))
    rows = common.checkpoint(rows.where("not stays or times > 1"))
    here = (key[0] == F.col(k1)) & (key[1] == F.col(k2)) & number.eqNullSafe(F.col(k3))
    columns = [common.quoted(c) for c in df.columns]
    mark = common.unique_name(df.columns, "__mark")
    marked = _marked(df, key[0], rows.select(k1), mark)
    named = marked.where(mark)  # only these rows are joined; the others stay
    once = marked.where(~F.col(mark)).select(*columns).union(named.join(rows.select(k1, k2, k3), here, "left_anti").select(*columns))
    repeated = rows.where("stays").select(k1, k2, k3)
    if repeated.isEmpty():
        return once
    return once.union(named.join(repeated, here).dropDuplicates([k1, k2, k3]).select(*columns))


def _marked(df: DataFrame, value, wanted: DataFrame, mark: str) -> DataFrame:
    """`df` with a column `mark`, false only for rows whose `value` is not in `wanted` (one column). Both are hashes.

    A filter of about 16 bits for each wanted value is broadcast, 64 bits a row. Beyond FILTER_BITS more rows are marked
    than needed, so a mark never stands for a join; it makes the join small.
    """
    taken = df.columns
    word, held = (common.unique_name(taken, f"__{c}") for c in ("word", "held"))
    hashes = wanted.toDF("h")
    bits = min(FILTER_BITS, 1 << max(10, (16 * hashes.count()).bit_length()))
    word_of = lambda h: F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6)
    bit_of = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    table = hashes.groupBy(word_of(F.col("h")).alias(word)).agg(F.bit_or(bit_of(F.col("h"))).alias(held))
    found = F.coalesce(F.col(held).bitwiseAND(bit_of(value)) != 0, F.lit(False))
    return df.join(F.broadcast(table), word_of(value) == F.col(word), "left").select(*[common.quoted(c) for c in taken], found.alias(mark))


def _common_shingles(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles found more than once in a sample of texts (columns k1, text)."""

    def run(batches):
        for batch in common.slices(batches):
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.encode(), size).view(np.int64))], names=["h"])

    step = max(1, texts.count() // SAMPLE)
    found = texts.where(F.pmod("k1", F.lit(step)) == 0).select("text").mapInArrow(common.frugal(run), "h long").groupBy("h").count()
    rows = found.where("count > 1").orderBy(F.desc("count"), "h").limit(MOST_COMMON).collect()
    h = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r[1] for r in rows], np.int64)[order]


def _least_common(n, m, similarity: float):
    """Shingles that sets of n and m must share to be alike, at least."""
    return np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)


def _prefix(shingles: np.ndarray, similarity: float, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a text's shingles, by their counts in the sample and then by hash."""
    n = len(shingles)
    most = min(n, n - math.ceil(similarity * n - 1e-9) + 1)
    if not len(known):
        return shingles[:most]
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    count = np.where(known[at] == shingles, counts[at], 0)
    return shingles[np.argsort(count, kind="stable")[:most]]


def _parity(shingles: np.ndarray) -> np.ndarray:
    """For each of about as many places as there are shingles, whether an odd number of them falls on it; in words of 64."""
    bits = max(64, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def _differ(p: np.ndarray, q: np.ndarray) -> int:
    """In how many shingles two sets differ at least, by their parities: each shingle of one alone turns one place."""
    while len(p) != len(q):  # half as many places: those as far apart fall together
        p, q = (x[: len(x) // 2] ^ x[len(x) // 2 :] if len(x) > len(y) else x for x, y in ((p, q), (q, p)))
    return int(np.bitwise_count(p ^ q).sum())


def _spread(similarity: float):
    """For rows (node, n, prefix): (key, place, node) for each shingle of the prefix. place: n and the number of shingles
    from this one on, after a bit that is set where too few are left for it to be the first that this text shares with
    one as long or longer."""

    def run(batches):
        for batch in common.slices(batches):
            sizes = np.array([len(x) // 8 for x in batch.column("prefix").to_pylist()], np.int64)
            keys = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.int64)
            own = np.repeat(np.arange(len(sizes)), sizes)
            n = batch.column("n").to_numpy().astype(np.int64)[own]
            left = n - (np.arange(len(keys)) - (np.cumsum(sizes) - sizes)[own])
            place = ((left < _least_common(n, n, similarity)).astype(np.int64) << 62) | (n << 31) | left
            node = batch.column("node").to_numpy()[own]
            for at in range(0, len(keys), 100_000):
                columns = [c[at : at + 100_000] for c in (keys, place, node)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "place", "node"])

    return run


def _in_company(batches):
    """For rows sorted by key and place: those of keys with several rows, the first of which is not late."""
    names = ["key", "place", "node"]
    held, held_first, early = None, True, False  # the last row so far; whether it is the first of its key; whether that one is early
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate([[h], c]) for h, c in zip(held, columns, strict=True)]
        key, late = columns[0], columns[1] >> 62 != 0
        again = key[1:] == key[:-1]
        new = np.concatenate([[held_first], ~again])
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        good = np.where(first >= 0, ~late[np.maximum(first, 0)], early)
        early, held_first, held = bool(good[-1]), bool(new[-1]), [c[-1] for c in columns]
        good &= ~new | np.append(again, False)
        good[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(c[good]) for c in columns], names=names)
    if held is not None and early and not held_first:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([x])) for x in held], names=names)


def _candidates(nodes: DataFrame, similarity: float, radius: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the search for groups starts from, of nodes (node, id, n, prefix, parity, v), distinct texts with v the
    fingerprint of the set: (key, node, n, left, late) of the shingles in prefixes that several texts share (see
    `_spread`); the pairs (a, b) that fingerprints link; (node, id, n, parity) of the nodes in any of these.
    """
    distinct = nodes.groupBy("v").agg(F.min("node").alias("least"))
    first, second = distinct.toDF("a", "x"), distinct.toDF("b", "y")
    near = links(distinct.select("v"), radius).join(first, "a").join(second, "b").select("x", "y")
    near = near.union(nodes.join(distinct, "v").where("node != least").select("least", "node"))
    pairs = common.checkpoint(near.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    common.release(nodes.sparkSession)
    spread = nodes.select("node", "n", "prefix").mapInArrow(common.frugal(_spread(similarity)), "key long, place long, node long")
    posts = common.checkpoint(spread.repartition("key").sortWithinPartitions("key", "place").mapInArrow(common.frugal(_in_company), spread.schema))
    bits = lambda c, at: F.shiftright(c, at).bitwiseAND(F.lit((1 << 31) - 1))
    posts = posts.select("key", "node", bits("place", 31).alias("n"), bits("place", 0).alias("left"), (F.col("place") >= 1 << 62).alias("late"))
    known = posts.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    common.release(nodes.sparkSession)
    heads = common.checkpoint(nodes.join(known, "node", "left_semi").select("node", "id", "n", "parity"))
    return posts, pairs, heads


def _grouped(texts: DataFrame, posts: DataFrame, pairs: DataFrame, heads: DataFrame, size: int, similarity: float) -> DataFrame:
    """(node, root) of the groups that pairs alike connect. posts, pairs, heads: see `_candidates`; texts: (k1, id, text) of
    all rows, heads having the smallest id and k1 of their texts.

    Under every shingle some texts, the hubs, are compared with all others; what is alike falls together, and shingles
    with texts of several groups go on with more hubs, until each has only one group or no text left that wasn't a hub.
    So no list of all pairs is made, dense groups cost a few comparisons a text, and no pair is left out.
    """
    roots, tested, hubs = components(pairs.limit(0)), pairs.limit(0), HUBS
    while True:
        if hubs == HUBS:  # each text is a group, and no shingle has one text alone
            now = posts.withColumn("root", F.col("node"))
        else:
            now = posts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            live = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("late").alias("late"))
            now = common.checkpoint(now.join(live.where("lo != hi and not late").select("key"), "key", "left_semi"))
            if now.isEmpty():
                return roots
        in_turn = Window.partitionBy("key").orderBy(F.xxhash64("node"), "node")
        chosen = now.where("not late").withColumn("turn", F.row_number().over(in_turn)).where(F.col("turn") <= hubs)
        chosen = chosen.select("key", F.col("node").alias("hub"), F.col("n").alias("m"), F.col("left").alias("rest"), F.col("root").alias("hub_root"))
        need = F.ceil((F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-9)
        fits = (F.col("root") != F.col("hub_root")) & (F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9) & (F.least("left", "rest") >= need)
        found = now.join(chosen, "key").where(fits).select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"))
        found = (pairs if hubs == HUBS else pairs.limit(0)).union(found).distinct().join(tested, ["a", "b"], "left_anti")
        found = common.checkpoint(found)
        common.release(texts.sparkSession)
        if not found.isEmpty():
            alike = _alike(texts, heads, found, size, similarity)
            roots = components(alike.union(roots.where("node != root")))
            tested = tested.union(found)
            common.release(texts.sparkSession)
        posts = now.drop("root").join(chosen.select("key", F.col("hub").alias("node")), ["key", "node"], "left_anti")
        hubs *= 16


def _alike(texts: DataFrame, heads: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles are alike; heads: (node, id, n, parity), texts: (k1, id, text).

    First by parities, which tell most pairs that are not alike. Whole sets are made for what is left, and of the texts
    only those move that these pairs may name.
    """
    first, second = (heads.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}")) for c in "ab")
    close = pairs.join(first, "a").join(second, "b").select("a", "b", "pa", "pb", "na", "nb")
    close = common.checkpoint(close.mapInArrow(common.frugal(_may_be_alike(similarity)), "a long, b long"))
    common.release(texts.sparkSession)
    named = close.select(F.col("a").alias("node")).union(close.select("b"))
    wanted = named.distinct().join(heads, "node").select(F.col("node").alias("k1"), "id")

    def sets(batches):
        for batch in common.slices(batches):
            found = [shingle_set((t or "").encode(), size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "set"])

    some = _marked(texts.select("k1", "id", "text"), F.col("k1"), named, "mark").where("mark")
    one = some.select("k1", "id", "text").join(wanted, ["k1", "id"], "left_semi").dropDuplicates(["k1", "id"])
    whole = common.checkpoint(one.select("k1", "text").mapInArrow(common.frugal(sets), "id long, set binary"))
    common.release(texts.sparkSession)
    # a fixed number of tasks: where sets are few, adaptive execution would give many pairs, each with two sets, to one
    n = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), close.count() // 1000)
    one_set = close.join(whole.toDF("a", "sa"), "a").repartition(n, "b")
    both = one_set.join(whole.toDF("b", "sb").repartition(n, "b"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(common.frugal(_compare(similarity)), "a long, b long")


def _may_be_alike(similarity: float):
    """For rows (a, b, pa, pb, na, nb): those (a, b) whose sets, of na and nb shingles, may be alike by their parities."""

    def run(batches):
        for batch in common.slices(batches):
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            most = n + m - 2 * _least_common(n, m, similarity)
            words = ([np.frombuffer(z.as_buffer(), np.uint64) for z in batch.column(c)] for c in ("pa", "pb"))
            good = [_differ(p, q) <= limit for p, q, limit in zip(*words, most.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _compare(similarity: float):
    """For rows (a, b, sa, sb): those (a, b) whose sets sa and sb are alike."""

    def run(batches):
        for batch in common.slices(batches):
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op4_simhash_near_dedup": op4_simhash_near_dedup}
