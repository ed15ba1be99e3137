"""Language-model scores by stupid backoff, computed from the corpus itself.

Texts are sequences of words. S(w | c) is count(c w) / count(c) if c w was seen, else BACKOFF times S(w | c without its
first word), down to count(w) / N; a word never seen counts as half of one. A text's score is the sum of ln S over its
words. Counts leave the text's own out: every text is scored by a model of all other rows. No count is dropped.

The tables are as large as the corpus, so they are never broadcast. They are made and used in two shuffles:

1. Texts are dealt to blocks. Each block counts its distinct n-grams (64-bit hashes) and sends them, packed and sorted,
   to the partition that their hash gives; there the blocks' counts are added up. A very frequent n-gram arrives once
   from each block, not once from each place.
2. Each partition joins its table with the n-grams that each block asked about, and answers the block with those that
   others have too: an n-gram that only one text of the corpus holds has no count for anyone and need not be sent.
   Blocks join the answers with their exploded n-grams and sum by text.

A block holds about BLOCK_BYTES of text, or a single longer text; an n-gram table's partition holds what its share of
the hashes gives. Both grow in number with the input, not in size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 2
BACKOFF = 0.4
#: About so many bytes of text make a block, and about as many a partition of the tables.
BLOCK_BYTES = 12_000_000
#: ASCII characters that are no words; all others, in lower case, are.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
SPACED = bytes(0x20 if b in SEPARATORS else b for b in range(256))
CACHE = 300_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(SPACED).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= CACHE:
            self.clear()
        got = self[word] = xxh64_intdigest(word)
        return got


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * FACTOR
    return h ^ (h >> np.uint64(29))


class Grams:
    """Hashes of the n-grams of texts, for n from 1 to the order."""

    def __init__(self, order: int):
        self.order = order
        self._of = _Hashes()

    def of(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each n the hashes of the n-grams that end at each word, zero where the text is too short; and for each
        text's words its number."""
        parts, sizes = [], []
        for t in texts:
            words = words_of(t)
            parts.append(np.fromiter(map(self._of.__getitem__, words), np.uint64, len(words)))
            sizes.append(len(words))
        one = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        starts = np.cumsum(sizes) - sizes if sizes else np.zeros(0, np.int64)
        place = np.arange(len(one)) - starts[owner] if len(one) else np.zeros(0, np.int64)
        out = [_mix(one)]
        rolled = one
        for n in range(2, self.order + 1):
            longer = np.zeros(len(one), np.uint64)
            longer[1:] = rolled[:-1] * np.uint64(31 + n) + one[1:] * FACTOR
            rolled = longer
            out.append(np.where(place >= n - 1, np.maximum(_mix(longer), np.uint64(1)), np.uint64(0)))
        return out, owner


def _pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte planes apart so that they compress, then counts."""
    import zstandard

    gaps = np.diff(hashes, prepend=np.uint64(0))
    planes = gaps.view(np.uint8).reshape(-1, 8).T.copy()
    return len(hashes).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes() + counts.astype(np.uint32).tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n = int.from_bytes(data[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(data[8:])
    gaps = np.frombuffer(raw[: 8 * n], np.uint8).reshape(8, n).T.copy().view(np.uint64).ravel()
    return np.cumsum(gaps, dtype=np.uint64), np.frombuffer(raw[8 * n :], np.uint32).astype(np.int64)


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(grams)
    return np.unique(every[every != 0], return_counts=True)


def _sizes(batches):
    """Bytes and words of the texts of each batch. Lower case changes neither separators nor the number of words."""
    for batch in common.slices(batches):
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
        words = sum(len(t.translate(SPACED).split()) for t in texts)
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, texts))]), pa.array([words], pa.int64())], names=["size", "words"])


def _limits(n: int) -> np.ndarray:
    return (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64)


def _asked(order: int, partitions: int):
    """For a partition of rows (block, ..., text), sorted by block: one row (part, block, data) for each block and part."""
    limits = _limits(partitions)

    def run(batches):
        grams = Grams(order)
        block, held, counts = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def add(g):
            nonlocal held, counts
            h, n = _distinct(g)
            held, inverse = np.unique(np.concatenate([held, h]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, n]), len(held)).astype(np.int64)

        def close():
            cuts = [0, *np.searchsorted(held, limits).tolist(), len(held)]
            full = [p for p in range(partitions) if cuts[p + 1] > cuts[p]]
            data = [_pack(held[cuts[p] : cuts[p + 1]], counts[cuts[p] : cuts[p + 1]]) for p in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int32()), pa.array(data, pa.binary())], names=["part", "block", "data"]
            )

        for number, texts in _blocks(batches):
            if number != block and block is not None:
                yield from close()
                held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            block = number
            add(grams.of(texts)[0])
        if block is not None:
            yield from close()

    return run


def _blocks(batches):
    """(block, texts) in order; texts of one block may come in several turns of bounded size."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                texts = [t or "" for t in batch.column("text").slice(lo, hi - lo).to_pylist()]
                for part in common.portions(texts, 4 * common.SLICE):
                    yield int(blocks[lo]), part


def _answers(key, table):
    """All that was asked of one part of the tables, by block: n-grams that occur more often than in the block, or in
    several texts, with their totals."""
    blocks = table.column("block").to_pylist()
    got = [_unpack(d) for d in table.column("data").to_pylist()]
    hashes = np.concatenate([h for h, _ in got])
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
    group = np.cumsum(new) - 1
    total = np.bincount(group, np.concatenate([n for _, n in got])[order]).astype(np.int64)
    of = np.empty(len(hashes), np.int64)
    of[order] = total[group]
    rows, at = [], 0
    for block, (h, _) in zip(blocks, got, strict=True):
        own = of[at : at + len(h)]
        keep = own > 1
        at += len(h)
        if keep.any():
            rows.append({"block": block, "data": _pack(h[keep], own[keep])})
    return pa.Table.from_pylist(rows, schema=pa.schema([("block", pa.int32()), ("data", pa.binary())]))


def _scored(order: int, backoff: float, total_words: int):
    """For the rows (block, id, text) of a block and what it was answered (block, data): (id, n_words, score, n_backoff)."""

    def run(key, rows, answers):
        grams = Grams(order)
        got = [_unpack(d) for d in answers.column("data").to_pylist()]
        hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in got)])
        totals = np.concatenate([np.zeros(0, np.int64), *(n for _, n in got)])
        by = np.argsort(hashes, kind="stable")
        hashes, totals = hashes[by], totals[by]
        found = [score_texts(grams, part, hashes, totals, total_words, backoff) for part in common.portions(rows.column("text").to_pylist(), common.SLICE)]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        return pa.table([rows.column("id"), *map(pa.array, columns)], names=["id", "n_words", "score", "n_backoff"])

    return run


def score_texts(grams: Grams, texts: list[str], hashes: np.ndarray, totals: np.ndarray, total_words: int, backoff: float):
    """Words, score and words scored by a shorter context, of each text. hashes, totals: n-grams in several texts."""
    every, owner = grams.of(texts)
    n_texts = len(texts)
    words = np.bincount(owner, minlength=n_texts).astype(np.int64)
    rest = np.maximum(total_words - words, 1)[owner].astype(np.float64)
    others = []
    for g in every:  # occurrences in all other texts, for each place
        if not len(hashes) or not len(g):
            others.append(np.zeros(len(g)))
            continue
        at = np.minimum(np.searchsorted(hashes, g), len(hashes) - 1)
        total = np.where(hashes[at] == g, totals[at], 0)
        by = np.lexsort((g, owner))
        new = np.concatenate([[True], (g[by][1:] != g[by][:-1]) | (owner[by][1:] != owner[by][:-1])])
        group = np.cumsum(new) - 1
        own = np.empty(len(g), np.int64)
        own[by] = np.bincount(group)[group]
        others.append(np.where(g == 0, 0, np.maximum(total - own, 0)).astype(np.float64))
    log = np.log(np.maximum(others[0], 0.5) / rest) if len(owner) else np.zeros(0)
    shorter = np.ones(len(owner), bool)
    for n in range(2, len(every) + 1):
        seen = others[n - 1] > 0
        before = np.ones(len(owner))
        before[1:] = others[n - 2][:-1]
        fits = every[n - 1] != 0  # the first words of a text have shorter contexts, at no cost
        log = np.where(seen, np.log(np.where(seen, others[n - 1], 1) / np.maximum(before, 1)), np.where(fits, log + np.log(backoff), log))
        shorter = np.where(fits, ~seen, shorter)
    score = np.bincount(owner, log, n_texts) if len(owner) else np.zeros(n_texts)
    return words, score, np.bincount(owner, shorter, n_texts).astype(np.int64) if len(owner) else np.zeros(n_texts, np.int64)


def score(df: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF, blocks: int | None = None) -> DataFrame:
    """(id, n_words, score, mean_score, n_backoff) for every row: the sum and mean of ln S over its words, and how many
    of them had to do with a shorter context.

    Null and empty texts, and those without words, have score 0 and a null mean. Repeated rows are texts of their own:
    each is part of the corpus for the others. Null ids stay. An empty table gives an empty table.
    """
    mine = df.select(common.quoted(id).cast("long").alias("id"), F.coalesce(common.quoted(text).cast("string"), F.lit("")).alias("text"))
    size, words = mine.select("text").mapInArrow(_sizes, "size long, words long").agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    blocks = blocks or max(1, -(-size // BLOCK_BYTES))
    # by the row's own number, so that neither an id nor copies of a text, even of whole rows, fill a block
    number = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    dealt = mine.select(number.alias("block"), "id", "text").repartition(blocks, "block")  # used twice, shuffled once
    asked = dealt.sortWithinPartitions("block").mapInArrow(_asked(order, blocks), "part int, block int, data binary")
    answers = asked.groupBy("part").applyInArrow(_answers, "block int, data binary")
    both = dealt.groupBy("block").cogroup(answers.groupBy("block"))
    found = both.applyInArrow(_scored(order, backoff, words), "id long, n_words long, score double, n_backoff long")
    mean = F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words"))
    return found.select(F.col("id").alias(id), "n_words", "score", mean.alias("mean_score"), "n_backoff")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of every document."""
    found = score(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round("mean_score", 6).alias("mean_score"), "n_backoff")


def _oracle() -> str:
    """Counts of words and pairs of all documents less those of the document itself, joined to its places."""
    return rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT doc_id, len(w) AS n, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS v FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d)),
        u AS (SELECT w, count(*) AS c FROM p GROUP BY w), ud AS (SELECT doc_id, w, count(*) AS c FROM p GROUP BY ALL),
        b AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY ALL), bd AS (SELECT doc_id, v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY ALL),
        t AS (SELECT count(*) AS total FROM p),
        s AS (SELECT p.doc_id, p.n, p.v IS NULL OR coalesce(b.c - bd.c, 0) <= 0 AS shorter, CASE
                WHEN p.v IS NOT NULL AND b.c - bd.c > 0 THEN ln((b.c - bd.c) / greatest(u2.c - ud2.c, 1)::DOUBLE)
                ELSE ln(greatest(u.c - ud.c, 0.5)::DOUBLE / greatest(total - p.n, 1)) + CASE WHEN p.v IS NULL THEN 0 ELSE ln({BACKOFF}::DOUBLE) END END AS s
              FROM p CROSS JOIN t JOIN u ON u.w = p.w JOIN ud ON ud.doc_id = p.doc_id AND ud.w = p.w
              LEFT JOIN b ON b.v = p.v AND b.w = p.w LEFT JOIN bd ON bd.doc_id = p.doc_id AND bd.v = p.v AND bd.w = p.w
              LEFT JOIN u u2 ON u2.w = p.v LEFT JOIN ud ud2 ON ud2.doc_id = p.doc_id AND ud2.w = p.v),
        g AS (SELECT doc_id, sum(s) AS s, count(*) AS n, count(*) FILTER (WHERE shorter) AS nb FROM s GROUP BY doc_id)
        SELECT d.doc_id, coalesce(g.n, 0)::BIGINT AS n_words, round(coalesce(g.s, 0), 4)::DOUBLE AS score, round(g.s / g.n, 6)::DOUBLE AS mean_score,
               coalesce(g.nb, 0)::BIGINT AS n_backoff FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


def oracles() -> dict[str, str]:
    return {"op8_lm_scoring": _oracle()}


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
