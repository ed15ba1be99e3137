"""Toxicity by the nearest labelled examples.

Up to `per_class` labelled rows of each class become examples. Their terms, all words and beginnings of words, make up the
vocabulary; none is left out. A term weighs (1 + ln count) * idf * rf ** 2 in a text, where idf = 1 + ln(n / df), and rf, the
relevance frequency of supervised term weighting, is log2(2 + its share of the toxic examples over that of the others).
Texts are compared with examples by the cosine of these vectors.

The index is inverted and in blocks of examples. The lists of rare terms are short and are added up. For each frequent
term and block the largest weight is kept, so the sum over a text's frequent terms bounds what they can add to any
example of the block; blocks whose bound can't reach the k-th best sum so far are passed over. So the k nearest are exact.
They vote with weights that grow as the distance shrinks. Votes are calibrated by a logistic curve fitted crosswise: each
example's vote comes from a model that has seen neither it nor the others of its fold, terms and weights included.

The index has a bounded size whatever the number of rows (see PER_CLASS and SAMPLE_BYTES), so it is broadcast; documents
are read once, nothing of them is shuffled.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import MARKS, SOLID

#: Bound of the sample that examples are drawn from: rows of each class, those of the smallest hashes of their ids; and
#: bytes of their texts, beyond which later ones are left out as a whole.
PER_CLASS, SAMPLE_BYTES = 1_500, 32 << 20
#: Characters of the beginnings of words that are terms too.
BEGINNINGS = (4, 6)
#: Characters taken together as a word in scripts without spaces.
GRAMS = (1, 2, 3)
NEAREST = 15
BLOCK = 64
INNER = np.arange(BLOCK)
#: A term of more than one in so many examples is frequent.
FREQUENT = 16
#: Folds of examples for the calibration.
FOLDS = 5
#: Examples named as evidence.
EVIDENCE = 3
THRESHOLD = 0.7
#: Distinct words that a worker remembers.
CACHE = 200_000

#: All ASCII characters but letters stand between words.
SPACED = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


UNSPACED = re.compile(f"[{SOLID}]")
RUN = re.compile(rf"(?:(?![{SOLID}])[^\W\d_][{MARKS}]*)+|(?:(?=[{SOLID}])[^\W\d_][{MARKS}]*)+")
LETTERS = re.compile(rf"(?:[^\W\d_]+[{MARKS}]*)+")
UNIT = re.compile(rf"[^\W\d_][{MARKS}]*")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; of scripts without spaces, single characters and all runs of two and three."""
    text = text.lower()
    if text.isascii():
        return text.encode().translate(SPACED).decode().split()
    if not UNSPACED.search(text):
        return LETTERS.findall(text)
    out = []
    for run in RUN.findall(text):
        if UNSPACED.match(run):
            units = UNIT.findall(run)
            for size in GRAMS:
                out += ["".join(units[i : i + size]) for i in range(len(units) - size + 1)]
        else:
            out.append(run)
    return out


def terms_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def held_out(id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class _Hashes(dict):
    """The terms of words: their hashes, zero where a word has fewer, or what `make` turns these into."""

    def __init__(self, make=lambda hashes: hashes):
        self.make, self.new = make, []
        self.table = make(np.zeros((1 << 12, 1 + len(BEGINNINGS)), np.uint64))  # doubled when it is full

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        found = [xxh64_intdigest(t) or 1 for t in terms_of(word)]
        self.new.append(found + [0] * (1 + len(BEGINNINGS) - len(found)))
        self[word] = len(self)
        return len(self) - 1

    def of(self, words: list[str]) -> np.ndarray:
        """A row for each word."""
        if len(self) > CACHE:
            self.clear()
        known = len(self)
        number = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        while len(self.table) < len(self):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if self.new:
            self.table[known : len(self)] = self.make(np.array(self.new, np.uint64))
            self.new = []
        return self.table[number]


def count_terms(text: str, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms of a whole text, sorted, and how often each occurs."""
    every = hashes.of(words_of(text)).ravel()
    return np.unique(every[every != 0], return_counts=True)


def _alike_together(rows: np.ndarray) -> np.ndarray:
    """An order of the rows in which those of a block point to much the same side: halved again and again along the
    direction in which they differ most."""

    def halved(part: np.ndarray) -> list[np.ndarray]:
        if len(part) <= BLOCK:
            return [part]
        own = rows[part] - rows[part].mean(0)
        axis = own[np.argmax((own * own).sum(1))]
        for _ in range(12):  # power iteration
            axis = own.T @ (own @ axis)
            axis = axis / (np.linalg.norm(axis) or 1)
        part = part[np.argsort(own @ axis, kind="stable")]
        half = -(-len(part) // (2 * BLOCK)) * BLOCK  # whole blocks
        return halved(part[:half]) + halved(part[half:])

    return np.concatenate(halved(np.arange(len(rows))))


class Model:
    """Weights of terms, and the inverted index of some examples."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], toxic: np.ndarray):
        """terms and counts: of each example, as count_terms gives them."""
        n, positive = len(terms), float(toxic.sum())
        self.n, self.toxic = n, toxic.astype(np.float64)
        owner = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in terms])
        self.terms, number = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]), return_inverse=True)
        df = np.bincount(number, minlength=len(self.terms))
        marked = np.bincount(number, self.toxic[owner], len(self.terms))
        other = np.maximum(1, df - marked) / max(1.0, n - positive)
        self.weight = (1 + np.log(n / np.maximum(1, df))) * np.log2(2 + marked / max(1.0, positive) / other) ** 2
        often = df * FREQUENT > n
        self.n_often = int(often.sum())
        self.place = np.empty(len(df), np.int32)  # frequent terms first
        self.place[np.argsort(~often, kind="stable")] = np.arange(len(df))
        value = (1 + np.log(np.concatenate([np.zeros(0), *counts]))) * self.weight[number]
        value /= np.sqrt(np.bincount(owner, value * value, n))[owner]
        place = self.place[number]
        some = place < self.n_often
        blocks = max(1, -(-n // BLOCK))
        often = np.zeros((blocks * BLOCK, self.n_often), np.float32)
        often[owner[some], place[some]] = value[some]
        self.order = _alike_together(often[:n])
        self.toxic = self.toxic[self.order]
        where = np.empty(n, np.int32)
        where[self.order] = np.arange(n)
        owner = where[owner]
        often[:n] = often[self.order]
        #: By block, frequent term and example of the block; and the largest weight by term and block.
        self.often = np.ascontiguousarray(often.reshape(blocks, BLOCK, self.n_often).transpose(0, 2, 1))
        self.bound = np.ascontiguousarray(self.often.max(2).T)
        by = np.lexsort((owner[~some], place[~some]))
        self.holder, self.value = owner[~some][by].astype(np.intp), value[~some][by]
        weight, self.weight = self.weight, np.empty(len(df))
        self.weight[self.place] = weight  # by place
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(place[~some] - self.n_often, minlength=len(df) - self.n_often))])

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where terms stand in the index, -1 for unknown ones."""
        if not len(self.terms):
            return np.full(terms.shape, -1, np.int32)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.place[at], np.int32(-1))

    def vector(self, place: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of the known terms of a text, of length one; empty for a text without any."""
        place, counts = place[place >= 0], counts[place >= 0]
        w = (1 + np.log(counts)) * self.weight[place]
        return place, w / math.sqrt(float(w @ w)) if len(w) else w

    def nearest(self, place: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the NEAREST examples, best first, of equal ones (to six digits) the first."""
        if not len(place):
            return np.zeros(0, np.int64), np.zeros(0)
        some = place < self.n_often
        at = place[~some] - self.n_often
        first, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        every = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        sums = np.zeros(len(self.often) * BLOCK)
        sums += np.bincount(self.holder[every], self.value[every] * np.repeat(w[~some], size), len(sums))
        at, w = place[some], w[some].astype(np.float32)
        number = np.arange(self.n)
        if len(at):
            reach = sums.reshape(-1, BLOCK).max(1) + w @ self.bound[at]
            first = np.argsort(-reach)
            done, worst, step = 0, -1.0, 2
            while done < len(first):
                blocks = first[done : done + step]
                blocks = blocks[reach[blocks] >= worst - 1e-5]
                if not len(blocks):
                    break
                for b in blocks.tolist():
                    sums[b * BLOCK : (b + 1) * BLOCK] += w @ self.often[b][at]
                done += step
                number = (first[:done, None] * BLOCK + INNER).ravel()
                number = number[number < self.n]
                if len(number) >= NEAREST:
                    worst = np.partition(sums[number], len(number) - NEAREST)[len(number) - NEAREST]
        number = np.sort(number)
        cosine = np.minimum(1.0, sums[number])
        if len(number) > 4 * NEAREST:
            top = cosine >= np.partition(cosine, len(cosine) - NEAREST)[len(cosine) - NEAREST] - 2e-6
            number, cosine = number[top], cosine[top]
        best = np.lexsort((number, -np.round(cosine, 6)))[:NEAREST]
        return number[best], cosine[best]


class Index:
    """The nearest examples of texts, and calibrated votes."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], toxic: list[int], ids: list[int], share: float | None = None):
        """terms and counts: of each example, as count_terms gives them. share: of toxic rows among all labelled ones,
        where the examples don't have that share."""
        n, positive = len(ids), int(sum(toxic))
        self.share = share if share is not None else positive / max(1, n)
        self.usable = 0 < positive < n
        self.curve = (0.0, 1.0)
        self._places = None
        if not self.usable:
            return
        #: Weight of a vote for each class, so that classes count by their shares among all labelled rows.
        self.weight = (self.share * n / positive, (1 - self.share) * n / (n - positive))
        by = sorted(range(n), key=lambda i: (toxic[i], ids[i]))
        terms, counts = [terms[i] for i in by], [counts[i] for i in by]
        label, fold = np.array([toxic[i] for i in by]), np.arange(n) % FOLDS
        raw = np.full(n, self.share)
        for f in range(FOLDS if n > 2 * FOLDS else 0):
            rest = np.flatnonzero(fold != f)
            if 0 < label[rest].sum() < len(rest):
                model = Model([terms[i] for i in rest], [counts[i] for i in rest], label[rest])
                for i in np.flatnonzero(fold == f):
                    raw[i] = self._vote(model, *model.nearest(*model.vector(model.places(terms[i]), counts[i])))
                del model  # the driver holds one at a time
                common.trim()
        self._fit(raw, label)
        self.model = Model(terms, counts, label)
        self.ids = np.array([ids[i] for i in by], np.int64)[self.model.order]

    def __getstate__(self):
        return self.__dict__ | {"_places": None}

    def _vote(self, model: Model, number: np.ndarray, cosine: np.ndarray) -> float:
        if not len(number):
            return self.share
        y = model.toxic[number]
        weight = np.where(y == 1, self.weight[0], self.weight[1]) / (1.02 - cosine)
        return float((weight * y).sum() / weight.sum())

    def _fit(self, raw: np.ndarray, label: np.ndarray) -> None:
        """Newton's steps for a logistic curve over the log-odds of votes, classes weighted by their shares."""
        x = np.stack([np.ones(len(raw)), self._odds(raw)], 1)
        weight = np.where(label == 1, self.weight[0], self.weight[1])
        beta = np.array([0.0, 1.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            gradient = x.T @ (weight * (label - p)) - 1e-3 * beta
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(hessian, gradient)
            beta = beta + np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-8:
                break
        self.curve = (float(beta[0]), max(1e-3, float(beta[1])))

    @staticmethod
    def _odds(raw):
        p = np.clip(raw, 0.005, 0.995)
        return np.log(p / (1 - p))

    def nearest(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if self._places is None:
            self._places = _Hashes(self.model.places)
        every = self._places.of(words_of(text)).ravel()
        return self.model.nearest(*self.model.vector(*np.unique(every[every >= 0], return_counts=True)))

    def score(self, text: str) -> tuple[float, list[int], list[float]]:
        """Score from 0 to 1, and the ids and cosines of the nearest examples."""
        if not self.usable:
            return self.share, [], []
        number, cosine = self.nearest(text)
        a, b = self.curve
        odds = float(self._odds(self._vote(self.model, number, cosine)))
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * odds))))
        return p, self.ids[number[:EVIDENCE]].tolist(), cosine[:EVIDENCE].tolist()


def examples(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS, most_bytes: int = SAMPLE_BYTES
):
    """Terms, counts, labels and ids of the examples, and the share of toxic rows among all rows to learn from.

    Ids are whole numbers. Rows of the fold held out are left out, as are null labels and ids, and labels but 0 and 1; of
    several labels of one id the largest counts, of several texts the smallest. Null and empty texts have no terms. Texts
    are taken whole or not at all: in the order of the hashes of their ids, as long as a class has no more than per_class
    of them and all of them together most_bytes.
    """
    known = labels.where(~held_out(common.quoted(id)) & common.quoted(id).isNotNull() & common.quoted(label).isNotNull())
    known = known.groupBy(common.quoted(id).alias("id")).agg(F.max(common.quoted(label)).cast("int").alias("label")).where("label in (0, 1)")
    sizes = docs.groupBy(common.quoted(id).cast("long").alias("id")).agg(F.max(F.coalesce(F.octet_length(common.quoted(text).cast("string")), F.lit(0))).alias("size"))
    known = known.join(sizes, "id")
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    first = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    chosen, used = [], 0
    for r in sorted(first[0].union(first[1]).withColumn("turn", F.xxhash64("id")).collect(), key=lambda r: (r.turn, r.id)):  # at most 2 * per_class rows of numbers
        if used + r["size"] <= most_bytes:
            chosen.append((r.id, r.label))
            used += r["size"]
    if not chosen:
        return [], [], [], [], 0.0
    ids = docs.sparkSession.createDataFrame(chosen, "id long, label int")
    mine = docs.select(common.quoted(id).cast("long").alias("id"), F.coalesce(common.quoted(text).cast("string"), F.lit("")).alias("text"))
    found = mine.join(F.broadcast(ids), "id").select("id", "label", "text")

    def counted(batches):  # a text comes to the driver as the hashes and counts of its terms
        hashes = _Hashes()
        for batch in common.slices(batches):
            got = [count_terms(t, hashes) for t in batch.column("text").to_pylist()]
            packed = [pa.array([c.astype(k).tobytes() for c in column], pa.binary()) for column, k in zip(zip(*got, strict=True), (np.uint64, np.uint32), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *packed], names=["id", "label", "terms", "counts"])

    one = found.groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    rows = sorted(one.mapInArrow(common.frugal(counted), "id long, label int, terms binary, counts binary").collect(), key=lambda r: r.id)
    terms, counts = ([np.frombuffer(r[c], k) for r in rows] for c, k in (("terms", np.uint64), ("counts", np.uint32)))
    return terms, counts, [r.label for r in rows], [r.id for r in rows], toxic / total


def score(
    df: DataFrame, index: Index, text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("score", "evidence", "evidence_cosine")
) -> DataFrame:
    """The columns `keep` (all by default) with score double, evidence array<long> and evidence_cosine array<double>,
    or of other names.

    A text without known words (null, empty, or without letters) has no neighbours: its score is what the share of toxic
    rows gives. Without examples of both classes every score is that share. Very long texts are scored whole. Of equally
    near examples the one that comes first in the index counts. Repeated rows stay; an empty table gives an empty table;
    columns of these names must not be there yet.
    """
    keep = df.columns if keep is None else keep
    new = list(zip(names, [T.DoubleType(), T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())], strict=True))
    if {n.lower() for n in names} & {c.lower() for c in keep}:
        raise ValueError("the table already has a column of that name")
    shared = df.sparkSession.sparkContext.broadcast(index)
    common.trim()  # of the driver, which has built and written the index

    def make():
        own = shared.value

        def run(texts):
            got = [own.score(t or "") for t in texts.to_pylist()]
            return [
                pa.array([g[0] for g in got], pa.float64()),
                pa.array([g[1] for g in got], pa.list_(pa.int64())),
                pa.array([g[2] for g in got], pa.list_(pa.float64())),
            ]

        return run

    return common.map_arrow(df, [common.quoted(text).cast("string")], new, make, keep)


def keep_harmless(df: DataFrame, index: Index, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df`, with all their columns, whose score is below the threshold."""
    names = tuple(common.unique_name(df.columns, n) for n in ("score", "evidence", "evidence_cosine"))
    return score(df, index, text, names=names).where(common.quoted(names[0]) < threshold).select(*map(common.quoted, df.columns))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    index = Index(*examples(docs, common.table(spark, sf_dir, "labels")))
    return score(docs, index, keep=["doc_id"]).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "evidence",
        "evidence_cosine",
    )


QUERIES = {"op3_toxicity": op3_toxicity}
