"""Every stage against a brute-force version, and all of them together."""

import collections
import itertools
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from packlake.llm import common, simhash

SMALL = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


def firsts(texts, similarity=0.8):
    """The smallest id of each group of texts alike, by all shared shingles of all pairs that have any."""
    sets = {i: set(simhash.shingle_set((t or "").encode(), 5).tolist()) for i, t in texts.items()}
    holders = collections.defaultdict(list)
    for i in sorted(sets):
        for h in sets[i]:
            holders[h].append(i)
    common_ = collections.Counter(pair for group in holders.values() if len(group) > 1 for pair in itertools.combinations(group, 2))
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for (x, y), n in common_.items():
        if n >= similarity * (len(sets[x]) + len(sets[y]) - n):
            a, b = find(x), find(y)
            group[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) == i}


def test_near_duplicates_whole(spark):
    """No link is lost on all documents of sf0.1."""
    docs = common.table(spark, LARGER, "documents").select("doc_id", "text")
    got = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert got == firsts({r.doc_id: r.text for r in docs.collect()})


def test_near_duplicates_made(spark):
    """Versions of a text with words changed, cut or added, near the limit; a chain whose middle goes; one order of words."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    rows = {}
    for n in (8, 30, 60, 300):
        for _ in range(12):
            base = [word() for _ in range(n)]
            for _ in range(rng.randint(2, 9)):
                mine = base[:]
                kind = rng.randrange(4)
                if kind == 0:
                    for at in rng.sample(range(n), max(1, rng.randint(1, n // 30 + 1))):
                        mine[at] = word()
                elif kind == 1:
                    mine = mine[: n - rng.randint(0, n // 4)]
                elif kind == 2:
                    mine += [word() for _ in range(rng.randint(0, n // 4))]
                else:
                    mine[0], mine[-1] = mine[-1], mine[0]
                rows[len(rows)] = " ".join(mine)
    first = [word() for _ in range(60)]  # a dense group of one base, each version with changes of its own
    for _ in range(200):
        mine = first[:]
        mine[rng.randrange(60)] = word()
        rows[len(rows)] = " ".join(mine)
    passage = " ".join(word() for _ in range(40))  # texts unlike each other under common shingles
    for _ in range(150):
        rows[len(rows)] = passage + " " + " ".join(word() for _ in range(rng.choice((3, 7, 9, 11))))
    turned = [word() for _ in range(80)]
    rows |= {len(rows): " ".join(turned[40:] + turned[:40]), len(rows) + 1: " ".join(turned), len(rows) + 2: " ".join([turned[1], turned[0], *turned[2:]])}
    rows |= {len(rows): "", len(rows) + 1: None, len(rows) + 2: "one", len(rows) + 3: "one"}
    ids = list(rows)
    rng.shuffle(ids)
    frame = spark.createDataFrame([(i, rows[j]) for i, j in enumerate(ids)], "doc_id long, text string")
    got = {r.doc_id for r in simhash.keep_one(frame).collect()}
    assert got == firsts({i: rows[j] or "" for i, j in enumerate(ids)})


def test_near_duplicates_odd_rows(spark):
    """Nulls, repeated rows, one id of several texts, clashing names."""
    rows = [(1, "a b", 1), (1, "a b", 1), (1, "c d", 2), (2, "a b", 3), (None, "a b", 4), (None, "e f", 5), (None, "e f", 5), (3, None, 6), (4, "", 7)]
    names = ["doc_id", "text", "__row", "__k1", "__k2", "__k3", "__node", "root", "k1"]
    frame = spark.createDataFrame([(i, t, n, *[n] * 6) for i, t, n in rows], "doc_id long, text string, " + ", ".join(f"{c} int" for c in names[2:]))
    got = simhash.keep_one(frame)
    assert got.columns == names
    assert sorted(r["__row"] for r in got.collect()) == [1, 2, 5, 6]
    assert simhash.keep_one(frame.limit(0)).count() == 0


def shuffled(spark) -> int:
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_near_duplicates_move_few_texts(spark):
    """Of texts mostly unlike each other, those move that may have a near copy, not all of them in each round and at the end."""
    rng = random.Random(8)
    word = lambda: rng.randbytes(40).hex()
    texts = [[word() for _ in range(300)] for _ in range(800)]
    passage = [word() for _ in range(30)]
    for i in range(100):  # under common shingles, and so in several rounds
        texts[i][:30] = passage
    copies = [[*x[:-1], word()] for x in texts[200:220]]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts + copies)]
    docs = common.checkpoint(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    before = shuffled(spark)
    got = {r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()}
    assert got == set(range(len(texts)))
    moved = shuffled(spark) - before
    assert 0 < moved < 0.5 * sum(len(t) for _, t in rows), moved  # hashes are most of that


def test_parities_never_part_what_is_alike():
    rng = np.random.default_rng(4)
    for n, m, both in [(1, 1, 1), (1, 1, 0), (63, 66, 60), (64, 65, 64), (500, 520, 480), (1000, 1030, 1000), (1020, 5, 0), (700, 700, 0)]:
        x = rng.choice(np.iinfo(np.int64).max, n + m - both, replace=False).astype(np.uint64) if n + m < 10 else np.unique(rng.integers(0, 2**64, n + m - both, np.uint64))
        rng.shuffle(x)
        a, b = x[:n], x[n - both :]
        found = simhash._differ(simhash._parity(a), simhash._parity(b))
        assert found == simhash._differ(simhash._parity(b), simhash._parity(a)) <= n + m - 2 * both
        assert (found == 0) == (n + m == 2 * both)
    assert found > 2 * 700 - 2 * simhash._least_common(700, 700, 0.8)  # and parts what shares nothing


@pytest.mark.parametrize("most", [1 << 6, 1 << 25])
def test_marks_leave_out_nothing_wanted(spark, monkeypatch, most):
    """Also by a filter far too small; with clashing names."""
    monkeypatch.setattr(simhash, "FILTER_BITS", most)
    frame = spark.range(2000).select("id", F.xxhash64("id").alias("__word"), F.lit(1).alias("__held"), F.lit("a").alias("x.y"))
    wanted = frame.where("id % 10 = 3").select("__word")
    got = simhash._marked(frame, F.col("__word"), wanted, "mark")
    assert got.columns == [*frame.columns, "mark"]
    marks = {r.id: r.mark for r in got.select("id", "mark").collect()}
    assert len(marks) == 2000 and all(marks[i] for i in range(3, 2000, 10))
    assert sum(marks.values()) < 400 or most == 1 << 6
    assert not simhash._marked(frame, F.col("__word"), wanted.limit(0), "mark").where("mark").count()


def test_stages(spark):
    docs = common.table(spark, SMALL, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    toxic = {i for i, t in duckdb.sql(f"SELECT doc_id, toxic FROM '{SMALL}/labels.parquet'").fetchall() if t}
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall()]
    kept = [set(text)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.checkpoint(stage(spark, docs, SMALL))
        assert after.columns == docs.columns, name
        docs = after
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert kept[-1] <= kept[-2]
    assert len(kept[1] & toxic) <= 0.5 * len(toxic) and len(kept[1]) >= 0.8 * (len(text) - len(toxic))
    assert kept[2] == firsts({i: text[i] for i in kept[1]})
    assert not any(q in text[i] for i in kept[3] for q in items)
    assert kept[2] - kept[3] == {i for i in kept[2] if any(" ".join(q.lower().split()).rstrip(".") in " ".join(text[i].lower().split()) for q in items)}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in last} == kept[3] and all(r.lossless and len(r.ids) == 4 * r.n_tokens for r in last)


def test_run(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.select(F.count("*"), F.every("lossless")).first()[1] and np.isfinite(got.count())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_the_driver_gives_memory_back(spark):
    def resident() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    held = [b"x" * (100_000 + i % 2) for i in range(3_000)]
    last = held.pop()  # what lies above keeps the allocator from doing so by itself
    held.clear()
    before = resident()
    common.release(spark)
    assert before - resident() > 150 and last
