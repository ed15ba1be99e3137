"""Registered queries against SQL or a brute-force version, on the small tables."""

import collections
import hashlib
import os
import zlib

import duckdb
import harness
import numpy as np
import public_tokenizers
import pytest

from packlake.llm import registry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


def table(name, columns, sf=SMALL):
    return duckdb.sql(f"SELECT {columns} FROM '{sf}/{name}.parquet' ORDER BY 1").fetchall()


@pytest.fixture(scope="module")
def docs():
    return [(i, t or "") for i, t in table("documents", "doc_id, text")]


def rows(spark, name):
    return registry.queries()[name](spark, SMALL).collect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    harness.assert_same(registry.queries()[name](spark, SMALL), registry.oracle_sql()[name], SMALL)


def test_simhash(spark, docs):
    from xxhash import xxh64_intdigest

    want = {}
    for i, text in docs:
        words = text.encode().lower().split()
        shingles = [b" ".join(words[j : j + 4]) for j in range(max(1, len(words) - 3))] if words else []
        n = sum(1 << b for b in range(64) if 2 * sum(xxh64_intdigest(s, 42) >> b & 1 for s in shingles) > len(shingles))
        want[i] = n
    group = {i: i for i in want}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(want)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (want[i] ^ want[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op4_simhash_near_dedup")}
    assert got == {i: (f"{n:016x}", find(i)) for i, n in want.items()}


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in docs}
    text = dict(docs)
    got = rows(spark, "op5_token_counts")
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.n_bytes == len(text[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 512) for r in got)


def test_byte_bpe(spark, docs):
    import struct

    import tiktoken

    from packlake.llm.byte_bpe import read_ranks

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in rows(spark, "op10_byte_bpe")}
    assert len(got) == len(docs)
    for i, text in docs:
        ids = library.encode_ordinary(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def anchors(words, k=8, s=2):
    """(place, hash) of closed syncmers, by their definition."""
    from xxhash import xxh64_intdigest

    def chained(parts):
        h = 42
        for p in parts:
            h = xxh64_intdigest(p, h)
        return h

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    runs = [chained(w.encode() for w in words[i : i + s]) for i in range(len(words) - s + 1)]
    out = []
    for i in range(len(words) - k + 1):
        inner = runs[i : i + k - s + 1]
        if min(map(signed, inner)) in (signed(inner[0]), signed(inner[-1])):
            out.append((i, chained(h.to_bytes(8, "little") for h in inner[::s])))
    return out or ([(0, chained(w.encode() for w in words))] if words else [])


def alike(a, b):
    """Share of the anchors of two texts that both have, at a distance that another one has too."""
    a, b = ({h >> 26: p for p, h in reversed(x)} for x in (a, b))
    moved = collections.Counter(b[h] - a[h] for h in a.keys() & b.keys())
    if a == b:
        return 1.0
    both = sum(n for n in moved.values() if n > 1 or 1 in (len(a), len(b)))
    return 2 * both / (len(a) + len(b))


def test_syncmers(spark, docs):
    from pyspark.sql import functions as F

    from packlake.llm import syncmers

    got = {r.doc_id: r for r in rows(spark, "op7_syncmer_fingerprints")}
    order = sorted(docs, reverse=True)
    texts = {}
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        texts[i] = (text, text[: len(text) - half] + following[:half], following)
    frame = spark.createDataFrame([(i, *t) for i, t in texts.items()], "doc_id long, a string, b string, c string")
    for r in frame.select("doc_id", *[syncmers.words(F.col(c)).alias(c) for c in "abc"]).collect():
        text, edited, _ = texts[r.doc_id]
        found, g = [anchors(r[c]) for c in "abc"], got[r.doc_id]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for x, shown in zip(found, (g.fingerprint, g.edited_fingerprint), strict=False):
            first = {h >> 26: p for p, h in reversed(x)}
            assert shown == "".join(f"{h << 25 | p:016x}" for h, p in sorted(first.items()))
        assert g.near_edited == pytest.approx(alike(found[0], found[1])) and g.near_next == pytest.approx(alike(found[0], found[2]))
    by_text = collections.defaultdict(set)
    for i, text in docs:
        by_text[text].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_toxicity(spark, docs):
    sf = "/root/testdata/sf0.01"
    got = registry.queries()["op3_toxicity"](spark, sf).collect()
    toxic = dict(table("labels", "doc_id, toxic", sf))
    assert len(got) == len(table("documents", "doc_id", sf))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    seen = [(r.score, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    scores, y = map(np.array, zip(*seen, strict=True))
    area = np.mean([(p > scores[y == 0]).mean() + (p == scores[y == 0]).mean() / 2 for p in scores[y == 1]])
    assert area > 0.85 and (scores[y == 1] >= 0.7).mean() > 0.7 and (scores[y == 0] >= 0.7).mean() < 0.05


def test_decontamination(spark, docs):
    items = table("benchmark", "item_id, text")
    want = {(i, k) for i, t in docs for k, q in items if q in t}
    got = {(r.doc_id, r.item_id) for r in rows(spark, "op6_benchmark_decontamination")}
    assert want <= got
    plain = lambda t: " ".join(t.lower().split())
    text, question = dict(docs), dict(items)
    assert all(plain(question[k]).rstrip(".") in plain(text[i]) for i, k in got)


def test_html(spark):
    import html
    import re

    pages = {i: h for i, h in table("pages", "page_id, html")}
    for r in rows(spark, "op9_html_extraction"):
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        body = re.sub(r"<!--.*?-->", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", body))
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", body)).split())
        assert r.text == want and r.n_chars == len(want)
