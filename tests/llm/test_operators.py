"""Operators on odd tables, and against brute force on made-up ones."""

import collections
import math
import random
import string

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from packlake.llm import byte_bpe, common, decontaminate, html_text, licenses, ngram_lm, sharding, simhash, syncmers, token_counts, toxicity
from packlake.llm.components import components

SCHEMA = "doc_id long, text string, score double, Slot int"
LONG = "word " * 20_000 + "x" * 30_000
ODD = [(1, "a b c d e", 0.5, 1), (1, "a b c d e", 0.5, 1), (2, None, None, None), (3, "", 0.1, 2), (None, "a b c d e", 0.1, 2), (None, None, None, None), (4, LONG, 0.1, 2), (5, " \t\n", 0.1, 2), (6, "ünï 😀 K", 0.2, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def tokenizer():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


# sharding


def test_shards_share_slots_and_few_move():
    names = sharding.names(10)
    a, b = sharding.fill(names, 1009), sharding.fill(names[:-1], 1009)
    n = np.bincount(a)
    assert n.max() - n.min() <= 1
    stays = (a != 9) & (a == b)
    assert stays.sum() > 0.8 * (a != 9).sum()
    heavy = np.bincount(sharding.fill({"x": 3, "y": 1}, 101))
    assert heavy[0] > 2.5 * heavy[1]
    for bad in ([], ["a", "a"], {"a": 0}):
        with pytest.raises(ValueError):
            sharding.fill(bad, 11)
    with pytest.raises(ValueError):
        sharding.fill(["a"], 12)


def test_placement_of_odd_rows(odd, empty):
    df = odd.drop("Slot")
    own = {"shard": sharding.fill(sharding.names(4), 101)}
    got = sharding.place(df, own).collect()
    assert len(got) == len(ODD) and all(0 <= r.shard < 4 and own["shard"][r.slot] == r.shard for r in got)
    assert len({r.slot for r in got if r.doc_id == 1}) == 1
    assert sharding.place(empty.drop("Slot"), own).count() == 0
    with pytest.raises(ValueError):
        sharding.place(odd, own)


def test_written_shards(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    sharding.write_shards(df, str(tmp_path / "out"), sharding.fill(sharding.names(4), 101), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and back.select("shard").distinct().count() == 4


# licenses


def test_license_labels(spark):
    notice = licenses.NOTICES[0].words.split()
    texts = [
        (1, "Released under the MIT License. Also the mit\nlicense; CC-BY."),
        (2, " ".join(notice).upper()),
        (3, " ".join(notice[:20] + ["really", "truly"] + notice[20:])),
        (4, "the license of mit and apache"),
        (5, "GNU General Public Licence"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 3, 9, "cc-by,mit")
    assert got[2].labels == "mit-text" and got[2].score == 1 and got[2].n_base == 0 and got[2].first_word is None
    assert got[3].labels == "mit-text" and got[3].score < 1 and got[3].spans[0]["first"] == 0
    assert got[4].labels == got[5].labels == "" and got[4].score == 0


def covered(words, template):
    """The best share of a notice's pairs that stand near their places, by trying every start that one of them gives."""
    t = template.words.split()
    pairs = list(zip(t, t[1:], strict=False))
    reach = licenses.reach_of(len(pairs))
    mine = list(zip(words, words[1:], strict=False))
    starts = {j - i for j, q in enumerate(mine) for i, p in enumerate(pairs) if p == q}
    return max((sum(p in mine[max(0, s + i - reach) : max(0, s + i + reach + 1)] for i, p in enumerate(pairs)) / len(pairs) for s in starts), default=0)


def test_notices_against_brute_force(spark):
    """Repeated words don't count twice, and what stands beside a notice takes nothing from it."""
    rng = random.Random(3)
    mit, bsd = (next(t for t in licenses.NOTICES if t.label == k).words.split() for k in ("mit-text", "bsd-text"))
    texts = [["of", "the", "software"] * 20, mit + ["of", "the", "software"] * 40, ["of", "the", "software"] * 40 + mit, mit + bsd + mit, bsd * 5]
    for _ in range(40):
        words = list(rng.choice([mit, bsd, mit + bsd]))
        for _ in range(rng.randint(1, 14)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 3)] = rng.choices(["of", "the", "software", "x", "and"], k=rng.randint(0, 4))
        texts.append(words)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(frame, licenses.NOTICES).collect()}
    for i, words in enumerate(texts):
        want = {t.label: covered(words, t) for t in licenses.NOTICES}
        want = {k: c for k, c in want.items() if c >= licenses.COVERAGE}
        assert got[i].labels == ",".join(sorted(want)) and got[i].score == pytest.approx(max(want.values(), default=0)), i
        assert all(0 <= s["first"] < s["end"] <= len(words) for s in got[i].spans)
    assert got[0].labels == "" and got[0].score == 0 and "mit-text" in got[1].labels and got[1].score == 1
    assert sum(s["label"] == "mit-text" for s in got[3].spans) == 2
    with pytest.raises(ValueError):
        licenses.scan(frame.withColumnRenamed("doc_id", "Score"), id="Score")


def test_licenses_of_odd_rows(odd, empty):
    got = licenses.scan(odd).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == sorted([(1, 5), (1, 5), (2, 0), (3, 0), (0, 5), (0, 0), (4, 20_001), (5, 0), (6, 3)])
    assert licenses.scan(empty).count() == 0


# toxicity


def made_up(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(200)]
    bad = ["zzvile", "zzfoul", "zzgrim"]
    rows = []
    for i in range(n):
        t = i % 5 == 0
        rows.append((" ".join(rng.choices(words, k=60) + (rng.choices(bad, k=5) if t else [])), int(t), i))
    return rows


def indexed(rows):
    hashes = toxicity._Hashes()
    terms, counts = zip(*[toxicity.count_terms(t, hashes) for t, _, _ in rows], strict=True)
    return toxicity.Index(terms, counts, [y for _, y, _ in rows], [i for *_, i in rows])


def cosines(rows, texts):
    """TF-IDF cosines of texts with all examples, by terms as strings and without any index."""
    def counted(text):
        return collections.Counter(t for w in toxicity.words_of(text) for t in (w, *(w[:k] + "*" for k in (4, 6) if len(w) > k)))

    docs = [counted(t) for t, _, _ in rows]
    n, positive = len(rows), sum(y for _, y, _ in rows)
    df = collections.Counter(t for d in docs for t in d)
    marked = collections.Counter(t for d, (_, y, _) in zip(docs, rows, strict=True) if y for t in d)
    weight = {t: (1 + math.log(n / df[t])) * math.log2(2 + (marked[t] / positive) / (max(1, df[t] - marked[t]) / (n - positive))) ** 2 for t in df}

    def vector(d):
        v = {t: (1 + math.log(c)) * weight[t] for t, c in d.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    known = [(i, vector(d)) for d, (_, _, i) in zip(docs, rows, strict=True)]
    for text in texts:
        v = vector(counted(text))
        yield {i: sum(x * u.get(t, 0) for t, x in v.items()) for i, u in known}


def test_nearest_examples_are_exact():
    docs = {r[0]: r[1] for r in duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()}
    labels = duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.01/labels.parquet' ORDER BY 1").fetchall()
    real = [(docs[i], y, i) for i, y in labels]
    for rows, texts in ((made_up(300), [t for t, _, _ in made_up(60, 1)]), (real, [docs[i] for i in sorted(docs)[:150]])):
        index = indexed(rows)
        for t, want in zip(texts, cosines(rows, texts), strict=True):
            number, cosine = index.nearest(t)
            assert len(number) == (toxicity.NEAREST if any(want.values()) else 0)
            assert np.allclose(cosine, sorted(want.values(), reverse=True)[: len(number)], atol=2e-5)
            assert np.allclose(cosine, [want[i] for i in index.ids[number]], atol=2e-5)
    index = indexed(made_up(300))
    assert all((index.score(t)[0] >= 0.7) == bool(y) for t, y, _ in made_up(60, 1))


def test_words_next_to_marks_and_without_spaces():
    assert toxicity.words_of("du—idiot ¿idiota? „Idiot“") == ["du", "idiot", "idiota", "idiot"]
    unspaced = toxicity.words_of("这是一个，" * 20 + "很坏的话。")
    assert {"坏", "很坏", "很坏的"} <= set(unspaced) and "个很" not in unspaced
    a, b = (toxicity.count_terms("x" * 60 + end, toxicity._Hashes())[0].tolist() for end in "yz")
    assert len(a) == len(b) == 3 and len(set(a) & set(b)) == 2  # the whole words differ


def test_toxicity_of_odd_rows(spark, odd, empty):
    docs = spark.createDataFrame([(i, t) for t, _, i in made_up(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for _, y, i in made_up(200)] + [(None, 1), (7, None), (999, 1)], "doc_id long, toxic int")
    index = toxicity.Index(*toxicity.examples(docs, labels))
    assert index.usable and all((i % 5 == 0) == (t == 1) for i, t in zip(index.ids, index.model.toxic, strict=True))
    few = toxicity.examples(docs, labels, most_bytes=3_000)
    assert 0 < len(few[0]) < 12 and set(few[3]) <= set(index.ids.tolist())
    got = toxicity.score(odd.drop("score"), index).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty.drop("score"), index).count() == 0
    with pytest.raises(ValueError):
        toxicity.score(odd, index)
    assert toxicity.keep_harmless(odd, index).columns == odd.columns
    none = toxicity.Index(*toxicity.examples(docs, labels.where("doc_id < 0")))
    assert not none.usable and none.score("a")[0] == 0


# near duplicates


def test_masks_cover_every_pair():
    import itertools

    for radius in (2, 4):
        all_masks = simhash.masks(radius)
        assert len(all_masks) == 2 ** (radius + 1) - 1
        rng = random.Random(0)
        for _ in range(3000):
            where = rng.sample(range(64), radius)
            differ = sum(1 << i for i in where)
            assert any(m & differ == 0 for m in all_masks)
    assert any(all(m >> i & 1 == 0 for i in pair) for pair in itertools.islice(itertools.combinations(range(64), 2), 5) for m in simhash.masks(2))


def groups(values, radius):
    values, out = list(values), {}
    for v in values:
        if v not in out:
            todo, out[v] = [v], v
            while todo:
                x = todo.pop()
                for y in values:
                    if y not in out and (x ^ y).bit_count() <= radius:
                        out[y] = v
                        todo.append(y)
    by = {}
    for v, g in out.items():
        by.setdefault(g, set()).add(v)
    return sorted(map(sorted, by.values()))


@pytest.mark.parametrize("most_in_task", [20_000, 10])
def test_links_lose_no_pair(spark, most_in_task):
    rng = random.Random(1)
    values = set()
    for _ in range(12):  # dense groups and chains
        base = rng.getrandbits(64)
        for _ in range(40):
            values.add(base)
            base ^= sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 5))) if rng.random() < 0.5 else 1 << rng.randrange(64)
    values |= {rng.getrandbits(64) for _ in range(200)} | {0}
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "v long")
    found = simhash.links(df, 4, most_in_task)
    roots = {r.node: r.root for r in components(found).collect()}
    by = {}
    for v in values:
        s = simhash._signed(v)
        by.setdefault(roots.get(s, s), set()).add(v)
    assert sorted(map(sorted, by.values())) == groups(sorted(values), 4)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(300, 300), (401, 400), (400, 401)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 200)}, 400: 400, 401: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    zero = [r for r in got if r.simhash == 0]
    assert {r.doc_id for r in zero} == {2, 3, None, 5} and {r.component for r in zero} == {2}
    assert {r.component for r in got if r.doc_id == 1} == {1}
    assert simhash.near_duplicates(empty).count() == 0


def test_one_of_each_group_stays(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(2000)]
    rows, want = [], set()
    for g in range(30):
        text = rng.choices(words, k=300)
        want.add(10 * g)
        for c in range(4):
            copy = list(text)
            for _ in range(c):
                copy[rng.randrange(300)] = rng.choice(words)
            rows.append((10 * g + c, " ".join(copy)))
        rows.append((10 * g + 9, " ".join(text[:150] + rng.choices(words, k=150))))
        want.add(10 * g + 9)
    rows += [(1000, None), (1001, ""), (1001, ""), (None, "alone"), (None, "alone")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(want | {1000})
    assert [r.text for r in got if r.doc_id is None] == ["alone"]


def test_one_stays_of_copies_close_to_the_bound(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(3000)]
    texts = []
    for n in (60, 300):
        for _ in range(10):
            text = rng.choices(words, k=n)
            tail, extended, edited = text[: n - n // 6], text + rng.choices(words, k=n // 8), list(text)
            for at in range(n // 120 + 1):
                edited[10 + at * 50] = "new"
            texts += [text, tail, extended, edited]
    base = rng.choices(words, k=300)
    for i in range(61):  # versions of one text, each with words of its own changed
        own = list(base)
        for at in rng.sample(range(300), 4):
            own[at] = f"v{i}x{at}"
        texts.append(own)
    sets = [set(simhash.shingle_set(" ".join(t).encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for x in range(len(texts)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both >= 0.8 * (len(sets[x]) + len(sets[y]) - both):
                p, q = root[x], root[y]
                root = [min(p, q) if r in (p, q) else r for r in root]
    want = {i for i, r in enumerate(root) if i == r}
    assert len(want) < len(texts) / 2
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == want


def test_one_stays_where_the_first_of_a_group_is_unlike(spark):
    rng = random.Random(4)
    words = list({"".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(300)})
    swapped = list(words)
    swapped[40], swapped[200] = swapped[200], swapped[40]
    half = words[150:]
    rng.shuffle(half)
    texts = [(0, words[:150] + half), (1, words), (2, swapped)]  # of the same words, so of one word-set fingerprint
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [0, 1]


def test_one_stays_of_odd_rows(odd, empty):
    got = simhash.keep_one(odd)
    assert got.columns == odd.columns and sorted(r.doc_id for r in got.collect()) == [1, 2, 4, 6]  # white space is as good as nothing
    assert simhash.keep_one(empty).count() == 0


# tokens


def test_cutter_and_counter_against_the_library(tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(tokenizer.decode())
    machine = token_counts.transducer(token_counts.compile_tokenizer(tokenizer))
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'LL", "'v", "e", "l", "1", "²", "é", "ж", "—", "　", "\x85", "!", "a", "the", "😀", "<|endoftext|>"]
    texts = ["", "<|endoftext|>", "=" * 500, "ab" * 900, " " * 300] + ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(1500)]
    assert machine.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("chunk", [1, 3, 64, 1000])
def test_chunks_compose(chunk):
    step, _ = token_counts.compile_cutter()
    classes = np.random.default_rng(0).integers(0, token_counts.CLASSES, 500).astype(np.uint8)
    state, want = token_counts.FRESH, []
    for c in classes:
        want.append(state)
        state = step[state, c]
    assert token_counts.run_states(step, classes, chunk).tolist() == want


def test_counts_survive_a_fresh_start(tokenizer, monkeypatch):
    machine = token_counts.transducer(token_counts.compile_tokenizer(tokenizer))
    texts = ["some ordinary words here", "quite different vocabulary there", "some ordinary words here"]
    want = machine.counts(texts)
    monkeypatch.setattr(token_counts, "MOST_STATES", 1)
    assert [machine.counts([t])[0] for t in texts] == want


def test_tokens_of_odd_rows(odd, empty, tokenizer, ranks):
    got = {(r.doc_id, r.text): r.n_tokens for r in token_counts.count_tokens(odd, tokenizer).collect()}
    assert got[2, None] == got[3, ""] == 0 and got[1, "a b c d e"] == 5
    assert token_counts.count_tokens(empty, tokenizer).count() == 0
    both = byte_bpe.round_trip(odd, ranks, public_tokenizers.PATTERN).collect()
    assert len(both) == len(ODD) and all(bytes(r.decoded).decode() == (r.text or "") and len(r.ids) == 4 * got[r.doc_id, r.text] for r in both)
    split = byte_bpe.decode(byte_bpe.encode(odd, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    assert {(r.doc_id, bytes(r.decoded)) for r in split.collect()} == {(r.doc_id, bytes(r.decoded)) for r in both}
    assert byte_bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(odd, ranks, public_tokenizers.PATTERN, out="SLOT")


def test_codec_against_the_library(ranks):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(ranks), special_tokens={})
    codec = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(chr(rng.choice([32, 10, 39, rng.randrange(32, 127), rng.randrange(0xD7FF), rng.randrange(0xE000, 0x110000)])) for _ in range(30))
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


# benchmark items


def test_changed_questions_are_found(spark):
    item = "At noon, John bought 5 red apples for 2 dollars each in the old market of London and John left."
    texts = [
        (1, item.replace("John", "Mary").replace("5", "12")),
        (2, "Before. " + item.upper() + " After."),
        (3, "John sold 5 green pears and went home to London."),
        (4, item.replace("London", "Rome") + " More " * 50),
        (5, "filler " * 2000 + item),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "a b"), (11, "five words are enough here")], "item_id long, text string")
    got = {r.id: r for r in decontaminate.matches(df, items).collect()}
    assert set(got) == {1, 2, 4, 5} and {r.item for r in got.values()} == {7} and not got[1].verbatim and got[5].verbatim
    assert [r.doc_id for r in decontaminate.clean(df, items).collect()] == [3]
    short = decontaminate.matches(spark.createDataFrame([(1, "Well, five words are enough here.")], "doc_id long, text string"), items)
    assert [r.item for r in short.collect()] == [11]


def test_items_without_spaces_or_of_numbers_are_found(spark):
    items = [(1, "如果小明有五个苹果，他又买了三个，请问他一共有多少个苹果？"), (2, "3 5 8 13 21 34 55 89"), (3, "Solve 3x + 5 = 20"), (4, "What is gravity?")]
    texts = [(i, f"Some words before.\n{q}\nAnd some more after.") for i, q in items]
    texts += [(12, "the numbers 3 5 8 13 21 34 55 90 are others"), (13, "solve 3x + 5 = 21"), (14, "he asked what is gravity and why")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = decontaminate.matches(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.id, r.item) for r in found) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_every_item_is_found_changed_too(spark):
    """Each benchmark item inside other prose: as it is, with other names and numbers, with a word more, one less."""
    items = [(r.item_id, r.text) for r in common.table(spark, "/root/testdata/sf0.01", "benchmark").collect()]
    rng = random.Random(1)
    filler = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(n))
    texts, want = [], set()
    for i, text in items:
        words, names = text.split(), {}
        other = [names.setdefault(w, str(rng.randint(10, 9_999)) if w.isdigit() else "Z" + filler(1)) if w.isdigit() or (k and w[0].isupper() and w.isalpha()) else w for k, w in enumerate(words)]
        at = rng.randrange(1, len(words))
        for changed in (words, other, [*words[:at], "quite", *words[at:]], words[:at] + words[at + 1 :]):
            want.add((len(texts), i))
            texts.append((len(texts), f"{filler(40)}\n{' '.join(changed)} {filler(30)}"))
    clean = range(len(texts), len(texts) + 50)
    texts += [(k, filler(200) + " the number of the people who are in the " + filler(50)) for k in clean]
    found = decontaminate.matches(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.id, r.item) for r in found}
    assert want <= got and not {d for d, _ in got} & set(clean)


def test_runs_are_runs(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(31)]
    changed = words[:]
    for at in (9, 18, 27):
        changed[at] = "other"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " x y z u v ".join(" ".join(words[i : i + 6]) for i in range(0, 30, 6)))], "doc_id long, text string")
    got = {r.id: r for r in decontaminate.matches(docs, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()}
    assert got[1].run == 31 and got[1].coverage == 1 and got[1].verbatim
    assert 2 not in got or (got[2].run == 9 and got[2].coverage < 0.7)
    assert 3 not in got  # pieces far apart are no item


def test_short_items_stand_alone(spark):
    docs = spark.createDataFrame([(1, "So it goes. Who wrote Hamlet? Nobody knows."), (2, "those who wrote hamlet and others")], "doc_id long, text string")
    found = decontaminate.matches(docs, spark.createDataFrame([(5, "Who wrote Hamlet?"), (6, "12 + 45 = 57 and 57 - 3 = 54 , 54 / 2 = 27")], "item_id long, text string"))
    assert [(r.id, r.item) for r in found.collect()] == [(1, 5)]


def test_decontamination_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "a b c d e"), (None, "x"), (2, "")], "item_id long, text string")
    got = decontaminate.clean(odd, items)
    assert got.columns == odd.columns and sorted(r.doc_id or 0 for r in got.collect()) == [0, 2, 3, 4, 5, 6]
    assert decontaminate.clean(empty, items).count() == 0
    assert decontaminate.clean(odd, items.where("item_id > 5")).count() == len(ODD)


# fingerprints


def test_next_rows_and_fingerprints_of_odd_rows(spark, odd, empty):
    rows = [(i, f"t{i}") for i in range(0, 400, 3)] + [(9, "again"), (None, "n1"), (None, "n2")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = syncmers.with_next(df, ["id", "text"], "id", F.xxhash64("text")).collect()
    follows = {(r.id, r.text): (r.next_id, r.next_text) for r in got}
    assert len(follows) == len(rows)
    at, seen = (399, "t399"), []
    while len(seen) < len(rows):
        seen.append(at)
        at = follows[at]
    assert at == (399, "t399") and len(set(seen)) == len(rows)
    ids = [i for i, _ in seen]
    assert ids == sorted((i for i, _ in rows if i is not None), reverse=True) + [None, None]
    one = syncmers.with_next(df.where("id = 9 and text = 't9'"), ["text"], "id", F.lit(0)).collect()
    assert [r.next_text for r in one] == ["t9"]
    found = syncmers.fingerprint(odd).collect()
    assert len(found) == len(ODD) and all((r.fingerprint == []) == (not (r.text or "").strip()) for r in found)
    assert syncmers.fingerprint(empty).count() == 0
    assert syncmers.with_next(empty, ["text"], "doc_id", F.lit(0)).count() == 0


def test_a_moved_passage_keeps_its_anchors(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdef", k=4)) for _ in range(60)]
    passage = " ".join(words)
    df = spark.createDataFrame([(1, passage), (2, "one two three four five " + passage)], "doc_id long, text string")
    a, b = (r.found for r in syncmers.with_anchors(df, "text", "found").orderBy("doc_id").collect())
    kept = {(x.pos + 5, x.hash) for x in a}
    assert kept <= {(x.pos, x.hash) for x in b}
    pair = spark.createDataFrame([(a, b)], "a array<struct<pos:int,hash:bigint>>, b array<struct<pos:int,hash:bigint>>")
    a, b = (syncmers.codes(F.col(c)) for c in "ab")
    moved, near = pair.select(syncmers.offsets(a, b), syncmers.likeness(a, b)).first()
    assert set(moved) == {5} and len(moved) == len(kept) and 0.8 < near < 1


def test_shared_passages_count_by_position(spark):
    """A passage that two long texts share counts; words of both in another order don't."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage, mine, other = [word() for _ in range(60)], [word() for _ in range(3_000)], [word() for _ in range(3_000)]
    lines = [" ".join(passage[i : i + 10]) for i in range(0, 60, 10)]
    texts = [" ".join(mine), " ".join(mine[:100] + passage + mine[100:]), " ".join(other[:2_000] + passage + other[2_000:]), " ".join(w for line in rng.sample(lines, 6) for w in [line, *other[:40]]), "x", "x", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    prints = {r.id: r.fingerprint for r in syncmers.fingerprint(frame).collect()}
    pairs = [(0, 1), (1, 2), (0, 2), (4, 5), (5, 6), (6, 6)]
    both = spark.createDataFrame([(n, prints[a], prints[b]) for n, (a, b) in enumerate(pairs)], "n int, a array<bigint>, b array<bigint>")
    got = [r[0] for r in both.orderBy("n").select(syncmers.likeness(F.col("a"), F.col("b"))).collect()]
    assert got[0] > 0.95 and 0.005 < got[1] < 0.03 and got[2] == 0 and got[3:] == [1, 0, 1]


def test_fingerprints_beside_clashing_names(spark):
    names = ["__words", "__runs", "__anchors", "__place", "__tie", "__to", "__late"]
    df = spark.createDataFrame([(i, f"text number {i} of some words that go on and on", *[i] * 7) for i in range(30)], "id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = syncmers.with_next(syncmers.fingerprint(df), ["text"], "id", F.lit(0))
    assert got.count() == 30 and got.where("__words != id or __late != id or __place != id").count() == 0


# language model


def brute(texts, order, backoff):
    words = [ngram_lm.words_of(t or "") for t in texts]
    out = []
    for i, own in enumerate(words):
        count = {}
        for j, w in enumerate(words):
            if j != i:
                for n in range(1, order + 1):
                    for k in range(len(w) - n + 1):
                        g = tuple(w[k : k + n])
                        count[g] = count.get(g, 0) + 1
        total = max(1, sum(len(w) for j, w in enumerate(words) if j != i))

        def s(g, count=count, total=total):
            if len(g) == 1:
                return max(count.get(g, 0), 0.5) / total
            return count[g] / max(1, count.get(g[:-1], 0)) if count.get(g) else backoff * s(g[1:])

        out.append(sum(math.log(s(tuple(own[max(0, k - order + 1) : k + 1]))) for k in range(len(own))))
    return out


@pytest.mark.parametrize("order, blocks", [(2, 1), (2, 5), (3, 3)])
def test_scores_against_brute_force(spark, order, blocks):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["a", "b", "c", "dd", "É"], k=rng.randrange(1, 12))) for _ in range(40)] + [None, "", "...", "a b c", "a b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_lm.score(df, order=order, blocks=blocks).collect()}
    for i, want in enumerate(brute(texts, order, ngram_lm.BACKOFF)):
        assert got[i].score == pytest.approx(want, abs=1e-9) and got[i].n_words == len(ngram_lm.words_of(texts[i] or ""))
        assert (got[i].mean_score is None) == (got[i].n_words == 0)


def test_scores_of_odd_rows(odd, empty):
    got = ngram_lm.score(odd.drop("score")).collect()
    assert len(got) == len(ODD)
    assert ngram_lm.score(empty).count() == 0


# pages


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<p>a<b>b</b>c<br>d &eacute; &amp;amp; x&nbsp;y</p>", "abc d é &amp; x y"),
        ("<script>var t='</p>';</script><article><h1>T</h1><p>Body <i>te</i>xt", "T Body text"),
        ("<body><header><h1>Site</h1></header><main><article><header><h2>T</h2></header><p>Body text</p><aside>x</aside><footer>by</footer></article>"
         "<section id=comments><article class=comment><p>a comment that is much longer than the article itself is</p></article></section></main>", "T Body text"),
        ("<div class=menu><a href=x>Home</a></div><div id=wrap><div class=sidebar><p>Side text, long enough to matter a lot.</p></div><div class=content>"
         "<p>This is a long paragraph of prose that goes on and on.</p><p>Short.</p><ul><li>point one</li></ul></div>"
         "<div class=comments><p>I disagree with this article very much.</p></div></div><div class=footer>Copyright</div>",
         "This is a long paragraph of prose that goes on and on. Short. point one"),
        ("<form><p>Subscribe</p></form><p style='display:none'>", ""),
        ("plain < text & more", "plain < text & more"),
        ("<article><p>one\n\n two\t</p><!-- no --><table><tr><td>a<td>b</table></article><div class=ad>buy</div>", "one two a b"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


PROSE = "This is a paragraph of prose that goes on for quite a while, and then for some more words of its own. "


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div class=legal-notes><p>{PROSE * 6}</p></div><p>tiny</p>", (PROSE * 6).strip()),  # a name alone does not decide
        (f"<div><a href=x>One</a> <a href=y>Two</a></div><div><span>Menu</span></div><div><p>{PROSE}</p><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p></div><div>Imprint</div>",
         f"{PROSE}{PROSE}Short one. {PROSE}".strip()),
        (f"<table><tr><td>Home<td>News</table><p>{PROSE}</p><p>So.</p><p>{PROSE}</p><div><b>a</b><i>b</i><b>c</b></div>", f"{PROSE}So. {PROSE}".strip()),
        ("<p>one</p><![foo[bar]]><p>two words</p><![CDATA[x]]>", "one two words"),
        (f"<article><p>{PROSE}</p><aside><p>{PROSE}</p></aside><p>End.</p></article>", f"{PROSE}End."),
        (f"<form action=x><article><p>{PROSE}</p></article></form>", PROSE.strip()),
    ],
)
def test_regions_by_ratio(page, want):
    assert html_text.main_text(page) == want


def test_threshold_and_smoothing_decide(monkeypatch):
    """Without either of them other text comes out, also beside an article element."""
    pages = [
        "<div><b>Home</b> page</div>" * 12 + f"<div><p>{PROSE}</p><p>{PROSE}</p></div>",
        f"<div class=ad>{PROSE}</div><article><p>Short.</p><p>{PROSE}</p></article><footer><p>{PROSE * 3}</p></footer>",
    ]
    want = [html_text.main_text(p) for p in pages]
    assert want == [f"{PROSE}{PROSE}".strip(), f"Short. {PROSE}".strip()]
    for always in (-1.0, 1e9):
        with monkeypatch.context() as m:
            m.setattr(html_text, "threshold", lambda _, at=always: at)
            assert html_text.main_text(pages[0]) != want[0] and html_text.main_text(pages[1]) != want[1]
    page = f"<p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p>" + "<p>No.</p>" * 9  # a short line between long ones is lifted
    assert html_text.upper_cluster(*lines_and_sizes(page))[:3] == [True, True, True]
    monkeypatch.setattr(html_text, "smoothed", lambda values: values)
    assert html_text.upper_cluster(*lines_and_sizes(page))[:3] == [True, False, True]


def lines_and_sizes(page):
    lines, _ = html_text.lines_of(page)
    return lines, [len("".join(x.text)) for x in lines]


def test_nested_pages_take_linear_time():
    import time

    def seconds(n):
        begin = time.process_time()
        assert html_text.main_text("<div>" * n + "<p>text</section></li></td>" * n).startswith("text text")
        return time.process_time() - begin

    seconds(1_000)
    assert seconds(60_000) < 12 * max(0.05, seconds(10_000))


def test_pages_with_odd_rows(odd, empty):
    got = html_text.extract(odd, "text").collect()
    assert len(got) == len(ODD) and all(r.main_text == " ".join((r.text or "").split()) for r in got)
    assert html_text.extract(empty, "text").count() == 0


def test_smoothing_and_threshold():
    assert html_text.smoothed([3.0] * 9) == pytest.approx([3.0] * 9)
    values = html_text.smoothed([0.0] * 5 + [10.0] * 5)
    assert values == sorted(values)
    assert 2 < html_text.threshold([1.0, 1.2, 0.9, 10.0, 11.0]) < 10
    assert html_text.threshold([5.0, 5.0]) == 5.0


def test_names_and_portions():
    assert common.unique_name(["Score"], "score") == "_score"
    assert [len(p) for p in common.portions(["aa", "b", "cccc", "d"], 3)] == [2, 1, 1]
