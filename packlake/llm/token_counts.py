"""Token counts from a tokenizer compiled to finite-state transducers.

Two deterministic machines replace a byte-level BPE tokenizer:

* The cutter reads character classes. It has nine states; its boundaries (where a pre-token begins) are annotated on
  its transitions with one class of look-ahead. A text is cut into chunks; each chunk yields a state map (from every
  possible first state to the last one), the maps are composed by a parallel prefix scan, and each chunk then runs
  from the state so found.
* The counter reads the bytes of a pre-token. A state holds, for each way in which the bytes read so far may still be
  the beginning of a token, the token before it and how many tokens came before, relative to the tokens that the bytes
  read make as they stand. Each transition is annotated with the change of that number, so the sum along the path is
  the number of tokens. Two tokens may follow each other if BPE of their bytes gives just these two; a byte string has
  exactly one sequence in which all neighbours may, and it is what BPE gives. States are made when first reached and
  are dropped, all together, when there are too many: memory is bounded, results stay the same.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Classes of characters. The letters s t m d end a contraction of two characters; r, v, l and e make those of three.
END, SPACE, OTHER_SPACE, LETTER, STMD, RV, ELL, EE, NUMBER, QUOTE, MARK = range(11)
CLASSES = 11
#: States of the cutter: what stands before the next character.
FRESH, IN_LETTERS, IN_NUMBERS, IN_MARKS, AFTER_SPACE, AFTER_OTHER, AFTER_QUOTE, QUOTE_RV, QUOTE_L = range(9)
STATES = 9
CHUNK = 512
#: States of the counter that a worker holds before it starts afresh.
MOST_STATES = 250_000
PORTION = 1_500_000
#: Bits of a table entry that hold the change of the count, which lies between -SHIFTED and SHIFTED.
BITS, SHIFTED = 9, 250


def compile_cutter() -> tuple[np.ndarray, np.ndarray]:
    """Next state by (state, class), and whether a pre-token begins by (state, class, next class)."""
    letters, spaces = (LETTER, STMD, RV, ELL, EE), (SPACE, OTHER_SPACE)
    step = np.zeros((STATES, CLASSES), np.uint8)
    begins = np.zeros((STATES, CLASSES, CLASSES), bool)
    for s in range(STATES):
        for c in range(CLASSES):
            if c == END:
                to = FRESH
            elif c in spaces:
                to = AFTER_SPACE if c == SPACE else AFTER_OTHER
            elif c in letters:
                to = IN_LETTERS
                if s == AFTER_QUOTE and c in (STMD, RV, ELL):
                    to = {STMD: FRESH, RV: QUOTE_RV, ELL: QUOTE_L}[c]
                elif (s, c) in ((QUOTE_RV, EE), (QUOTE_L, ELL)):
                    to = FRESH
            elif c == NUMBER:
                to = IN_NUMBERS
            elif c == QUOTE and s not in (AFTER_SPACE, IN_MARKS, AFTER_QUOTE):
                to = AFTER_QUOTE
            else:
                to = IN_MARKS
            step[s, c] = to
            for ahead in range(CLASSES):
                if c in spaces and s in (AFTER_SPACE, AFTER_OTHER):
                    b = ahead not in (SPACE, OTHER_SPACE, END)  # the last of several spaces stands apart from the others
                elif c in letters and s == AFTER_QUOTE:
                    b = not (c == STMD or (c == RV and ahead == EE) or (c == ELL and ahead == ELL))
                elif c in letters:
                    b = s not in (IN_LETTERS, AFTER_SPACE, QUOTE_RV, QUOTE_L)
                elif c == NUMBER:
                    b = s not in (IN_NUMBERS, AFTER_SPACE)
                elif c in (QUOTE, MARK):
                    b = s not in (IN_MARKS, AFTER_SPACE, AFTER_QUOTE)
                else:
                    b = True
                begins[s, c, ahead] = b
    return step, begins


def compile_classes(pre_tokenizer) -> np.ndarray:
    """The class of every code point. Where Unicode versions differ, the library is asked."""
    import sys
    import unicodedata

    import regex

    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    place = np.array(points)
    out = np.full(sys.maxunicode + 2, MARK, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", OTHER_SPACE)):
        for m in regex.finditer(pattern, every):
            out[place[m.start() : m.end()]] = kind
    if pre_tokenizer is not None:
        for c in points:
            kind = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], MARK)
            if out[c] != OTHER_SPACE and out[c] != kind:
                joins = [len(pre_tokenizer.pre_tokenize_str(x + chr(c))) == 1 for x in "a1"]
                out[c] = LETTER if joins[0] else NUMBER if joins[1] else MARK
    for chars, kind in ((" ", SPACE), ("stmd", STMD), ("rv", RV), ("l", ELL), ("e", EE), ("'", QUOTE)):
        for ch in chars:
            out[ord(ch)] = kind
    out[-1] = END
    return out


def run_states(step: np.ndarray, classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The state before each character, from FRESH on: chunk state maps, composed by a prefix scan."""
    n = len(classes)
    k = max(1, -(-n // chunk))
    padded = np.zeros(k * chunk, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(k, chunk).T)
    flat = step.ravel()
    offset = np.arange(STATES, dtype=np.int16)[None, :]
    maps = np.repeat(offset, k, 0)
    for c in columns:
        maps = flat[maps * CLASSES + c[:, None]].astype(np.int16)
    reach = 1
    while reach < k:  # maps[i] becomes the composition of the maps up to i
        later = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), 1)
        maps = np.concatenate([maps[:reach], later])
        reach *= 2
    state = np.full(k, FRESH, np.int16)
    state[1:] = maps[:-1, FRESH]
    before = np.empty((chunk, k), np.uint8)
    for j, c in enumerate(columns):
        before[j] = state
        state = flat[state * CLASSES + c].astype(np.int16)
    return before.T.reshape(-1)[:n]


class Counter:
    """Counts the tokens of byte strings by a transducer whose states are made when they are reached."""

    ROOT = 0

    def __init__(self, tokens: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int]):
        self._ranks = ranks
        self._child: dict[tuple[int, int], int] = {}
        self._token: list[bytes | None] = [None]
        parents = set()
        for t in tokens:
            node = self.ROOT
            for b in t:
                to = self._child.get((node, b))
                if to is None:
                    parents.add(node)
                    to = self._child[node, b] = len(self._token)
                    self._token.append(None)
                node = to
            self._token[node] = t
        self._leaf = [n not in parents for n in range(len(self._token))]
        self._reset()

    def _reset(self) -> None:
        self._follows: dict[tuple[bytes, bytes], bool] = {}
        self._column = np.full(256, -1, np.int32)
        self._columns = 0
        first = ((b"", self.ROOT, 0),)
        self._number = {first: 0}
        self._states = [first]
        self._table = np.full((1024, 32), -1, np.int32)

    def merge(self, data: bytes) -> list[bytes]:
        """BPE by its definition: join the pair of the lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(((self._ranks.get((x, y), 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False))))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, before: bytes, token: bytes) -> bool:
        key = (before, token)
        got = self._follows.get(key)
        if got is None:
            got = self._follows[key] = self.merge(before + token) == ([before, token] if before else [token])
        return got

    def _make(self, state: int, byte: int) -> int:
        """A new table entry: the state after `byte`, and the change of the count."""
        new, done = [], None
        for before, node, count in self._states[state]:
            to = self._child.get((node, byte))
            if to is None:
                continue
            token = self._token[to]
            if done is None and token is not None and self._may_follow(before, token):
                done = (token, count + 1)
            if not self._leaf[to]:
                new.append((before, to, count))
        token, change = done
        key = (*((before, node, count - change) for before, node, count in new), (token, self.ROOT, 0))
        number = self._number.get(key)
        if number is None:
            number = self._number[key] = len(self._states)
            self._states.append(key)
            if number >= len(self._table):
                more = max(1024, len(self._table) // 4)
                self._table = np.concatenate([self._table, np.full((more, self._table.shape[1]), -1, np.int32)])
        if not -SHIFTED < change < SHIFTED:
            raise ValueError(f"a token of more than {SHIFTED} parts")
        return number << BITS | (change + SHIFTED)

    def _columns_for(self, data: np.ndarray) -> None:
        for b in np.flatnonzero(np.bincount(data, minlength=256)):
            if self._column[b] < 0:
                self._column[b] = self._columns
                self._columns += 1
                if self._columns > self._table.shape[1]:
                    self._table = np.concatenate([self._table, np.full((len(self._table), 16), -1, np.int32)], 1)

    def count(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each data[start : start + length]; all are read in step."""
        if len(self._states) > MOST_STATES:
            self._reset()
        self._columns_for(data)
        order = np.argsort(-length, kind="stable")
        start, longest = start[order], length[order]
        alive = np.searchsorted(-longest, -np.arange(longest[0] if len(longest) else 0), "left")
        state = np.zeros(len(start), np.int64)
        total = np.zeros(len(start), np.int64)
        mask = (1 << BITS) - 1
        for j, n in enumerate(alive):
            if n < 8:
                break
            byte = data[start[:n] + j]
            entry = self._table[state[:n], self._column[byte]]
            lacks = np.flatnonzero(entry < 0)
            if len(lacks):
                pairs = np.unique(state[lacks] << 8 | byte[lacks])
                for pair in pairs.tolist():
                    made = self._make(pair >> 8, pair & 255)
                    self._table[pair >> 8, self._column[pair & 255]] = made
                entry = self._table[state[:n], self._column[byte]]
            total[:n] += (entry & mask) - SHIFTED
            state[:n] = entry >> BITS
        else:
            j = len(alive)
        for i in range(int(alive[j]) if j < len(alive) else 0):  # a few long ones, each alone
            at, sum_ = int(state[i]), int(total[i])
            for byte in data[start[i] + j : start[i] + longest[i]].tolist():
                column = self._column[byte]
                entry = int(self._table[at, column])
                if entry < 0:
                    entry = self._table[at, column] = self._make(at, byte)
                sum_ += (entry & mask) - SHIFTED
                at = entry >> BITS
            total[i] = sum_
        out = np.empty(len(start), np.int64)
        out[order] = total
        return out


class Transducer:
    """Counts the tokens of whole texts."""

    def __init__(self, classes: np.ndarray, tokens: dict[bytes, int], ranks: dict, special: list[str]):
        self._classes = classes
        self._step, self._begins = compile_cutter()
        self._counter = Counter(tokens, ranks)
        self._special = sorted(special, key=len, reverse=True)

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for part in common.portions(texts, PORTION):
            out += self._portion(part)
        return out

    def _portion(self, texts: list[str]) -> list[int]:
        owner, pieces = [], []
        total = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = [text]
            for s in self._special:
                if s in text:
                    found = [y for x in found for y in x.split(s)]
            total[i] = len(found) - 1
            pieces += found
            owner += [i] * len(found)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        joined = "\0".join(pieces) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self._classes[points]
        ends = np.cumsum(size + 1) - 1
        classes[ends] = END
        before = run_states(self._step, classes)
        ahead = np.empty_like(classes)
        ahead[:-1], ahead[-1] = classes[1:], END
        begins = self._begins[before, classes, ahead]
        begins[ends] = True
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.cumsum(width) - width
        chars = np.flatnonzero(begins)
        where = at[chars]
        length = np.diff(where, append=at[-1] + 1)
        real = classes[chars] != END
        # a pre-token ends where the next one, or the end of its text, begins
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        got = self._counter.count(data, where[real], length[real])
        piece = np.searchsorted(ends, chars[real], "left")
        np.add.at(total, np.asarray(owner)[piece], got)
        return total.tolist()


def compile_tokenizer(tokenizer_json: bytes) -> dict:
    """What workers need of a byte-level BPE tokenizer file; raises ValueError for other kinds of tokenizers."""
    from tokenizers import Tokenizer

    spec = json.loads(tokenizer_json)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not model.get("byte_fallback") and not model.get("ignore_merges") and not model.get("dropout")
    plain &= pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["normalizer"] is None
    added = spec["added_tokens"]
    plain &= not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
    if not plain:
        raise ValueError("not a byte-level BPE tokenizer of the kind that can be compiled")
    library = Tokenizer.from_str(tokenizer_json.decode())
    return {
        "classes": zlib.compress(compile_classes(library.pre_tokenizer).tobytes(), 1),
        "vocab": list(model["vocab"]),
        "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
        "special": [t["content"] for t in added],
    }


def transducer(compiled: dict) -> Transducer:
    from .byte_bpe import printable_bytes

    byte = {c: b for b, c in enumerate(printable_bytes())}
    raw = lambda piece: bytes(byte[c] for c in piece)
    tokens = {raw(p): i for i, p in enumerate(compiled["vocab"]) if all(c in byte for c in p)}
    ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(compiled["merges"])}
    classes = np.frombuffer(zlib.decompress(compiled["classes"]), np.uint8)
    return Transducer(classes, tokens, ranks, compiled["special"])


_MADE: dict[int, Transducer] = {}


def count_tokens(df: DataFrame, tokenizer_json: bytes, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """`df` with a long column `out`: the tokens of the whole text, special strings in it counted as one each.

    A null or empty text has none. Repeated rows stay; an empty table gives an empty table; a column already named
    `out` is an error. Nothing is shuffled, and a very long text is read in chunks whose state maps are composed.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table already has a column {out}")
    shared = df.sparkSession.sparkContext.broadcast(compile_tokenizer(tokenizer_json))
    key = zlib.crc32(tokenizer_json)

    def make():
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = transducer(shared.value)
        machine = _MADE[key]
        return lambda texts: [pa.array(machine.counts([t or "" for t in texts.to_pylist()]), pa.int64())]

    return common.map_arrow(df, [common.quoted(text).cast("string")], [(out, T.LongType())], make, df.columns)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, tokens and whether the tokens are more than 512, of every document."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        tokenizer_json = f.read()
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_json).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"),
    )


QUERIES = {"op5_token_counts": op5_token_counts}
