"""Language identification by cross-parsing entropy.

For each language, a bounded sample of labelled text becomes a suffix automaton. A text, its letters in lower case and
one blank for whatever is between, is parsed against each automaton from beginning to end: the automaton's state
follows the longest match, and where it ends a new phrase begins, across blanks as well. Phrases times log2(length of
the sample) over the text's characters is the cross entropy, and the language with the lowest wins. The states of many
texts and all languages move on together, a character at a time; a long text is parsed as stretches of `STRETCH`
characters, each of which begins a phrase.

Training: rows with a language whose fold is not held out. Of each language at most `rows` rows are taken, the first
by hash over all its rows, whole texts, as long as they fit into `chars` characters together; if none does, the
shortest one. What is broadcast (a count for each language, and these samples) and the automata grow with the number
of languages alone.

Defined results: null texts and texts without a letter (Unicode category L) are `und` with score 0, as is every text
if nothing could be learned; with one language its score is 1; ties go to the first language by name; texts and words
of any length are parsed whole; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from math import log2

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import fold, map_texts

FOLDS, HELD_OUT = 4, 2
STRETCH = 4096
#: Every letter is one of Unicode's category L, as str.isalpha() has it.
BLANK, STRANGE = 0, 1


@lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """For each code point, STRANGE if it is a letter, else BLANK."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.int32, 0x110000)


def coded(text: str, codes: np.ndarray) -> np.ndarray:
    """The codes of the text's letters in lower case, a BLANK before, between and behind words; empty without a letter."""
    c = codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    if not c.any():
        return c[:0]
    c = np.concatenate([[BLANK], c, [BLANK]])
    return c[(c != BLANK) | np.concatenate([[True], c[:-1] != BLANK])]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Moves of the automaton of all substrings: per state, the next one by symbol. State 0 is the start."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(move)
        move.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(move)
                move.append(dict(move[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return move


class Moves:
    """The moves of several automata in one open-addressed table. State 0 has none: a text begins there, and a
    character that no sample has leads there."""

    def __init__(self, automata: list[list[dict[int, int]]], symbols: int):
        self.symbols = symbols
        self.first = np.zeros((len(automata), symbols), np.int32)  # where a phrase begins, by language and symbol
        keys, to, at = [], [], 1
        for n, move in enumerate(automata):
            for state, own in enumerate(move):
                keys += [(at + state) * symbols + c for c in own]
                to += [at + q for q in own.values()]
            for c, q in move[0].items():
                self.first[n, c] = at + q
            at += len(move)
        self.bits = max(4, 2 + len(keys).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        key, value = np.array(keys, np.int64), np.array(to, np.int32)
        slot = self._slot(key)
        while len(key):  # of those that want one free place, the first gets it
            free = np.flatnonzero(self.keys[slot] < 0)
            own = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[own]], self.to[slot[own]] = key[own], value[own]
            left = np.ones(len(key), bool)
            left[own] = False
            key, value, slot = key[left], value[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def phrases(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """[language, stretch]: how many longest matches, one after the other, make up each stretch of the coded text."""
        order = np.argsort(-sizes, kind="stable")
        at, falling = starts[order], -sizes[order]
        langs = len(self.first)
        n = np.zeros(len(sizes) * langs, np.int32)
        state = np.zeros(len(sizes) * langs, np.int32)
        first, place = self.first.T.ravel(), np.arange(langs)
        for t in range(int(sizes.max(initial=0))):
            on = int(np.searchsorted(falling, -t))  # the stretches that are longer than t
            c = text.take(at[:on] + t)
            key = np.multiply(state[: on * langs], self.symbols, dtype=np.int64)
            key += c.repeat(langs)
            slot = self._slot(key)
            held = self.keys.take(slot)
            other = np.flatnonzero(held != key)
            miss = [other[held.take(other) < 0]]
            other = other[held.take(other) >= 0]
            while len(other):
                now = slot[other] = (slot[other] + 1) & (len(self.keys) - 1)
                now = self.keys.take(now)
                miss.append(other[now < 0])
                other = other[(now >= 0) & (now != key.take(other))]
            missed = np.concatenate(miss)
            self.to.take(slot, out=state[: on * langs])
            n[missed] += 1
            state[missed] = first.take(c.take(missed // langs) * langs + place.take(missed % langs))
        out = np.empty((len(sizes), langs), np.int32)
        out[order] = n.reshape(len(sizes), langs)
        return out.T


class Model:
    def __init__(self, samples: dict[str, str]):
        """samples: per language, a text."""
        self.langs = sorted(samples)
        self.codes = alphabet().copy()
        known = sorted({ord(c) for s in samples.values() for c in s.lower() if c.isalpha()})
        self.codes[known] = np.arange(2, len(known) + 2)
        texts = [coded(samples[k], self.codes) for k in self.langs]
        self.bits = np.array([log2(len(t) + 2) for t in texts])
        self.moves = Moves([suffix_automaton(t.tolist()) for t in texts], len(known) + 2)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        parts = [coded(t, self.codes) for t in texts]
        sizes = np.array(list(map(len, parts)), np.int64)
        if not self.langs or not sizes.any():
            return [("und", 0.0)] * len(texts)
        many = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), many)
        within = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * STRETCH
        begins = np.repeat(np.cumsum(sizes) - sizes, many) + within
        n = self.moves.phrases(np.concatenate(parts), begins, np.minimum(STRETCH, sizes[owner] - within))
        cost = np.stack([np.bincount(owner, row, len(texts)) * bits for row, bits in zip(n, self.bits)], 1)
        best = cost.argmin(1)
        least = cost.min(1)
        cost[np.arange(len(texts)), best] = np.inf
        rest = cost.min(1)
        return [(self.langs[b], 1.0 if r == np.inf else r / (r + v)) if size else ("und", 0.0) for b, r, v, size in zip(best.tolist(), rest.tolist(), least.tolist(), sizes)]


@lru_cache(maxsize=1)
def model(samples: tuple[tuple[str, str], ...]) -> Model:
    """A worker builds the automata once."""
    return Model(dict(samples))


def learn(docs: DataFrame, rows: int = 150, chars: int = 20_000) -> dict[str, str]:
    """Per language, its sample."""
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    train = train.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("text").rlike(r"\p{L}"))
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "lang"), 1)
    share = train.groupBy("lang").count().select("lang", (F.lit(3.0 * rows) / F.col("count")).alias("share"))
    picked = train.join(F.broadcast(share), "lang").where(h <= F.least(F.col("share"), F.lit(1.0)) * F.lit(float(2**63)))
    size = F.length("text")
    order = Window.partitionBy("lang").orderBy(size > chars, F.when(size > chars, size), h, "doc_id", "text")
    first = picked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows)  # cut before the shuffle
    texts: dict[str, dict[str, None]] = {}
    first = first.where((size <= chars) | (F.col("r") == 1))
    for r in first.select("lang", "text", "r").orderBy("lang", "r").collect():
        own = texts.setdefault(r["lang"], {})
        if not own or sum(map(len, own)) + len(r["text"]) <= chars:
            own[r["text"]] = None
    return {lang: "\n".join(own) for lang, own in texts.items()}


def predict(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, held_out, lang_pred, score; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(samples.items())))

    def run(texts: list[str]) -> list[list]:
        return list(zip(*model(shared.value).predict(texts)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return map_texts(rows, run, "lang_pred string, score double", at_once=1024)


def query(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))
