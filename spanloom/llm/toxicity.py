"""Toxicity by weak supervision.

1. Voters. Fixed lexicons and patterns (insults, address, threats, shouting, marks, masked words), and
   lexicons mined from the labelled training rows: words and word beginnings that toxic rows hold far more often than
   clean ones, dealt by hash into many lexicons, each a voter of its own. A word's support counts different words in
   front of it, so one text's copies don't make their words a lexicon.
2. Label model. The voters' joint votes are explained by a hidden class: accuracies of each voter and correlations of
   pairs (a tree over the voters, by their conditional mutual information) are estimated by expectation-maximisation;
   a given label enters as one more voter, its accuracy estimated too (and drawn towards `trust`). It gives each
   training row a posterior label.
3. A linear classifier over lexicon hits and votes is trained on those posteriors and scores every text.

Training takes at most `max_rows` labelled rows (smallest hashes of their ids over all labelled rows outside the held
out fold), whole texts of them. Lexicons, label model and classifier are bounded by that alone; everything else reads
every row and whole texts.

Defined results: null and empty texts are scored like any other, from the classifier's intercept; a doc_id with
several labels counts as toxic if one says so; without toxic or without clean training rows only the fixed voters
score; repeated rows give repeated rows; other columns are not read by a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import fold, map_texts, materialize, released

FOLDS, HELD_OUT = 3, 1
CUT = 0.7
WORDS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)
#: Plain English insults, a starting lexicon.
INSULTS = frozenset("bastard clown crap creep disgusting dumb dumbass fool freak garbage hate idiot idiotic imbecile jerk loser moron moronic pathetic pig scum shit slut stupid trash ugly vermin worthless".split())
# End of fixed values.
ADDRESS = re.compile(r"\b(?:you|your|ur|u)\b(?:\W+\w+){0,3}?\W+(?:" + "|".join(sorted(INSULTS)) + r")\b")
THREAT = re.compile(r"\b(?:kill|hurt|beat|destroy|shut)\W+(?:you|yourself|up|them|him|her)\b")
MARKS = re.compile(r"[!?]{3}")
MASKED = re.compile(r"[*#@$]{2,}[^\W\d_]")
FIXED, WORD_LISTS, START_LISTS = 7, 12, 6
VOTERS = FIXED + WORD_LISTS + START_LISTS + 4


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)
    starts: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None

    @cached_property
    def heads(self) -> frozenset[str]:
        return frozenset(s[: BEGINNINGS[0]] for s in self.starts)

    def hits(self, text: str) -> tuple[list[str], list[str], list[int]]:
        """Lexicon words, words with lexicon beginnings, votes."""
        low = text.lower()
        distinct = set(WORDS.findall(low))
        words = [w for w in distinct if w in self.words] if len(distinct) < len(self.words) else [w for w in self.words if w in distinct]
        heads, least = self.heads, BEGINNINGS[0]
        starts = [w for w in distinct if w[:least] in heads and any(w[:k] in self.starts for k in BEGINNINGS if len(w) > k)] if heads else []
        fixed = distinct & INSULTS
        spoken = text.split() if len(text) > 20 else []
        in_words = {self.words[w] % WORD_LISTS for w in words}
        in_starts = {self.starts[w[:k]] % START_LISTS for w in starts for k in BEGINNINGS if len(w) > k and w[:k] in self.starts}
        votes = [
            len(fixed) >= 1, len(fixed) >= 2, bool(fixed) and bool(ADDRESS.search(low)), "you" in low and bool(THREAT.search(low)),
            2 * sum(map(str.isupper, spoken)) > len(spoken), bool(MARKS.search(text)), bool(MASKED.search(text)),
            *(i in in_words for i in range(WORD_LISTS)), *(i in in_starts for i in range(START_LISTS)),
            len(words) >= 1, len(words) >= 2, len(starts) >= 1, len(starts) >= 2,
        ]
        return words, starts, list(map(int, votes))

    def features(self, text: str) -> tuple[list[int], list[float]]:
        words, starts, votes = self.hits(text)
        first = 1 + VOTERS + 3
        at, value = [0], [1.0]
        for i, v in enumerate(votes):
            if v:
                at.append(1 + i)
                value.append(1.0)
        for i, n in enumerate((len(words), len(starts), len({*words, *starts}))):
            if n:
                at.append(1 + VOTERS + i)
                value.append(math.log1p(n))
        own = [self.words[w] for w in words]
        own += {len(self.words) + self.starts[w[:k]] for w in starts for k in BEGINNINGS if w[:k] in self.starts and len(w) > k}
        return at + [first + i for i in own], value + [1.0] * len(own)

    @property
    def size(self) -> int:
        return 1 + VOTERS + 3 + len(self.words) + len(self.starts)

    def score(self, text: str) -> float:
        at, value = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weights[at] @ value)))))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text, toxic of the training rows. The labels' side is bounded by max_rows, so it is broadcast."""
    own = labels.select(F.col("doc_id").cast("long").alias("id"), "toxic").where("toxic is not null and id is not null")
    own = own.where(fold(F.col("id"), FOLDS) != HELD_OUT).groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), F.col("doc_id") == F.col("id"))
    return materialize(rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic"), "toxicity-sample")


def _mine(rows: DataFrame) -> DataFrame:
    """token, toxic, n (rows), m1 and m2 (which words were in front of it, as bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        masks: dict = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                words = WORDS.findall(text.lower())
                seen: dict[str, int] = {}
                for before, w in zip(["", *words], words):
                    bit = 1 << (zlib.crc32(before.encode("utf-8", "surrogatepass")) % 62)
                    seen["w" + w] = seen.get("w" + w, 0) | bit
                    for k in BEGINNINGS:
                        if len(w) > k:
                            p = f"{k}{w[:k]}"
                            seen[p] = seen.get(p, 0) | bit
                n.update(seen.keys())
                for t, m in seen.items():
                    masks[t] = masks.get(t, 0) | m
        masks_ = pa.array([masks[t] for t in n], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), masks_], ["token", "n", "mask"])

    return rows.select("text").mapInArrow(released(run), "token string, n long, mask long").groupBy("token").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("mask")).alias("fronts"))


def _count(rows: DataFrame, tokens: frozenset[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                distinct = set(WORDS.findall(text.lower()))
                n.update(tokens & ({"w" + w for w in distinct} | {f"{k}{w[:k]}" for w in distinct for k in BEGINNINGS if len(w) > k}))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["token", "n"])

    return rows.select("text").mapInArrow(released(run), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def lexicons(rows: DataFrame, positive: int, negative: int) -> tuple[dict[str, int], dict[str, int]]:
    """Words and beginnings of toxic rows with enough evidence, numbered by it; thresholds alone decide."""
    rate = positive / (positive + negative)
    found = _mine(rows.where("toxic = 1")).where(f"n >= {2 if positive < 100 else 3} and fronts >= 2")
    cand = {r["token"]: min(r["n"], r["fronts"]) if r["fronts"] < 40 else r["n"] for r in found.collect()}  # bounded by the sample
    clean = {r["token"]: r["n"] for r in _count(rows.where("toxic = 0"), frozenset(cand)).collect()}
    need = math.log(max(200, 5 * len(cand)) / 4) / math.log(1 / max(rate, 1e-3))  # chance finds: a few in all
    best = {}
    for t, p in cand.items():
        odds = math.log((p + 0.5) / (positive + 1)) - math.log((clean.get(t, 0) + 0.5) / (negative + 1))
        if p >= need and odds > math.log(25) and clean.get(t, 0) <= 0.05 * p + (p > 60):
            best[t] = p * odds
    ranked = sorted(best, key=lambda t: (-best[t], t))
    words, starts = [t[1:] for t in ranked if t[0] == "w"], [t[1:] for t in ranked if t[0] != "w"]
    return {w: i for i, w in enumerate(words)}, {s: i for i, s in enumerate(starts)}


def label_model(votes: np.ndarray, given: np.ndarray, trust: float = 0.97, rounds: int = 40) -> np.ndarray:
    """Posterior of class 1 for each row. votes: [rows, voters] of 0/1; given: the label, a voter as well: its accuracy in
    each class is halfway between `trust` and what the class's rows say."""
    patterns, back, n = np.unique(np.column_stack([votes, given]), axis=0, return_inverse=True, return_counts=True)
    v, g = patterns[:, :-1], patterns[:, -1]
    post = np.where(g == 1, trust, 1 - trust)
    parent = [-1] * v.shape[1]
    for r in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        if r in (1, 10):
            parent = _tree(v, weight)
        prior = (weight.sum(1) + 1) / (n.sum() + 2)
        agrees = g[None] == np.array([[0], [1]])
        right = np.clip(((weight * agrees).sum(1) / np.maximum(weight.sum(1), 1e-9) + trust) / 2, 0.5, 0.999)[:, None]
        log = np.log(prior)[:, None] + np.log(np.where(agrees, right, 1 - right))
        for j in range(v.shape[1]):
            for c in (0, 1):
                for up in (0, 1) if parent[j] >= 0 else (None,):
                    own = np.ones(len(v), bool) if up is None else v[:, parent[j]] == up
                    p = (weight[c][own] @ v[own, j] + 0.5) / (weight[c][own].sum() + 1)
                    log[c][own] += np.log(np.where(v[own, j] == 1, p, 1 - p))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done and r > 10:
            break
    return post[np.ravel(back)]


def _tree(v: np.ndarray, weight: np.ndarray) -> list[int]:
    """Each voter's parent: a maximum spanning tree of conditional mutual information."""
    k = v.shape[1]
    info = np.zeros((k, k))
    for w in weight:
        total = w.sum() + 4
        for a in range(k):
            for b in range(a):
                for x in (0, 1):
                    for y in (0, 1):
                        both = (w[(v[:, a] == x) & (v[:, b] == y)].sum() + 1) / total
                        pa, pb = (w[v[:, a] == x].sum() + 2) / total, (w[v[:, b] == y].sum() + 2) / total
                        info[a, b] += total * both * math.log(both / (pa * pb))
    info += info.T
    parent, reached = [-1] * k, {0}
    while len(reached) < k:
        _, b, a = max((info[b, a], b, a) for a in reached for b in range(k) if b not in reached)
        parent[b] = a
        reached.add(b)
    return parent


def train_linear(size: int, rows: list[tuple[list[int], list[float]]], target: np.ndarray, l2: float = 0.3, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft targets: rows as sparse (indices, values)."""
    at = np.concatenate([np.asarray(i) for i, _ in rows])
    value = np.concatenate([np.asarray(x) for _, x in rows])
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    w, m, s = np.zeros(size), np.zeros(size), np.zeros(size)
    w[0] = -2
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[at], len(rows))
        g = np.bincount(at, value * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)[row], size) + l2 * w * (np.arange(size) > 0)
        g /= len(rows)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return w


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    rows = sample(docs, labels, max_rows)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    model = Model()
    if not n.get(1) or not n.get(0):
        model.weights = np.zeros(model.size)
        model.weights[:4] = -3, 3, 2, 1
        return model
    model.words, model.starts = lexicons(rows, n[1], n[0])

    def run(texts: list[str]) -> list[list]:
        return list(zip(*((*model.features(t), model.hits(t)[2]) for t in texts)))

    # sparse: a few numbers for each of max_rows rows at most
    seen = map_texts(rows.select("toxic", "text"), run, "at array<int>, value array<double>, votes array<int>")
    got = sorted((r["at"], r["value"], r["votes"], r["toxic"]) for r in seen.collect())
    post = label_model(np.array([g[2] for g in got]), np.array([g[3] for g in got]))
    model.weights = train_linear(model.size, [(g[0], g[1]) for g in got], post)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted; no shuffle."""

    def run(texts: list[str]) -> list[list]:
        s = [model.score(t) for t in texts]
        return [s, [int(x >= CUT) for x in s]]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return map_texts(rows, run, "score double, predicted int")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't predicted toxic, as they are; no shuffle. Only the text goes to Python."""

    def stays(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py() or "") < CUT for t in texts], pa.bool_())

    return docs.where(F.arrow_udf(stays, "boolean")(docs["text"]))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))
