"""N-gram Jaccard self-join with PartEnum signatures.

Sets. A document's set is its distinct shingles of five words, as 64-bit hashes in order. Equal sets are collapsed to
one representative (128 bits of the set), so exact copies cost one signature set.

Signatures. J >= 3/4 bounds the symmetric difference of sets of a and b elements by (a + b) / 7. The sizes are cut
into bands [2^j, 2^(j+1)); a pair is the business of its larger set's band, so a set signs for its own band and, if a
partner can be in the next one, for that. A band divides the domain of the hashes into n cells, n above the band's
largest difference k: at least n - k cells of a similar pair agree. A signature is the content of a subset of cells:
of two cells in the small bands, of one cell in the others, and at least C(n - k, m) signatures are shared.

Large buckets. n leaves slack, so a set whose large ("hot", above `cap` members) and empty signatures are fewer than
C(n - k, m) has each of its partners in a small bucket as well: there hot buckets can be left alone without losing a
link, and a pair with fewer common signatures than that bound cannot be similar. Sets with too many hot signatures
(families of near copies, texts that are mostly a common passage) are the exact rest, joined among themselves by their
rarest shingles: each bucket compares its members with a few leaders, what is linked is contracted, and buckets that
still hold several components go on with four times the leaders, until none is left. No step makes all pairs of a
bucket of near copies.

Every candidate is verified on the sets. Defined results: null and empty texts have the empty set and no links; texts
of fewer than five words are one shingle; rows sharing a doc_id are one node; a null doc_id is a component of its
own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import discard, map_texts, materialize, partitions, released
from spanloom.llm.components import components, merged

N = 5
CAP = 8  # members of a bucket whose pairs are all candidates
SLACK = 1.25
SMALL = 16  # below this size, signatures are of two cells
WORDS = [f"w{i}" for i in range(16)]  # columns of a set's parity map, 64 bits each

_R = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(5).integers(1, 2**64, 256, np.uint64) | np.uint64(1)
_PLACES = np.random.default_rng(6).integers(1, 2**64, N, np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        back = np.uint64(pow(int(_R), -1, 2**64))
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)])) for b in (_R, back)]
    return _POWERS[0], _POWERS[1]


def shingles(text: str | None) -> np.ndarray:
    """Distinct shingles' hashes, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    up, down = _powers(len(data) + 1)
    sums = np.cumsum(_TABLE[data] * up[: len(data)])
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    word = mix((sums[ends] - np.where(starts > 0, sums[starts - 1], np.uint64(0))) * down[starts])
    if len(word) < N:
        return mix(np.array([(word * _PLACES[: len(word)]).sum(dtype=np.uint64) + np.uint64(len(word))]))
    n = len(word) - N + 1
    total = word[:n] * _PLACES[0]
    for i in range(1, N):
        total = total + word[i : i + n] * _PLACES[i]
    return np.unique(mix(total))


def set_key(s: np.ndarray) -> tuple[int, int]:
    a = mix(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7))) if len(s) else np.uint64(0)
    return int(a.view(np.int64)), int(np.uint64(b).view(np.int64))


def bands(size: int) -> list[int]:
    """The bands that a set signs for."""
    if not size:
        return []
    own = size.bit_length() - 1
    return [own] + [own + 1] * (4 * size // 3 >= 1 << (own + 1))


def layout(band: int) -> tuple[int, int]:
    """Cells of a band, and cells of a signature."""
    k = 2 * ((2 << band) - 1) // 7
    return (k + 3, 2) if (1 << band) < SMALL and k else (int(SLACK * k) + 1, 1)


def shared_least(size: int, band: int) -> int:
    """Signatures that a set of this size shares at least with any similar set, in this band."""
    cells, m = layout(band)
    largest = min(4 * size // 3, (2 << band) - 1)
    return comb(cells - (size + largest) // 7, m)


def signatures(s: np.ndarray, band: int) -> tuple[np.ndarray, int]:
    """Signatures (63 bits and the band's parity) and the number of subsets of empty cells."""
    cells, m = layout(band)
    cell = ((s >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)  # ascending, as s is
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    held = cell[first].astype(np.int64)
    content = np.add.reduceat(mix(s ^ np.uint64(0xA5A5A5A5 + band)), first)
    if m == 1:
        sig, empty = mix(content + cell[first] * _R), cells - len(first)
    else:
        full = np.zeros(cells, np.uint64)
        full[held] = content
        i, j = np.triu_indices(cells, 1)
        some = (full[i] != 0) | (full[j] != 0)
        i, j, empty = i[some], j[some], int((~some).sum())
        sig = mix(mix(full[i] + (i + 1).astype(np.uint64) * _R) * np.uint64(3) + full[j] + (j + 1).astype(np.uint64) * _R)
    return (sig & ~np.uint64(1)) | np.uint64(band & 1), empty


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, k1, k2 (name of the set), e0, e1 (empty subsets in its bands)."""

    def run(texts: list[str]) -> list[list]:
        rows = []
        for t in texts:
            s = shingles(t)
            e = [signatures(s, band)[1] for band in bands(len(s))]
            rows.append((len(s), *set_key(s), *(e + [0, 0])[:2]))
        return list(zip(*rows))

    return map_texts(docs.select("doc_id", "text"), run, "n long, k1 long, k2 long, e0 int, e1 int")


def signed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """sig, id of every signature; of every shingle, if whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, ids, held = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(t)
                for x in [s] if whole else [signatures(s, band)[0] for band in bands(len(s))]:
                    sigs.append(x)
                    ids.append(np.full(len(x), i, np.int64))
                    held += len(x)
                if held > 200_000:
                    yield _batch(sigs, ids)
                    sigs, ids, held = [], [], 0
            if held:
                yield _batch(sigs, ids)

    return docs.select("doc_id", "text").mapInArrow(released(run), "sig long, id long")


def _batch(sigs: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(ids))], ["sig", "id"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by signature, in order -> (a, b, parity) for pairs of small buckets, (a, null, parity) for members of hot ones.

    Runs are read across batches; of a hot one no more than CAP + 1 members are held.
    """

    def out(a: list, b: list, p: list) -> Iterator[pa.RecordBatch]:
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.concat_arrays(b), pa.array(np.concatenate(p).astype(np.int32))], ["a", "b", "parity"])

    sig, ids, hot = np.empty(0, np.int64), np.empty(0, np.int64), None
    done = False
    while not done:
        batch = next(batches, None)
        done = batch is None
        if not done:
            sig = np.concatenate([sig, batch.column(0).to_numpy()])
            ids = np.concatenate([ids, batch.column(1).to_numpy()])
        a, b, p = [], [], []

        def lone(x: np.ndarray, s: np.ndarray) -> None:
            a.append(x)  # noqa: B023
            b.append(pa.nulls(len(x), pa.int64()))  # noqa: B023
            p.append(s & 1)  # noqa: B023

        if hot is not None and len(sig):
            more = int(np.searchsorted(sig != hot, True)) if (sig != hot).any() else len(sig)
            if more:
                lone(ids[:more], sig[:more])
                sig, ids = sig[more:], ids[more:]
            if len(sig):
                hot = None
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(sig)))
        if len(first) and not done:  # the last run may go on
            if size[-1] <= CAP:
                rest = int(first[-1])
                first, size = first[:-1], size[:-1]
            else:
                rest, hot = len(sig), sig[-1]
        else:
            rest = len(sig)
        for n in range(2, CAP + 1):
            at = first[size == n]
            if len(at):
                i, j = np.triu_indices(n, 1)
                x, y = ids[at[:, None] + i].ravel(), ids[at[:, None] + j].ravel()
                a.append(np.minimum(x, y))
                b.append(pa.array(np.maximum(x, y)))
                p.append(np.repeat(sig[at] & 1, len(i)))
        big = np.flatnonzero(size > CAP)
        if len(big):
            rows = np.concatenate([np.arange(first[i], first[i] + size[i]) for i in big])
            lone(ids[rows], sig[rows])
        sig, ids = sig[rest:], ids[rest:]
        yield from out(a, b, p)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= 75 * union. docs: doc_id and text, or the set's hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for rows in batches:
            keep = []
            for a, x, y in zip(rows["a"], rows["x"], rows["y"]):
                if a not in held:
                    held = {a: shingles(x) if texts else np.frombuffer(x, np.uint64)}
                s, t = held[a], shingles(y) if texts else np.frombuffer(y, np.uint64)
                both = int((s[np.searchsorted(s[:-1], t)] == t).sum())
                keep.append(100 * both >= 75 * (len(s) + len(t) - both))
            yield rows.loc[keep, ["a", "b"]]

    texts = "text" in docs.columns
    own = docs.select("doc_id", "text" if texts else "set")
    rows = pairs.join(own.toDF("b", "y"), "b").join(own.toDF("a", "x"), "a")
    return rows.select("a", "b", "x", "y").mapInPandas(released(run), "a long, b long")


def links(docs: DataFrame, base: DataFrame) -> DataFrame:
    """node, component of all representatives with links. docs: doc_id, text of the representatives; base: their sets()."""
    found = signed(docs, False).repartition(partitions(docs.sparkSession), "sig").sortWithinPartitions("sig").mapInArrow(released(_buckets), "a long, b long, parity int")
    found = materialize(found.groupBy("a", "b", "parity").agg(F.count("*").alias("n")), "ngram-buckets")
    need = _need(base, found.where("b is null").select(F.col("a").alias("id"), "parity", F.col("n").alias("hot")))
    need = materialize(need, "ngram-need")
    # a pair with fewer common signatures than one of the two must share isn't similar
    pairs = found.where("b is not null and a != b")
    for side in ("a", "b"):
        pairs = pairs.join(need.select(F.col("id").alias(side), "parity", F.col("need").alias(f"need_{side}")), [side, "parity"])
    pairs = pairs.where("n >= need_a and n >= need_b").select("a", "b").distinct()
    edges = materialize(verified(pairs, docs), "ngram-links")
    still = need.where("need <= 0").select(F.col("id").alias("doc_id")).distinct()
    least = base.join(still, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.min(F.ceil(F.col("n") * 3 / 4)).alias("least"))
    open_docs = materialize(docs.select("doc_id", "text").join(still, "doc_id", "left_semi"), "ngram-open")
    return among(open_docs, edges, least)


def parity(s: np.ndarray) -> np.ndarray:
    """1024 bits: whether an odd number of hashes falls on each. Two maps differ in no more bits than the sets in hashes."""
    odd = np.bincount((s & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [shingles(t) for t in b["text"]]
        maps = np.array([parity(s) for s in found], np.int64).reshape(len(found), len(WORDS))
        yield pd.DataFrame({"doc_id": b["doc_id"], "set": [s.tobytes() for s in found], "held": [len(s) for s in found]} | dict(zip(WORDS, maps.T)))


def _need(base: DataFrame, hot: DataFrame) -> DataFrame:
    """id, parity, need: common signatures in small buckets that a similar set must have; 0 or less: can't be told."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, band & 1, shared_least(n, band), e) for i, n, *es in zip(b["doc_id"], b["n"], b["e0"], b["e1"]) for band, e in zip(bands(n), es)]
            yield pd.DataFrame(rows, columns=["id", "parity", "full", "empty"])

    least = base.select("doc_id", "n", "e0", "e1").mapInPandas(released(run), "id long, parity int, full long, empty long")
    least = least.groupBy("id", "parity").agg(F.min("full").alias("full"), F.max("empty").alias("empty"))
    return least.join(hot, ["id", "parity"], "left").select("id", "parity", (F.col("full") - F.col("empty") - F.coalesce("hot", F.lit(0))).alias("need"))


def among(docs: DataFrame, edges: DataFrame, least: DataFrame) -> DataFrame:
    """Components, after the sets in docs are joined among themselves; edges: the links known so far.

    least: id and the shingles that a set shares with any similar one at least. A shingle's bucket are the sets that
    hold it. Of two similar sets, the smallest bucket that both are in is not among the `least` - 1 largest of either,
    so these are left out: a common passage in a text makes no candidates, unless the text is little else.

    Two exact bounds hold within a bucket, before a pair is made. The rarest shingle that two sets share has all that
    they share at its own place or a larger one, so the lesser place in the two sets bounds the intersection. And
    the bits in which the sets' parity maps differ bound their difference from below.
    """
    groups = materialize(components(edges), "ngram-groups")
    rows = signed(docs, whole=True)
    docs = materialize(docs.mapInPandas(released(_stored), ", ".join(["doc_id long, set binary, held long", *(f"{w} long" for w in WORDS)])), "ngram-stored")
    maps = docs.drop("set").withColumnRenamed("doc_id", "id")
    seen = rows.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1")
    largest = Window.partitionBy("id").orderBy(F.desc("size"), "sig")
    rows = rows.join(seen, "sig").join(least, "id").withColumn("r", F.row_number().over(largest)).where("r >= least").select("sig", "id", "r")
    rows = materialize(rows, "ngram-prefix")
    rows = materialize(rows.join(rows.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1"), "sig"), "ngram-members")
    leaders, tried = 2, None
    while True:
        own = rows.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = own.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("id").alias("first")).where("c0 != c1").select("sig", "first")
        rows_left = materialize(own.join(mixed, "sig"), "ngram-mixed")
        if rows_left.isEmpty():
            return groups
        draw = F.shiftrightunsigned(F.xxhash64("sig", "id"), 33)  # 31 bits
        chosen = rows_left.where((F.col("id") == F.col("first")) | (draw * F.col("size") <= F.lit(leaders) * F.lit(2**31)))
        chosen = chosen.join(maps, "id").select("sig", *(F.col(c).alias(f"{c}_l") for c in ("id", "component", "r", "held", *WORDS)))
        # similar sets share 3/7 of their sizes' sum at least, and differ in 1/7 of it at most
        differ = reduce(add, (F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_l"))) for w in WORDS))
        total = F.col("held") + F.col("held_l")
        near = (F.col("component") != F.col("component_l")) & (7 * F.least("r", "r_l") >= 3 * total) & (7 * differ <= total)
        pairs = rows_left.join(maps, "id").join(chosen.withColumnRenamed("id_l", "leader"), "sig").where(near).select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "ngram-pairs")
        fresh = materialize(verified(pairs, docs), "ngram-links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        groups = merged(groups, fresh)
        if leaders >= 2**31 or rows_left.agg(F.max("size")).first()[0] <= leaders:
            return groups  # every member has been a leader
        rows = rows_left.select("sig", "id", "r", "size")
        leaders *= 4


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per row of docs."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = materialize(sets(own), "ngram-sets")
    real = base.where("n > 0 and doc_id is not null")
    classes = materialize(real.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "e0", "e1")).alias("r")).select("k1", "k2", "n", "r.*"), "ngram-classes")
    alone = classes.select("doc_id").distinct()
    texts = own.join(alone, "doc_id", "left_semi")
    groups = links(texts, classes)
    named = classes.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("k1", "k2", "n", F.coalesce("component", "doc_id").alias("component"))
    out = base.join(named, ["k1", "k2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, result: DataFrame) -> DataFrame:
    """The rows of docs without near duplicates: of each component the document of the smallest doc_id stays."""
    drop = result.where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(drop, docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")
