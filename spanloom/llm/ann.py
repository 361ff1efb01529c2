"""Approximate nearest neighbours: stable projections to few dimensions, kd-trees over them, a chi-square stop.

Largest inner product becomes smallest distance by one more coordinate: a vector x gets sqrt(M^2 - |x|^2), M the
largest norm of all rows, a query gets 0 (after scaling to length 1, which changes no order). All are projected on
`dims` Gaussian (2-stable) directions. A projected squared distance over the true one is chi-square with `dims`
degrees, so once the k-th best verified distance d and the projected radius r reached so far satisfy
P(chi2(dims) <= r^2 / d^2) >= stop, a nearer vector is unlikely to lie beyond r, and the search ends.

Distribution: a kd-tree over a bounded sample cuts the projected space into regions; every vector is in the index, in
its region. A query is first sent to the region that it lies in, which gives it a k-th best near by; with that (or the
sample's, if better) it has a radius beyond which the test already holds, and goes to the other regions within it only.
A region's vectors (in blocks of at most about `block` vectors, a large region being several)
get a kd-tree of their own; a query takes its leaves in the order of projected distance, and of a leaf's vectors those
within the radius at which the test holds are verified by the original vectors, until a leaf lies beyond it. Queries
come in slices of about `slice_` as well, so a group's two sides are bounded. The best of all groups are merged per
query. `verified` counts the vectors that were compared with a query: how much of the table depends on the data. Of
vectors without any structure (uniform directions in 64 dimensions) about half are, as their k-th best is hardly
nearer than the others; of clustered ones, few.

Broadcast: the directions, the sample's projections and the region boxes, bounded by parameters.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, neither as queries nor as candidates; equal scores are ordered by vec_id; a query's own row and others with
its vec_id are no candidates; of query rows with one vec_id the least vector is searched for; repeated candidates are
candidates each; with fewer candidates than k all are returned; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import materialize


def chi2_cdf(x: np.ndarray, k: int) -> np.ndarray:
    """P(chi-square with an even k degrees <= x)."""
    half = np.minimum(np.asarray(x, float) / 2, 700)
    term = total = np.ones_like(half)
    for i in range(1, k // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi2_inverse(p: float, k: int) -> float:
    low, high = 0.0, 20.0 * k
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def boxes(points: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A kd-tree's leaves of at most `size` points: their numbers, lower and upper corners."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        x = points[own]
        low, high = x.min(0), x.max(0)
        if len(own) <= size or not (high > low).any():
            out += [(part, low, high) for part in np.array_split(own, max(1, math.ceil(len(own) / size)))]
            continue
        order = own[np.argsort(x[:, int(np.argmax(high - low))], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def regions(points: np.ndarray, count: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Splits of a kd-tree of the whole projected space, as nested (axis, cut, left, right) or region number."""
    lows, highs = [], []

    def cut(own, low, high, left):
        if left <= 1 or len(own) < 2 * left:
            lows.append(low)
            highs.append(high)
            return len(lows) - 1
        axis = int(np.argmax(np.ptp(points[own], axis=0)))
        at = float(np.median(points[own, axis]))
        up, down = high.copy(), low.copy()
        up[axis] = down[axis] = at
        a = cut(own[points[own, axis] < at], low, up, left // 2)
        b = cut(own[points[own, axis] >= at], down, high, left - left // 2)
        return (axis, at, a, b)

    d = points.shape[1]
    tree = cut(np.arange(len(points)), np.full(d, -np.inf), np.full(d, np.inf), count)
    return tree, np.array(lows), np.array(highs)


def region_of(tree, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, own = todo.pop()
        if isinstance(node, tuple):
            axis, at, a, b = node
            less = points[own, axis] < at
            todo += [(a, own[less]), (b, own[~less])]
        else:
            out[own] = node
    return out


def usable(vectors: DataFrame) -> DataFrame:
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    usual = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return v.join(F.broadcast(usual), F.size("v") == F.col("n"), "left_semi")


def _box_gap(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distances from each query to each box."""
    gap = np.maximum(0, np.maximum(low[None] - q[:, None], q[:, None] - high[None]))
    return np.sqrt((gap * gap).sum(2))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, dims: int = 16, stop: float = 0.92, sample: int = 1024, block: int = 8192, leaf: int = 64, slice_: int = 8192, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score, verified. vectors: vec_id, v; queries: the same of some of those rows."""
    spark = vectors.sparkSession
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"), F.max(F.size("v")).alias("d")).first()
    schema = "query_id long, rank int, vec_id long, score double, verified long"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    top, d = facts["m"], facts["d"]
    some = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).collect()
    base_id, base = np.array([r["vec_id"] for r in some]), np.array([r["v"] for r in some])
    way = np.random.default_rng(seed).standard_normal((d + 1, dims))
    limit = chi2_inverse(stop, dims)

    def flat(x: np.ndarray) -> np.ndarray:
        """Projections of rows, with the coordinate that makes all lengths equal."""
        rest = np.sqrt(np.maximum(0, top - (x * x).sum(1)))
        return np.column_stack([x, rest]) @ way

    scale = math.sqrt(top)

    def flat_query(x: np.ndarray) -> np.ndarray:
        return (x / np.sqrt((x * x).sum(1))[:, None] * scale) @ way[:-1]

    tree, low, high = regions(flat(base), max(1, min(4096, round(facts["n"] / block))))
    shared = spark.sparkContext.broadcast((base_id, base, tree, low, high))

    def distance2(score: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Squared distances in the enlarged space, from inner products."""
        return 2 * top - 2 * scale * score / norm

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                yield pd.DataFrame({"region": region_of(shared.value[2], flat(x)), "id": b["vec_id"].to_numpy(), "v": b["v"], "bound": np.nan})

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries in the region that they lie in, with the sample's k-th best score."""
        ids, own, tree, _, _ = shared.value
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                x = np.stack(part["v"].to_numpy())
                s = x @ own.T
                s[ids[None] == part["vec_id"].to_numpy()[:, None]] = -np.inf
                bound = np.full(len(x), -np.inf)
                if s.shape[1] > k:
                    bound = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                yield pd.DataFrame({"region": region_of(tree, flat_query(x)), "id": part["vec_id"].to_numpy(), "v": part["v"], "bound": bound})

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries in the other regions within the radius that their bound leaves."""
        _, _, _, low, high = shared.value
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                x, bound = np.stack(part["v"].to_numpy()), part["bound"].to_numpy()
                norm = np.sqrt((x * x).sum(1))
                far = np.sqrt(np.maximum(0, distance2(np.maximum(bound, -1e300), norm)) * limit)
                near = _box_gap(flat_query(x), low, high) <= far[:, None]
                near[np.arange(len(x)), part["region"].to_numpy()] = False
                q, r = np.nonzero(near)
                yield pd.DataFrame({"region": r, "id": part["id"].to_numpy()[q], "v": part["v"].to_numpy()[q], "bound": bound[q]})

    fields = "region long, id long, v array<double>, bound double"
    # large regions are several blocks, by hash, and many queries several slices: each block meets each slice
    placed = materialize(vectors.mapInPandas(place, fields), "ann-placed")
    queries = materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    slices = max(1, math.ceil(queries.count() / slice_))
    many = placed.groupBy("region").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    to = many.select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    rows = placed.join(F.broadcast(many), "region").withColumn("block", F.expr("pmod(xxhash64(id), blocks)")).drop("blocks")
    rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    def find(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "verified": pd.Series(dtype="int64")})
        ids, x = left["id"].to_numpy(), np.stack(left["v"].to_numpy())
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        leaves = boxes(flat(x), leaf)
        numbers = [n for n, _, _ in leaves]
        lows, highs = np.array([a for _, a, _ in leaves]), np.array([b for _, _, b in leaves])
        by_leaf = np.concatenate(numbers)
        x, ids = x[by_leaf], ids[by_leaf]
        low_x = flat(x)
        low_x2 = (low_x * low_x).sum(1)
        edges = np.cumsum([0, *map(len, numbers)])
        out = []
        for at in range(0, len(right), 256):
            part = right.iloc[at : at + 256]
            queries = np.stack(part["v"].to_numpy())
            low_q = flat_query(queries)
            gaps = _box_gap(low_q, lows, highs)
            away = low_x2[None] - 2 * (low_q @ low_x.T) + (low_q * low_q).sum(1)[:, None]  # projected squared distances
            for q, own, gap, far2, worst in zip(queries, part["id"].to_numpy(), gaps, away, part["bound"].to_numpy()):
                norm = math.sqrt(q @ q)
                near = np.argsort(gap, kind="stable")
                best_s, best_i = np.empty(0), np.empty(0, np.int64)
                done, step, verified = 0, 4, 0
                while done < len(near):
                    reached = gap[near[done]]
                    left_over = max(0.0, float(distance2(np.float64(worst), norm))) if worst > -np.inf else math.inf
                    if reached * reached >= limit * left_over:
                        break
                    take = near[done : done + step]
                    done, step = done + step, min(64, step * 2)
                    rows = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in take])
                    rows = rows[(ids[rows] != own) & (far2[rows] < limit * left_over)]
                    verified += len(rows)
                    s = x[rows] @ q
                    s_all, i_all = np.concatenate([best_s, s]), np.concatenate([best_i, ids[rows]])
                    if len(s_all) > 4 * k:
                        hold = s_all >= np.partition(s_all, len(s_all) - k)[len(s_all) - k]
                        s_all, i_all = s_all[hold], i_all[hold]
                    first = np.lexsort((i_all, -s_all))[:k]
                    best_s, best_i = s_all[first], i_all[first]
                    if len(best_s) == k:
                        worst = max(worst, best_s[-1])
                if not len(best_i):  # nothing here is near enough
                    best_i, best_s = np.array([own]), np.array([-np.inf])
                out.append((np.full(len(best_i), own), best_i, best_s, np.concatenate([[verified], np.zeros(len(best_i) - 1, np.int64)])))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "verified"), map(np.concatenate, zip(*out)))))

    def searched(sent: DataFrame) -> DataFrame:
        sent = sent.join(F.broadcast(to), "region").withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
        group = ["region", "block", "slice"]
        return rows.groupBy(*group).cogroup(sent.groupBy(*group)).applyInPandas(find, "query_id long, vec_id long, score double, verified long")

    first = materialize(queries.mapInPandas(home, fields), "ann-home")
    near = materialize(searched(first), "ann-near")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    known = first.join(kth, "id", "left").select("region", "id", "v", F.greatest("bound", F.coalesce("kth", "bound")).alias("bound"))
    found = near.unionByName(searched(known.mapInPandas(others, fields)))
    best = found.withColumns({"verified": F.sum("verified").over(Window.partitionBy("query_id")), "rank": F.row_number().over(w)})
    return best.where((F.col("rank") <= k) & (F.col("score") > float("-inf"))).select("query_id", "rank", "vec_id", "score", "verified")


def query(embeddings: DataFrame) -> DataFrame:
    v = usable(embeddings)
    return search(v, v.where("vec_id % 20 = 0"))
