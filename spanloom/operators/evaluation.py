"""Evaluation of predicted spans against targets, run summaries and resume."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import intervals as I

THRESHOLDS = (0.3, 0.5, 0.7)


def assign(gain: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one matching with the largest sum (shortest augmenting paths with potentials)."""
    if not gain or not gain[0]:
        return []
    flipped = len(gain) > len(gain[0])
    cost = [[-g for g in col] for col in zip(*gain)] if flipped else [[-g for g in row] for row in gain]
    n, m = len(cost), len(cost[0])
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [-1] * (m + 1)
    for r in range(n):
        owner[m] = r
        at, low, came, seen = m, [float("inf")] * m, [m] * m, [False] * (m + 1)
        while owner[at] >= 0:
            seen[at] = True
            row = owner[at]
            for c in range(m):
                if not seen[c] and (d := cost[row][c] - u[row] - v[c]) < low[c]:
                    low[c], came[c] = d, at
            nxt = min((c for c in range(m) if not seen[c]), key=lambda c: low[c])
            step = low[nxt]
            for c in range(m + 1):
                if seen[c]:
                    u[owner[c]] += step
                    v[c] -= step
                elif c < m:
                    low[c] -= step
            at = nxt
        while at != m:
            owner[at] = owner[came[at]]
            at = came[at]
    pairs = [(owner[c], c) for c in range(m) if owner[c] >= 0]
    return sorted((c, r) if flipped else (r, c) for r, c in pairs)


def matched(records: DataFrame) -> DataFrame:
    """id, matched (IoUs of the best one-to-one matching). records: id, spans, targets; a record is one row, no group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for grid in b["grid"]:
                g = [list(map(float, row)) for row in grid]
                out.append([g[r][c] for r, c in assign(g)])
            yield pd.DataFrame({"id": b["id"], "matched": out})

    grid = F.transform("spans", lambda p: F.transform("targets", lambda t: I.iou(p, t)))
    kind = records.schema["id"].dataType.simpleString()
    return records.select("id", grid.alias("grid")).mapInPandas(run, f"id {kind}, matched array<double>")


def multi_metrics(records: DataFrame) -> DataFrame:
    """Per record: c_acc, t_iou, cardinality_error, tp/tr/tf1 at each threshold (tp_3 at 0.3), etf1."""
    rows = records.join(matched(records), "id")
    n, m = F.size("spans"), F.size("targets")
    cols = {"c_acc": (n == m).cast("double"), "t_iou": I.set_iou(F.col("spans"), F.col("targets")), "cardinality_error": F.abs(n - m).cast("double")}
    for t in THRESHOLDS:
        hit = F.size(F.filter("matched", lambda x: x >= t))  # noqa: B023
        k = str(t)[2:]
        cols |= {f"tp_{k}": F.when(n > 0, hit / n).otherwise(0.0), f"tr_{k}": F.when(m > 0, hit / m).otherwise(0.0), f"tf1_{k}": F.when(n + m > 0, 2 * hit / (n + m)).otherwise(0.0)}
    out = rows.select("id", *[c.alias(k) for k, c in cols.items()])
    return out.withColumn("etf1", F.col("c_acc") * sum(F.col(f"tf1_{str(t)[2:]}") for t in THRESHOLDS) / len(THRESHOLDS))


def multi_summary(records: DataFrame) -> DataFrame:
    """Macro means in percent (cardinality_error as it is) over the records with targets."""
    rows = multi_metrics(records.where(F.size("targets") > 0))
    names = [c for c in rows.columns if c != "id"]
    return rows.agg(F.count("*").alias("count"), *[(F.avg(c) * (1 if c == "cardinality_error" else 100)).alias(c) for c in names])


def single_summary(records: DataFrame) -> DataFrame:
    """mIoU and recall at 1 of the first prediction against its best target, as fractions."""
    rows = records.where(F.size("targets") > 0).select(F.coalesce(I.best_iou(F.try_element_at("spans", F.lit(1)), F.col("targets")), F.lit(0.0)).alias("v"))
    return rows.agg(F.count("*").alias("count"), F.avg("v").alias("miou"), *[F.avg((F.col("v") >= t).cast("double")).alias(f"r1_{str(t)[2:]}") for t in THRESHOLDS])


def last_wins(log: DataFrame, key: str, order: str) -> DataFrame:
    names = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("r")).select(key, "r.*")


def pending(requested: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Requested rows without a success in the log; failures are tried again."""
    return requested.join(done.select(key), key, "left_anti")


def filled(requested: DataFrame, done: DataFrame, key: str, order: str) -> DataFrame:
    """Every requested row with its last prediction, or an empty one."""
    return requested.join(last_wins(done, key, order), key, "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{I.SPAN}>")))


def run_summary(requested: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """requested, successful, failed and status (empty, failed, partial, complete)."""
    ok = requested.join(done.select(key).distinct().withColumn("ok", F.lit(True)), key, "left")
    s = ok.agg(F.count("*").alias("requested"), F.count("ok").alias("successful")).withColumn("failed", F.col("requested") - F.col("successful"))
    status = F.when(F.col("requested") == 0, "empty").when(F.col("successful") == 0, "failed").when(F.col("failed") > 0, "partial").otherwise("complete")
    return s.withColumn("status", status)


def strata(rows: DataFrame, by: str, edges: list[float], value: str) -> DataFrame:
    bin_ = sum((F.col(by) >= e).cast("int") for e in edges)
    return rows.groupBy(bin_.alias("stratum")).agg(F.count("*").alias("count"), F.avg(value).alias("mean"))


def ranked(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
