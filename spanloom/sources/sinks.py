"""Prediction logs, manifests, submissions and the result index."""

from __future__ import annotations

import csv
import json
import os
import tempfile
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the result index.
INDEX = ("benchmark", "model", "method", "seed", "subset", "requested", "successful", "failed", "metrics", "run")


def append_log(rows: DataFrame, path: str) -> None:
    """Durable by the file commit protocol; the log's order is the batch column."""
    rows.write.mode("append").json(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line, keys sorted, nulls written."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_json(path: str, value: Any) -> None:
    """Whole or not at all: a temporary file, renamed."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, draft = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w") as f:
        json.dump(value, f, sort_keys=True, indent=2)
        f.write("\n")
    os.replace(draft, path)


def ensure_manifest(path: str, value: Mapping[str, Any]) -> None:
    """Writes the run's manifest, or raises if another run's is there."""
    if os.path.exists(path):
        with open(path) as f:
            if json.load(f) != json.loads(json.dumps(value)):
                raise ValueError(f"{path} belongs to a run with other settings")
    else:
        write_json(path, value)


def submission(predictions: DataFrame, most: int = 10) -> DataFrame:
    """qid (a number if all digits), query, vid, pred_relevant_windows ([start, end, score] of the first `most`), as JSON lines."""
    spans = F.transform(F.slice("spans", 1, most), lambda s: F.array(s["start"], s["end"], s["score"]))
    number = F.col("id").rlike("^[0-9]+$")
    rest = F.struct("query", F.col("video").alias("vid"), spans.alias("pred_relevant_windows"))
    as_number = F.to_json(F.struct(F.when(number, F.col("id").cast("long")).alias("qid"), rest["query"].alias("query"), rest["vid"].alias("vid"), rest["pred_relevant_windows"].alias("pred_relevant_windows")))
    as_text = F.to_json(F.struct(F.col("id").alias("qid"), rest["query"].alias("query"), rest["vid"].alias("vid"), rest["pred_relevant_windows"].alias("pred_relevant_windows")))
    return predictions.select(F.when(number, as_number).otherwise(as_text).alias("value"))


def may_submit(metrics: Any, percent: float, failed: int) -> bool:
    return (metrics is None or percent == 100) and failed == 0


def run_path(root: str, benchmark: str, model: str, method: str, seed: int) -> str:
    return f"{root}/runs/{benchmark}/{model}/{method}/seed-{seed}"


def result_index(spark: SparkSession, root: str) -> DataFrame:
    """INDEX: a row per metrics file of a run, its manifest joined by folder; runs and subsets in order of their paths."""
    text = lambda glob: spark.read.text(f"{root}/runs/*/*/*/seed-*/{glob}", wholetext=True).withColumn("file", F.expr("_metadata.file_path"))
    place = "^(.*/(runs/[^/]+/[^/]+/[^/]+/[^/]+))/"
    if not exists(spark, f"{root}/runs"):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in INDEX))
    manifests = text("manifest.json").select(F.regexp_extract("file", place, 1).alias("dir"), F.regexp_extract("file", place, 2).alias("run"), F.from_json("value", "benchmark string, model string, method string, seed string").alias("m"))
    metrics = text("metrics/p*.json").select(
        F.regexp_extract("file", place, 1).alias("dir"), F.regexp_extract("file", r"/p([^/]+)\.json$", 1).alias("subset"),
        *[F.coalesce(F.get_json_object("value", f"$.{c}").cast("int"), F.lit(0)).alias(c) for c in ("requested", "successful", "failed")],
        F.coalesce(F.get_json_object("value", "$.metrics"), F.lit("null")).alias("metrics"),
    )
    rows = manifests.join(metrics, "dir").select(*[f"m.{c}" for c in INDEX[:4]], *INDEX[4:9], "run")
    return rows.orderBy("run", "subset")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def markdown(rows: list) -> str:
    """The index as a table for readers."""
    head = ["Benchmark", "Model", "Method", "Seed", "Subset", "Success", "Metrics"]
    lines = ["# Results", "", "Written from the runs' manifests and metrics.", "", "| " + " | ".join(head) + " |", "|---|---|---|---:|---:|---:|---|"]
    lines += [f"| {r.benchmark} | {r.model} | {r.method} | {r.seed} | {r.subset}% | {r.successful}/{r.requested} | `{r.metrics}` |" for r in rows]
    if not rows:
        lines.append("| - | - | - | - | - | - | no runs yet |")
    return "\n".join(lines) + "\n"


def write_index(spark: SparkSession, root: str) -> None:
    """index.csv and RESULTS.md of all runs; there are as many rows as runs and subsets."""
    rows = result_index(spark, root).collect()
    os.makedirs(root, exist_ok=True)
    with open(f"{root}/index.csv", "w", encoding="utf-8", newline="") as f:
        table = csv.writer(f)
        table.writerow(INDEX)
        table.writerows([r[c] for c in INDEX] for r in rows)
    with open(f"{root}/RESULTS.md", "w", encoding="utf-8") as f:
        f.write(markdown(rows))
