"""One resumable run: load, take a subset, predict what is pending, evaluate, write, index."""

from __future__ import annotations

import os
import platform
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import intervals as I
from spanloom.operators import evaluation as E
from spanloom.operators import selection as S
from spanloom.plans import methods as M
from spanloom.sources import caches, readers, sinks

SAMPLER = "sorted-id-python-random-v1"  # fixed value: the sampler that subsets are drawn by
LOG = f"id string, video string, query string, duration double, targets array<{I.SPAN}>, group string, cardinality string, spans array<{I.SPAN}>, batch long"


@dataclass(frozen=True)
class Benchmark:
    """load: samples of a data folder; evaluate: one row of metrics, or none where labels are hidden."""

    name: str
    load: Callable[[SparkSession, str, caches.Media | None], DataFrame]
    evaluate: Callable[[DataFrame], DataFrame] | None
    submits: bool = False


BENCHMARKS = M.Registry("benchmark")
for _b in (
    Benchmark("omtg", readers.load_tsv, E.multi_summary),
    Benchmark("qvhighlights", readers.load_hidden, None, True),
    Benchmark("tacos", readers.load_takes, E.single_summary),
):
    BENCHMARKS.register(_b.name, lambda b=_b: b)


def summary(benchmark: Benchmark, chosen: DataFrame, done: DataFrame) -> dict[str, Any]:
    """status, requested, successful, failed, metrics; failed samples count as empty predictions."""
    out = E.run_summary(chosen.select("id"), done, "id").first().asDict()
    out["metrics"] = None
    if benchmark.evaluate is not None and out["successful"]:
        records = E.filled(chosen, done.select("id", "spans", "batch"), "id", "batch").select("id", "spans", "targets")
        out["metrics"] = benchmark.evaluate(records).first().asDict()
        out["metrics_scope"] = "all requested samples; failed samples count as empty predictions"
    if out["status"] == "empty":
        out["message"] = "The requested subset contains no samples."
    elif not out["successful"]:
        out["message"] = "No predictions succeeded; metrics were not calculated."
    elif benchmark.evaluate is None:
        out["message"] = "This benchmark's labels are hidden; its result is the submission."
    return out


def run(spark: SparkSession, root: str, data: str, benchmark: str, backend: str, method: str, percent: float = 100.0, seed: int = 0, rerun: bool = False, media: caches.Media | None = None, options: dict[str, Any] | None = None) -> dict[str, Any]:
    """Runs one benchmark with one backend and method, or what is left of it; the summary, which is also written."""
    if not readers.exists(spark, data):
        raise FileNotFoundError(f"no benchmark data at {data}")
    bench = BENCHMARKS.create(benchmark)
    samples = bench.load(spark, data, media)
    chosen = S.seeded_subset(spark, samples, "id", seed, percent).drop("position")
    place = sinks.run_path(root, benchmark, backend, method, seed)
    order = S.seeded_order([r[0] for r in samples.select("id").collect()], seed)  # a benchmark's samples: thousands
    sinks.ensure_manifest(f"{place}/manifest.json", {
        "schema": 1, "benchmark": benchmark, "split": "test", "data": data, "model": backend, "method": method, "seed": seed, "sampler": SAMPLER,
        "ordered_sample_ids": order, "options": options or {}, "python": platform.python_version(), "training_free": True,
    })
    log = f"{place}/predictions"
    if rerun:
        sinks.remove(spark, log)
    read = lambda: spark.read.schema(LOG).json(log) if readers.exists(spark, log) else spark.createDataFrame([], LOG)
    left = E.pending(chosen, read(), "id")
    if not left.isEmpty():
        model = M.BACKENDS.create(backend, **(options or {}))
        M.require({"encoded-evidence"}, set(model.capabilities))
        kwargs = {}
        if method == "coarse-to-fine-64":
            caches.write_windows(caches.with_windows(left), f"{place}/prepare")
            kwargs["cached"] = caches.read_windows(spark, f"{place}/prepare")
        got = M.METHODS.create(method)(left, model, **kwargs)
        rows = left.join(got, "id").select("id", "video", "query", "duration", "targets", "group", "cardinality", "spans", F.lit(time.time_ns()).alias("batch"))
        sinks.append_log(rows, log)
    out = summary(bench, chosen, read()) | {"run_directory": place}
    target = f"{place}/metrics/{S.percent_key(percent)}.json"
    if bench.submits and sinks.may_submit(out["metrics"], percent, out["failed"]):
        out["submission"] = f"{root}/submissions/{benchmark}/{backend}/{method}/seed-{seed}"
        values = E.filled(chosen, read().select("id", "spans", "batch"), "id", "batch")
        sinks.submission(values).write.mode("overwrite").text(out["submission"])
    sinks.write_json(target, out)
    sinks.write_index(spark, root)
    return out


def command(arguments: list[str] | None = None) -> int:
    """The command line: run, list, index."""
    import argparse
    import json

    parser = argparse.ArgumentParser(prog="spanloom")
    kinds = parser.add_subparsers(dest="what", required=True)
    kinds.add_parser("list", help="benchmarks, backends and methods")
    index = kinds.add_parser("index", help="write the result index anew")
    one = kinds.add_parser("run", help="run a benchmark, or what is left of it")
    for p in (index, one):
        p.add_argument("--root", default=os.path.join(os.getcwd(), "results"))
    one.add_argument("--benchmark", required=True, choices=BENCHMARKS.names())
    one.add_argument("--data", required=True)
    one.add_argument("--model", required=True, choices=M.BACKENDS.names())
    one.add_argument("--method", required=True, choices=M.METHODS.names())
    one.add_argument("--percent", type=float, default=100.0)
    one.add_argument("--seed", type=int, default=0)
    one.add_argument("--rerun", action="store_true")
    own = parser.parse_args(arguments)
    if own.what == "list":
        print(json.dumps({"benchmarks": BENCHMARKS.names(), "models": M.BACKENDS.names(), "methods": M.METHODS.names()}))
        return 0
    spark = SparkSession.builder.appName("spanloom").getOrCreate()
    if own.what == "index":
        sinks.write_index(spark, own.root)
        return 0
    out = run(spark, own.root, own.data, own.benchmark, own.model, own.method, own.percent, own.seed, own.rerun)
    print(json.dumps(out, sort_keys=True))
    return int(out["status"] == "failed")


if __name__ == "__main__":
    raise SystemExit(command())
