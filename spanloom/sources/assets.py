"""Verification of downloaded benchmarks: the videos that annotations name against those that are there, and the marker."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.sources.readers import CAMERA, SUFFIXES
from spanloom.sources.sinks import write_json

TAKE = r"^s\d+-d\d+$"  # fixed value: the name of a kitchen take
MARKER = ".complete.json"


def normal_ids(records: DataFrame, takes: bool = False) -> DataFrame:
    """video: the distinct ids that records (vid) name, without blanks around, takes in lower case; raises on a bad one."""
    vid = F.trim(F.coalesce("vid", F.lit("")))
    vid = F.lower(vid) if takes else vid
    bad = ~vid.rlike(TAKE) if takes else (vid == "") | vid.contains("/") | vid.contains("\\")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("invalid video id: "), vid)).cast("string")).otherwise(vid)
    return records.select(checked.alias("video")).distinct()


def present_ids(paths: DataFrame, takes: bool = False) -> DataFrame:
    """video: the distinct ids of the video files in paths (path); of takes, without the camera."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    stem = F.regexp_extract("path", r"([^/]+)\.[A-Za-z0-9]+$", 1)
    rows = paths.where(suffix.isin(*SUFFIXES))
    if takes:
        stem = F.lower(F.coalesce(F.nullif(F.regexp_extract(stem, CAMERA, 1), F.lit("")), F.when(stem.rlike(f"(?i){TAKE}"), stem)))
    return rows.select(stem.alias("video")).where("video is not null").distinct()


def difference(expected: DataFrame, found: DataFrame) -> DataFrame:
    """video, side: `missing` for what is expected alone, `unexpected` for what is found alone."""
    missing = expected.join(found, "video", "left_anti").select("video", F.lit("missing").alias("side"))
    return missing.unionByName(found.join(expected, "video", "left_anti").select("video", F.lit("unexpected").alias("side")))


def verified(expected: DataFrame, found: DataFrame, exact: bool = True) -> int:
    """How many videos are there; raises if some are missing or, if exact, not expected. Five names are shown at most."""
    told = difference(expected, found).groupBy("side").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("video")), 1, 5).alias("some"))
    sides = {r["side"]: r for r in told.collect()}
    if r := sides.get("missing"):
        raise FileNotFoundError(f"{r['n']} videos are missing: {r['some']}")
    if exact and (r := sides.get("unexpected")):
        raise ValueError(f"{r['n']} videos are not expected: {r['some']}")
    if expected.isEmpty():
        raise ValueError("the annotation names no videos")
    return expected.count()


def superfluous(paths: DataFrame, expected: DataFrame) -> DataFrame:
    """path of the video files that belong to no expected take."""
    stem = F.regexp_extract("path", r"([^/]+)\.[A-Za-z0-9]+$", 1)
    own = F.lower(F.coalesce(F.nullif(F.regexp_extract(stem, CAMERA, 1), F.lit("")), stem))
    rows = paths.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*SUFFIXES)).withColumn("video", own)
    return rows.join(expected, "video", "left_anti").select("path")


def completed(folder: str) -> dict[str, Any] | None:
    """What the marker of a complete download says, if it is there."""
    path = f"{folder}/{MARKER}"
    if not os.path.exists(path):
        return None
    with open(path) as f:
        return json.load(f)


def complete(folder: str, source: Mapping[str, Any]) -> dict[str, Any]:
    value = {"complete": True, "source": dict(source)}
    write_json(f"{folder}/{MARKER}", value)
    return value
