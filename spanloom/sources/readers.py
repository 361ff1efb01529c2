"""Benchmark annotations, video catalogs and feature tables as DataFrames with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import intervals as I

SAMPLE = f"id string, video string, duration double, query string, targets array<{I.SPAN}>, cardinality string"
# Preferred folders and suffixes, first wins; camera names and the question's phrase.
FOLDERS = ("videos", "rgb_videos_30fps_480", "rgb_videos_15fps_short256")
SUFFIXES = ("mp4", "mkv", "webm", "avi")
CAMERA = r"(?i)^(s\d+-d\d+)-cam-\d+$"
QUESTION = r"(?i)textual query\s+['\"](.+)['\"]\s+and determine"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_file(spark: SparkSession, root: str, candidates: Sequence[str]) -> str:
    for c in candidates:
        if exists(spark, f"{root}/{c}"):
            return f"{root}/{c}"
    raise FileNotFoundError(f"none of {', '.join(candidates)} in {root}")


def video_catalog(paths: DataFrame, root: str = "") -> DataFrame:
    """stem, path: the first of each name by folder, suffix, path; camera files also give their take's name.

    Where preferred folders exist right below the root, no others are searched. A camera file's two names take part in
    the same order as all others.
    """
    name = F.regexp_extract("path", r"([^/]+)\.([A-Za-z0-9]+)$", 1)
    suffix = F.array_position(F.array(*map(F.lit, SUFFIXES)), F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    below = F.substring_index(F.expr(f"substring(path, {len(root.rstrip('/')) + 2})"), "/", 1) if root else F.regexp_extract("path", "(?:^|/)([^/]+)/[^/]+$", 1)
    folder = F.coalesce(*[F.when(below == f, F.lit(i)) for i, f in enumerate(FOLDERS)], F.lit(len(FOLDERS)))
    rows = paths.select("path", name.alias("stem"), suffix.alias("suffix"), folder.alias("folder")).where("suffix > 0")
    best = rows.agg(F.min("folder").alias("best"))
    rows = rows.join(F.broadcast(best)).where((F.col("best") == len(FOLDERS)) | (F.col("folder") < len(FOLDERS)))
    take = F.regexp_extract("stem", CAMERA, 1)
    names = rows.select("path", "suffix", "folder", F.explode(F.when(take != "", F.array("stem", take)).otherwise(F.array("stem"))).alias("stem"))
    return names.groupBy("stem").agg(F.min_by("path", F.struct("folder", "suffix", "path")).alias("path"))


def video_index(spark: SparkSession, root: str) -> DataFrame:
    """The catalog of the files below root; raises if there are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{%s}" % ",".join(SUFFIXES)).load(root).select("path")
    if files.isEmpty():
        raise FileNotFoundError(f"no videos below {root}")
    plain = F.regexp_replace("path", "^file:/+", "/")
    return video_catalog(files.select(plain.alias("path")), root)


def _pairs(pairs: Column, duration: Column, clamp: bool) -> Column:
    good = F.filter(pairs, lambda p: (F.size(p) >= 2) & (F.element_at(p, 2) > F.element_at(p, 1)))
    at = lambda x: F.greatest(F.lit(0.0), F.least(duration, x)) if clamp else x
    return F.transform(good, lambda p: I.span(at(F.element_at(p, 1)), at(F.element_at(p, 2)), F.lit(1.0)))


def numbered(lines: DataFrame) -> DataFrame:
    """lines (value, in the order of the file) with line, from 0: each partition counts its own, after those before it."""
    own = lines.select("value", F.monotonically_increasing_id().alias("at"))
    part = F.shiftrightunsigned("at", 33)
    sizes = own.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("part", before.alias("before")))
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return own.withColumn("part", part).join(starts, "part").select("value", (F.col("before") + inside).alias("line"))


def question_query(question: Column) -> Column:
    """The quoted phrase of a question, or all of it."""
    phrase = F.regexp_extract(question, QUESTION, 1)
    return F.trim(F.when(question.rlike(QUESTION), phrase).otherwise(question))


def _duration(declared: Column, rows: DataFrame, videos: DataFrame | None, media) -> DataFrame:
    """rows with duration: the declared one if it is above 0, else the video's own (the plug-in reads the file at `path`)."""
    known = F.coalesce(declared.cast("double"), F.lit(0.0))
    rows = rows.withColumn("duration", F.when(known > 0, known))
    if media is None or videos is None:
        return rows
    probe = F.udf(lambda p: float(media.probe(p).duration), "double")
    return rows.withColumn("duration", F.coalesce("duration", F.when(F.col("duration").isNull(), probe("path"))))


def tsv_samples(spark: SparkSession, path: str, videos: DataFrame | None = None, media=None) -> DataFrame:
    """Header TSV: video, question, answer, duration, id (default: the row's number from 0); many targets a query.

    A declared duration reaches to the last target at least; an undeclared one is the video's own.
    """
    lines = numbered(spark.read.text(path))
    head = lines.where("line = 0").first()
    names = [c.strip() for c in head["value"].split("\t")]
    cells = F.from_csv(F.col("value"), ", ".join(f"`{c}` string" for c in names), {"sep": "\t", "quote": '"'})
    raw = lines.where("line > 0 and value <> ''").select((F.col("line") - 1).alias("line"), cells.alias("c")).select("line", "c.*")
    for c in ("id", "duration"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    rows = raw.withColumns({"targets": I.parse_spans(F.col("answer")), "stem": F.regexp_extract("video", r"([^/]+?)(?:\.[^./]*)?$", 1)})
    rows = rows.select("line", "video", "stem", "question", "targets", F.col("duration").alias("declared"), F.col("id").alias("own"))
    if videos is not None:
        rows = with_videos(rows, videos, "stem")
    rows = _duration(F.col("declared"), rows, videos, media)
    last = F.array_max(F.transform("targets", lambda s: s["end"]))
    length = F.when(F.coalesce(F.col("declared").cast("double"), F.lit(0.0)) > 0, F.greatest("duration", last)).otherwise(F.col("duration"))
    return rows.select(
        F.coalesce("own", F.col("line").cast("string")).alias("id"), "video", length.alias("duration"), question_query(F.trim("question")).alias("query"),
        "targets", F.lit("multi").alias("cardinality"), F.lit("omtg").alias("group"), *(["path"] if videos is not None else []),
    )


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a file with their line, from 1. A missing file is an empty table; blank lines are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"line long, {schema}")
    lines = numbered(spark.read.text(path)).where(F.trim("value") != "")
    return lines.select((F.col("line") + 1).alias("line"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("line", "r.*")


def jsonl_samples(spark: SparkSession, path: str, labelled: bool = True, group: str = "", videos: DataFrame | None = None, media=None) -> DataFrame:
    """qid (default test:<line>), vid, duration, query, relevant_windows (absent where labels are hidden)."""
    rows = jsonl(spark, path, "qid string, vid string, duration double, query string, relevant_windows array<array<double>>").withColumnRenamed("duration", "declared")
    if videos is not None:
        rows = with_videos(rows, videos, "vid")
    rows = _duration(F.col("declared"), rows, videos, media)
    none = F.array().cast(f"array<{I.SPAN}>")
    targets = F.coalesce(_pairs(F.col("relevant_windows"), F.col("duration"), True), none) if labelled else none
    return rows.select(
        F.coalesce("qid", F.concat(F.lit("test:"), F.col("line"))).alias("id"), F.col("vid").alias("video"), "duration", F.trim("query").alias("query"),
        targets.alias("targets"), F.lit("single").alias("cardinality"), F.lit(group).alias("group"), *(["path"] if videos is not None else []),
    )


def with_videos(samples: DataFrame, videos: DataFrame, by: str = "video") -> DataFrame:
    """Samples with their video's path, by the column `by`; a sample without one raises when read."""
    joined = samples.join(videos.select(F.col("stem").alias("_stem"), "path"), samples[by] == F.col("_stem"), "left").drop("_stem")
    return joined.withColumn("path", F.coalesce("path", F.raise_error(F.concat(F.lit("no video for "), F.col(by))).cast("string")))


# Where benchmarks keep their annotations, first wins.
TSV = ("OMTGBench.tsv",)
TAKES = ("test.jsonl", "annotations/test.jsonl", "captions/test.jsonl")
HIDDEN = ("highlight_test_release.jsonl", "annotations/highlight_test_release.jsonl", "metadata/highlight_test_release.jsonl")
# End of fixed values.


def _loaded(samples: DataFrame) -> DataFrame:
    """Samples, if all hold the data model's rules."""
    good, bad = validated(samples)
    if r := bad.first():
        raise ValueError(f"invalid sample {r['id']!r}")
    return good


def load_tsv(spark: SparkSession, root: str, media=None) -> DataFrame:
    return _loaded(tsv_samples(spark, first_file(spark, root, TSV), video_index(spark, root), media))


def load_takes(spark: SparkSession, root: str, media=None) -> DataFrame:
    return _loaded(jsonl_samples(spark, first_file(spark, root, TAKES), True, "tacos", video_index(spark, root), media))


def load_hidden(spark: SparkSession, root: str, media=None) -> DataFrame:
    return _loaded(jsonl_samples(spark, first_file(spark, root, HIDDEN), False, "qvhighlights", video_index(spark, root), media))


def aligned_features(streams: Sequence[DataFrame], timestamps: DataFrame) -> DataFrame:
    """video, ts, emb: streams (video, pos, emb) cut to the shortest, joined by position, read at rint(t / duration * (n - 1)).

    timestamps: video, duration, ts.
    """
    out = None
    for i, s in enumerate(streams):
        s = s.select("video", "pos", F.col("emb").alias(f"e{i}"))
        out = s if out is None else out.join(s, ["video", "pos"])
    both = out.select("video", "pos", F.concat(*[F.col(f"e{i}") for i in range(len(streams))]).alias("emb"))
    n = both.groupBy("video").agg((F.max("pos") + 1).alias("n"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ts") / F.col("duration")))
    at = timestamps.join(n, "video").withColumn("pos", F.bround(share * (F.col("n") - 1)).cast("int"))
    return at.join(both.withColumn("pos", F.col("pos").cast("int")), ["video", "pos"]).select("video", "ts", "emb")


def validated(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples that hold the data model's rules, and the others."""
    bad = F.exists("targets", lambda s: ~((s["start"] >= 0) & (s["end"] > s["start"])))
    ok = (F.col("id") != "") & (F.col("query") != "") & (F.col("duration") > 0) & F.col("cardinality").isin("single", "multi") & ~F.coalesce(bad, F.lit(False))
    ok = F.coalesce(ok, F.lit(False))
    return samples.where(ok), samples.where(~ok)
