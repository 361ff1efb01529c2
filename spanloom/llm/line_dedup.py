"""Line deduplication by overlapping windows of three consecutive lines.

Lines are what a newline parts. Every three consecutive lines are hashed; a window seen before, in reading order
(doc_id, position), is a repeat, and the lines that repeats cover are removed, windows that overlap merging into one
stretch. Counting aggregates on the map side. Only windows that do repeat meet the documents again; the rows of those
that repeat most (fewer than a thousand, so they can be broadcast) are salted, so a passage of a third of all
documents is no hot key there either.

Hashes are two of 64 bits. Defined results: a null or empty text, and a text of fewer than three lines, has no window
and stays whole; the first occurrence stays; within one document later occurrences go too. Rows that share doc_id
and text are one document (each row gets its result). Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import hot_keys, materialize, salted_join

SPAN = 3


def windows(docs: DataFrame) -> DataFrame:
    """doc (id, text's hash), pos (from 0), w1, w2: each window of each distinct document."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.transform(lines, lambda x: F.xxhash64(x)).alias("h"))
    n = F.size("h") - (SPAN - 1)
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((i - 1).alias("pos"), F.xxhash64(*[F.element_at("h", i + k) for k in range(SPAN)]).alias("w1"), F.xxhash64(F.lit(SPAN), *[F.element_at("h", i + k) for k in reversed(range(SPAN))]).alias("w2")))
    return hashed.where(n >= 1).select("doc_id", "th", F.explode(pairs).alias("w")).select("doc_id", "th", "w.*")


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, th, lines (sorted distinct positions to remove), of documents that lose some."""
    w = windows(docs)
    seen = w.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = materialize(seen, "lines-repeated")
    met = salted_join(w, seen.drop("n"), ["w1", "w2"], hot_keys(seen, ["w1", "w2"], "n"), ["doc_id", "th", "pos"])
    later = met.where(F.struct("doc_id", "th", "pos") != F.col("first")).select("doc_id", "th", "pos")
    return later.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("starts")).select("doc_id", "th", F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (SPAN - 1))))).alias("lines"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text (what is left)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), text.alias("text"))
    gone = covered(docs).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.map_from_arrays("lines", F.transform("lines", lambda x: F.lit(True))).alias("gone"))
    got = rows.join(gone, rows["doc_id"].eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    lines = F.split("text", "\n", -1)
    left = F.filter(lines, lambda x, i: F.element_at("gone", i).isNull())
    return got.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.map_keys("gone")), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
    )


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM d),
w AS (SELECT doc_id, p, l[p] AS a, l[p + 1] AS b, l[p + 2] AS c FROM x WHERE p + 2 <= len(l)),
r AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (VALUES (0), (1), (2)) t(o))
SELECT x.doc_id, count(*) AS n_lines, count(g.p) AS n_removed,
       sha256(coalesce(string_agg(x.l[x.p], chr(10) ORDER BY x.p) FILTER (WHERE g.p IS NULL), '')) AS text_sha256
FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id
"""
