"""Exact deduplication as a stateful stream with disk-backed keyed state.

A staged projection of the rows (digest of the normalised text, its length, doc_id, locator) is streamed through a
keyed aggregation whose state is in RocksDB and never expires: per digest the stable identifier that stays (largest
doc_id), the locator of its content and the number of rows. What the state says is a hit is then checked byte by
byte against the row that stays; should texts of one digest differ, each text gets a group of its own.

Rows of a digest that is common meet their group in many tasks: hot digests (fewer than a thousand, so they can be
broadcast) are salted. The stream goes on where it stopped: state and progress are in the shared folder. Map-side partial aggregation
happens within each micro-batch, so a group of a third of all rows reaches the state as one row per task.

Defined results: texts are equal when identical after lower-casing A-Z; a null text counts as empty and equals empty
ones. Rows that share doc_id and text: one of them stays, by the smaller locator. A null doc_id is below all others.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import ascii_lower, hot_keys, materialize, salted_join, scratch

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store reserves MBs for its manifest
    "spark.sql.streaming.metricsEnabled": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(docs: DataFrame, path: str) -> None:
    """Appends the rows' digests to path, where a stream finds them. The locator tells rows of one doc_id apart."""
    text = ascii_lower(F.col("text"))
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("norm"), F.monotonically_increasing_id().alias("locator")).select(
        "doc_id", "locator", F.sha2("norm", 256).alias("digest"), F.octet_length("norm").cast("long").alias("size")
    ).write.mode("append").parquet(path)


def consume(spark: SparkSession, path: str, state: str, out: str, files_per_batch: int | None = None) -> None:
    """Streams what is new below path through the state; each micro-batch's changed groups go to out/batch=N."""
    rows = spark.readStream.schema("doc_id long, locator long, digest string, size long")
    if files_per_batch:
        rows = rows.option("maxFilesPerTrigger", files_per_batch)
    groups = rows.parquet(path).groupBy("digest").agg(F.max(F.struct("doc_id", (-F.col("locator")).alias("at"))).alias("first"), F.count("*").alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("digest", F.col("first.doc_id").alias("keep_id"), (-F.col("first.at")).alias("keep_at"), "n").write.mode("overwrite").parquet(f"{out}/batch={number}")

    with settings(spark, STATE):
        query = groups.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()


def groups(spark: SparkSession, out: str) -> DataFrame:
    """The state's last word on each digest."""
    every = spark.read.schema("digest string, keep_id long, keep_at long, n long, batch int").option("basePath", out).parquet(f"{out}/batch=*")
    return every.groupBy("digest").agg(F.max(F.struct("batch", "keep_id", "keep_at", "n")).alias("s")).select("digest", "s.keep_id", "s.keep_at", "s.n")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and locator, a row per row of docs."""
    spark = docs.sparkSession
    path, state, out = (scratch(spark, f"dedup-{x}") for x in ("staged", "state", "groups"))
    stage(docs, path)
    staged = spark.read.schema("doc_id long, locator long, digest string, size long").parquet(path)
    if staged.isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    consume(spark, path, state, out)
    last = materialize(groups(spark, out), "dedup-last")
    hot = hot_keys(last.where("n > 1"), ["digest"], "n")
    # written, as several places below read them: one plan of all would hold this join a dozen times, on the driver
    rows = materialize(salted_join(staged, last, ["digest"], hot, ["locator"]), "dedup-rows")

    # Hits are checked byte by byte. The text is fetched for rows of groups of two and more alone.
    hits = rows.where("n > 1")
    text = ascii_lower(F.col("text"))
    bodies = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("norm"), F.sha2(text, 256).alias("key"))
    stays = hits.where("doc_id <=> keep_id and locator = keep_at").select("digest", F.col("doc_id").alias("id"))
    texts = bodies.join(hits.select(F.col("digest").alias("key"), F.col("doc_id").alias("id")).distinct(), ["key", "id"], "left_semi")
    kept_text = texts.join(stays.withColumnRenamed("digest", "key"), ["key", "id"]).groupBy("key").agg(F.max("norm").alias("kept"))
    other = salted_join(texts, kept_text, ["key"], hot.toDF("key"), ["id"]).where(F.col("norm") != F.col("kept")).select("key", "id", "norm")
    other = materialize(other, "dedup-other")
    odd = other.groupBy("key", "norm").agg(F.max("id").alias("other_id"), F.count("*").alias("other_n"))
    odd = other.join(odd, ["key", "norm"]).select(F.col("key").alias("digest"), F.col("id").alias("doc_id"), "other_id", "other_n").distinct()
    lost = odd.groupBy("digest").agg(F.sum(F.lit(1)).alias("lost"))
    out_rows = rows.join(odd, ["digest", "doc_id"], "left").join(lost, "digest", "left")
    return out_rows.select(
        "doc_id",
        F.coalesce("other_id", "keep_id").alias("keep_id"),
        F.coalesce("other_n", F.col("n") - F.coalesce("lost", F.lit(0))).alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("other_id"), F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("keep_at"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, result: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns, whatever their names.

    They are told from the result in several places of one plan, so it is written first: the join behind it runs once.
    """
    result = materialize(result, "dedup-result")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    told = result.groupBy(F.col("doc_id").alias("of")).agg(F.max("kept").alias("any"), F.count("*").alias("n")).where("not any or n > 1")
    marked = rows.join(told, F.col("id").eqNullSafe(F.col("of")), "left")
    plain = marked.where("any is null").select("row")
    # ids that several rows share: one row of each text that stays
    shared = marked.where("any and n > 1").select("row", "id", F.sha2(ascii_lower(F.col("row.text")), 256).alias("sha"))
    kept = result.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    shared = shared.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    one = shared.groupBy("id", "sha").agg(F.first("row").alias("row")).select("row")
    return plain.unionByName(one).select("row.*")


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
