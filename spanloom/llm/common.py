"""What the training-data operators share: word splitting and session settings; scratch storage is in sources."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from spanloom.sources.scratch import discard, materialize, scratch, shared_dir  # noqa: F401

#: Words are the runs between ASCII white space; Java's and Python's regex read this alike.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; null counts as empty. All-ASCII texts take the quick function."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's text, modulo mod."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(0))


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, but what its task has freed goes back to the system at the end: workers live on between tasks and stages."""

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task


def map_texts(rows: DataFrame, run: Callable[[list[str]], list[list]], fields: str, at_once: int = 512) -> DataFrame:
    """rows' columns but the last, a text, as they are, and the columns `fields` that run makes of the texts (null: empty).

    No shuffle. Rows go to run `at_once` at a time; the other columns never leave Arrow, so no value is changed.
    """
    import pyarrow as pa

    made = StructType.fromDDL(fields)
    kinds = [to_arrow_type(f.dataType) for f in made.fields]
    names = [*rows.columns[:-1], *made.names]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, at_once):
                part = b.slice(at, at_once)
                got = run([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, got, kinds)], names)

    return rows.mapInArrow(released(task), StructType(rows.schema.fields[:-1] + made.fields))


#: A key is hot if it holds more than one in HOT of the weight, so there are fewer than HOT hot keys, however large
#: the table; rows of a hot key are dealt over SALTS tasks.
HOT, SALTS = 1000, 64


def hot_keys(weights: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Fewer than HOT keys: those with more than one in HOT of the weight. weights: a row per key, materialized."""
    total = weights.agg(F.sum(weight)).first()[0] or 0
    return weights.where(F.col(weight) * HOT > total).select(*keys)


def salted_join(rows: DataFrame, each: DataFrame, keys: list[str], hot: DataFrame, by: list[str]) -> DataFrame:
    """rows join each (a row per key) on keys. Rows of the hot keys are dealt over tasks by the hash of the columns
    `by`, and each's row is copied to all."""
    mark = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    dealt = rows.join(mark, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(F.lit(17), *by), F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = each.join(mark, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")
