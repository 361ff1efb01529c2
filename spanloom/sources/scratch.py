"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and all run here."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="spanloom-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


_OWN: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of this application's that goes when its driver ends."""
    own = f"{shared_dir(spark)}/spanloom/{spark.sparkContext.applicationId}"
    if own not in _OWN:
        fs, path = _hadoop(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _OWN.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes materialized tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "scratch_path", None):
            fs, p = _hadoop(t.sparkSession, path)
            fs.delete(p, True)
