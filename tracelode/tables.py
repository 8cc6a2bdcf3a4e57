"""Reading the Parquet tables of an input directory, and cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table as written; columns are pruned and filters pushed down by the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is named and driver and executors are one process, a private
    one that goes with it; on a cluster a folder must be named, as one machine's own is lost with the machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tracelode-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the plan's result is written to the shared folder and read from there afterwards."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like cut, as a Parquet table in the same folder: for many narrow rows, which a checkpoint keeps uncompressed."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The same rows on more tasks, where a scan has fewer than half as many as there are cores: one small file is one
    task. On inputs of many files this does nothing. For scans alone, before costly work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df
