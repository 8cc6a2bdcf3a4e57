"""Incremental ingest as a stream of files: parse, chunk, and bring a stored table of chunks up to date.

The reference result is the batch rebuild: after every batch the table equals what a rebuild over the newest version of
each path would give. Paths fall into BUCKETS by hash, and a batch writes only the buckets that its paths are of, as a new
folder; what buckets a folder holds is appended to a list of versions once it is whole, so a lost executor or a
stopped stream leaves the last whole state, and a batch that comes twice changes nothing. `vacuum` removes what no state
needs any more."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelode.operators.chunking import chunks

FILES = "path string, version bigint, text string"
CHUNKS = "path string, version bigint, ordinal int, section string, `start` int, `end` int, text string"


def chunk_table(files: DataFrame) -> DataFrame:
    """Chunks of (path, version, text); a null text removes the path."""
    newest = files.groupBy("path").agg(F.max_by(F.struct("version", "text"), "version").alias("x")).select("path", "x.version", "x.text")
    keyed = newest.withColumn("id", F.xxhash64("path"))
    return chunks(keyed.select("id", "text")).join(keyed.select("id", "path", "version"), "id").select("path", "version", "ordinal", "section", "start", "end", "text")


BUCKETS = 64
_VERSIONS = "version bigint, epoch bigint, bucket int, rows bigint"


def _bucket() -> F.Column:
    return F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _newest(spark: SparkSession, table: str) -> dict[int, tuple[int, int]]:
    """(version, rows) of each bucket's newest state: at most BUCKETS rows. Only a list that is not there means none; any
    other failure to read it is an error."""
    if not _exists(spark, f"{table}/versions"):
        return {}
    rows = spark.read.schema(_VERSIONS).parquet(f"{table}/versions").groupBy("bucket").agg(F.max(F.struct("version", "rows")).alias("x"))
    return {r["bucket"]: (r["x"]["version"], r["x"]["rows"]) for r in rows.collect()}


def current(spark: SparkSession, table: str, buckets: list[int] | None = None) -> DataFrame:
    """The newest whole state of a table of chunks, or of some of its buckets; empty before the first."""
    newest = _newest(spark, table)
    folders = [f"{table}/v={version}/bucket={b}" for b, (version, rows) in sorted(newest.items()) if rows and (buckets is None or b in buckets)]
    return spark.read.schema(CHUNKS).parquet(*folders) if folders else spark.createDataFrame([], CHUNKS)


def apply(table: str, batch: DataFrame, epoch: int) -> None:
    """One batch: chunks of paths that it has a newer version of are replaced, all others stay."""
    spark = batch.sparkSession
    touched = sorted(r["bucket"] for r in batch.where("path is not null").select(_bucket().alias("bucket")).distinct().collect())
    if not touched:
        return
    old = current(spark, table, touched)
    known = old.groupBy("path").agg(F.max("version").alias("known"))
    newer = batch.where("path is not null").join(known, "path", "left").where("known is null or version >= known").select("path", "version", "text")
    merged = old.join(newer.select("path").distinct(), "path", "left_anti").unionByName(chunk_table(newer))
    version = time.time_ns()
    merged.withColumn("bucket", _bucket()).write.partitionBy("bucket").parquet(f"{table}/v={version}")
    held = spark.read.schema(f"{CHUNKS}, bucket int").parquet(f"{table}/v={version}").groupBy("bucket").count().collect()
    counts = {r["bucket"]: r["count"] for r in held}
    spark.createDataFrame([(version, epoch, b, counts.get(b, 0)) for b in touched], _VERSIONS).coalesce(1).write.mode("append").parquet(f"{table}/versions")


def vacuum(spark: SparkSession, table: str) -> list[int]:
    """Removes the folders of versions that are no bucket's newest state, and gives them. Not while a batch is written."""
    kept = {version for version, _ in _newest(spark, table).values()}
    every = [r["version"] for r in spark.read.schema(_VERSIONS).parquet(f"{table}/versions").select("version").distinct().collect()] if kept else []
    gone = sorted(set(every) - kept)
    for version in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v={version}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return gone


def start(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """A stream over JSON files of (path, version, text)."""
    files = spark.readStream.schema(FILES).json(folder)
    return files.writeStream.foreachBatch(lambda batch, epoch: apply(table, batch, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
