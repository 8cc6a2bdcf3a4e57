"""A BM25 index on disk: postings laid out by term, so that a search reads the parts of its own words alone.

Terms fall into BUCKETS folders by hash; a folder is written by SPREAD tasks, so that the postings of one word that a
third of all texts have are several files; within a file rows are sorted by term, so that row groups are skipped by
their least and greatest term. Document frequencies and the two figures of the collection are tables beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators import lexical

BUCKETS, SPREAD = 64, 4


def _bucket(term: str = "term") -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(tokens: DataFrame, path: str) -> None:
    """Writes the index of (id, tokens): one exchange of the postings, already counted in their scan's tasks."""
    rows = lexical.postings(tokens).withColumn("bucket", _bucket())
    laid = rows.repartition(BUCKETS * SPREAD, "bucket", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "id")
    laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = tokens.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("bucket", "term").agg(F.count("*").alias("df")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    lexical.statistics(tokens).write.mode("overwrite").parquet(f"{path}/statistics")


def scored(spark: SparkSession, path: str, queries: DataFrame) -> lexical.Scored:
    """What lexical.against makes of (qid, tokens) and of what was indexed."""
    asked = lexical.terms(queries, "qid").groupBy("qid", "term").agg(F.count("*").alias("times")).withColumn("bucket", _bucket())
    # at most BUCKETS numbers: the folders to open
    wanted = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
    postings, terms = (spark.read.parquet(f"{path}/{x}").where(F.col("bucket").isin(wanted)) for x in ("postings", "terms"))
    n, avgdl = spark.read.parquet(f"{path}/statistics").first()
    weighed = asked.join(terms, ["bucket", "term"])
    hits = postings.join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
    word = F.struct(F.xxhash64("term").alias("key"), F.col("tf").cast("double").alias("tf"))
    documents = hits.groupBy("id").agg(F.first("dl").alias("length"), F.collect_list(word).alias("w")).select("id", "length", F.col("w.key").alias("keys"), F.col("w.tf").alias("weights"))
    return lexical.Scored(documents, lexical.weighed(weighed, n), avgdl or 1.0, n * (avgdl or 1.0))


def search(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(qid, id, score) of (qid, tokens), equal to lexical.scores of what was indexed."""
    return scored(spark, path, queries).every()
