"""The queries of this package. None has an SQL counterpart that could run on whole tables: each is tested against a
brute-force version, a round trip or held-out cases in tests/llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode import tables
from tracelode.llm import credentials, leaks, looks, near_copies, neighbours, pieces, sentences, shared_spans, tokens

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The whole table, on as many tasks as there are cores even if it is one small file."""
    return tables.spread(tables.table(spark, d, name))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.near_copy_pairs(table(spark, d, "chunks"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each chunk with a text: its class of equal normalised texts and the class's links to other texts."""
    links, members = near_copies.near_copy_links(table(spark, d, "chunks"))
    counts = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(counts, "rep", "left").select("id", "rep", F.coalesce("links", F.lit(0)).alias("links"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each chunk with a text: the least id of its group of near-copies, and how many texts are its own."""
    return near_copies.near_copy_groups(table(spark, d, "chunks"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.records(table(spark, d, "answers"), table(spark, d, "sources"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    spans = shared_spans.merged(shared_spans.shared(_records(spark, d)))
    return spans.select(shared_spans.named("rec").alias("rec"), F.col("first").cast("bigint").alias("span_start"), F.col("last").cast("bigint").alias("span_end"))


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """For each record with a text: how many of its characters stand in another record, and one place for each span."""
    spans = shared_spans.shared(_records(spark, d))
    covered = shared_spans.merged(spans).groupBy("rec").agg(F.sum(F.col("last") - F.col("first")).alias("shared_chars"), F.count("*").alias("spans"))
    lengths = _records(spark, d).where("text is not null").groupBy("rec").agg(F.length(F.min("text")).alias("chars"))
    return lengths.join(covered, "rec", "left").select(shared_spans.named("rec").alias("rec"), "chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("spans", F.lit(0)).alias("spans"))


def p2_origins(spark: SparkSession, d: str) -> DataFrame:
    """For each answer the sources that passages of it stand in word for word, cited or not."""
    spans = shared_spans.shared(_records(spark, d)).where("rec % 2 = 0 and other % 2 = 1")
    return spans.select(shared_spans.named("rec").alias("rec"), F.col("first").alias("span_start"), F.col("last").alias("span_end"), shared_spans.named("other").alias("origin"), F.col("other_first").alias("origin_start")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credential_lines(credentials.fields(table(spark, d, "chunks"), table(spark, d, "files")))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text and reason with its credentials blanked."""
    return credentials.redact(credentials.fields(table(spark, d, "chunks"), table(spark, d, "files")))


def p3_withheld(spark: SparkSession, d: str) -> DataFrame:
    """For each file the credentials found in its chunks, against what an older check counted."""
    found = credentials.redact(table(spark, d, "chunks").select(F.lit("chunks.text").alias("field"), F.col("path").alias("rec"), "text").distinct())
    counts = found.groupBy(F.col("rec").alias("path")).agg(F.sum("withheld").alias("found"))
    files = table(spark, d, "files").select("path", "withheld").distinct()
    return files.join(counts, "path", "left").select("path", "withheld", F.coalesce("found", F.lit(0)).alias("found"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.section_starts(table(spark, d, "chunks"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "chunks"))


def _two_fields(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    return [
        ("chunks.text", table(spark, d, "chunks").select("id", "text")),
        ("retained-unicode.text", table(spark, d, "retained_unicode").select(F.col("record_id").alias("id"), "text")),
    ]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    (a, x), (b, y) = _two_fields(spark, d)
    return looks.look_alike_pairs(x).select(F.lit(a).alias("field"), "*").unionByName(looks.look_alike_pairs(y).select(F.lit(b).alias("field"), "*"))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text of both tables in its consistent form."""
    (a, x), (b, y) = _two_fields(spark, d)
    return looks.forms(x).select(F.lit(a).alias("field"), "*").unionByName(looks.forms(y).select(F.lit(b).alias("field"), "*"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "vectors"))


def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest, however far, of every id divisible by 100, at a recall of 0.95."""
    return neighbours.neighbour_ids(table(spark, d, "vectors"), recall=0.95, every=100)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """What does not come back as it was: a count of the documents whose ids decode to another text."""
    documents = table(spark, d, "documents")
    back = tokens.decode(tokens.encode(documents)).withColumnRenamed("text", "back")
    pairs = documents.select("doc_id", "text").join(back, "doc_id")
    return pairs.agg(F.count("*").alias("documents"), F.count_if(F.coalesce("text", F.lit("")) != F.col("back")).alias("changed"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    """Also reordered and partly changed passages, with how much of the item's they hold."""
    return leaks.matches(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_ends(table(spark, d, "documents"))


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence with its text."""
    return sentences.sentences(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_classes, p1_groups, p2_found, p2_shares, p2_origins, p3_found, p3_redacted, p3_withheld, p4_found, p4_pieces, p5_found, p5_forms, p6_found, p6_nearest, p7_ids, p7_decoded, p8_found, p8_matches, p9_found, p9_sentences)}


def oracle_sql() -> dict[str, str]:
    return {}
