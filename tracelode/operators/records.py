"""Records of several sources made one: keys, merging over shared keys, and the order of first appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.text import col
from tracelode.operators.linkage import components


def doi_key(value: Column | str) -> Column:
    """A DOI without its resolver's address, in lower case."""
    return F.lower(F.regexp_replace(F.trim(F.coalesce(col(value), F.lit(""))), r"(?i)^https?://(?:dx\.)?doi\.org/", ""))


def arxiv_key(value: Column | str) -> Column:
    """An arXiv id at the end of a value, without its version; empty where there is none."""
    return F.regexp_extract(F.trim(F.coalesce(col(value), F.lit(""))), r"([0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})(?:v[0-9]+)?$", 1)


def title_key(value: Column | str) -> Column:
    """A title whatever its case and punctuation."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(value), F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def merged(records: DataFrame, keys: DataFrame) -> DataFrame:
    """One row for each record of records (id, source, rank, kind, title, text, origin, known): records that share a key,
    also by way of others, are one, kept where the first of them stands when the sources are read in turns (by rank, then
    source). Its kind is the first that is no preprint, else the first; title, text and origin are the first that there
    are; known if any is; found_by are its sources in order. Keys are (id, key). Groups are aggregates, never lists."""
    groups = components(keys)
    rows = records.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    turn = F.struct("rank", "source", "id")
    first = lambda c, when: F.min_by(c, F.when(when, turn))
    filled = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    published = filled("kind") & ~F.coalesce(F.col("kind").startswith("preprint"), F.lit(False))
    sources = rows.groupBy("component", "source").agg(F.min("rank").alias("rank"))
    found = sources.groupBy("component").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]), ",").alias("found_by"))
    out = rows.groupBy("component").agg(
        F.min(turn).alias("at"), F.count("*").alias("records"), F.coalesce(first("kind", published), first("kind", filled("kind"))).alias("kind"),
        *[first(c, filled(c)).alias(c) for c in ("title", "text", "origin")], F.bool_or(F.coalesce("known", F.lit(False))).alias("known"),
    )
    return out.join(found, "component").select(F.col("at.id").alias("id"), F.col("at.rank").alias("rank"), F.col("at.source").alias("source"), "records", "kind", "title", "text", "origin", "known", "found_by")
