"""Conversation logs: turns, scopes, budgets, evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turns(answers: DataFrame) -> DataFrame:
    """Answers once each, numbered within their session by time."""
    rows = answers.dropDuplicates(["answer_id"])
    return running(rows, "session_id", ["asked_at", "answer_id"], F.lit(1), "turn", F.to_date("asked_at"))


def running(rows: DataFrame, key: str, order: list[str], value: Column, name: str, block: Column) -> DataFrame:
    """Running sums of a value along `order` within each key, in two steps: within blocks of the order, and over the
    sums of the blocks before. A session that holds a third of all rows is spread over its blocks. `block` must rise
    with the order."""
    marked = rows.withColumns({"_block": block, "_value": value})
    earlier = Window.partitionBy(key).orderBy(F.asc_nulls_first("_block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy(key, "_block").agg(F.sum("_value").alias("_sum"))
    before = sums.select(F.col(key).alias("_key"), F.col("_block").alias("_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = F.sum("_value").over(Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = marked.withColumn("_within", within).join(before, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_of")))
    return joined.withColumn(name, F.col("_before") + F.col("_within")).drop("_block", "_value", "_key", "_of", "_before", "_within")


def cumulative_sets(rows: DataFrame, key: str, order: str, values: str) -> DataFrame:
    """(key, order, value) of everything seen up to each place, by a first-seen join instead of growing arrays: a value
    belongs to a place if it was first seen at or before it."""
    first = rows.select(key, order, F.explode(values).alias("value")).groupBy(key, "value").agg(F.min(order).alias("since"))
    return rows.select(key, order).join(first, key).where(F.col("since") <= F.col(order)).select(key, order, "value")


def fair_share(sizes: Column, budget: int) -> Column:
    """What each entry of an array of sizes may keep of a budget: shortest first, what is left over is shared."""
    ordered = F.sort_array(sizes)
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        share = F.floor(acc["left"] / (F.size(ordered) - F.size(acc["out"]))).cast("bigint")
        given = F.least(x, share)
        return F.struct((acc["left"] - given).alias("left"), F.concat(acc["out"], F.array(given)).alias("out"))

    return F.aggregate(ordered, start, step)["out"]


def islands(rows: DataFrame, key: str, order: str, same: Column) -> DataFrame:
    """Runs of neighbouring rows for which `same` holds from one to the next, numbered."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("starts").over(w)).drop("starts")


_CITE = r"\[(?:[NW][0-9]+)(?:\s*,\s*[NW][0-9]+)*\]"
_CLOSED = "[*\"'”’)]*"
#: A sentence with what ends it: citations after its mark belong to it.
_SENTENCE = rf"(?s)(.*?(?:[.!?。]{_CLOSED}(?:\s*{_CITE}\s*)+{_CLOSED}[.!?。]?|[.!?。]{_CLOSED}(?=\s)|\n+|\z))"


def citation_counts(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """For each answer (answer_id, text): its sentences; those with a citation; those of them whose cited sources, put
    together, hold the whole sentence; citations; and the citations of supported sentences that are needed: not those
    whose source does not hold the sentence while the others do without it. Sources are (answer_id, source_id, text)."""
    flat = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    texts = sources.groupBy("answer_id", "source_id").agg(F.min("text").alias("text")).where("source_id is not null and text is not null")
    texts = texts.groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("source_id", flat("text")))).alias("held"))
    parts = F.filter(F.regexp_extract_all("text", F.lit(_SENTENCE), F.lit(1)), lambda x: x.rlike(r"(?U)\S"))
    rows = answers.where("text is not null").select("answer_id", F.explode_outer(parts).alias("sentence")).join(texts, "answer_id", "left")
    groups = F.regexp_extract_all("sentence", F.lit(rf"({_CITE})"), F.lit(1))
    ids = F.flatten(F.transform(groups, lambda g: F.split(F.regexp_replace(g, r"[\[\]\s]", ""), ",")))
    bare = F.regexp_replace(F.regexp_replace("sentence", _CITE, ""), "[*_#>`\"“”]", "")
    bare = F.regexp_replace(flat(bare), r"[\s.!?。]+$", "")
    rows = rows.select("answer_id", "sentence", ids.alias("ids"), bare.alias("bare"), "held")
    rows = rows.withColumn("theirs", F.transform("ids", lambda i: F.col("held")[i]))
    known = (F.col("bare") != "") & F.forall("theirs", lambda t: t.isNotNull())
    rows = rows.withColumn("holds", (F.size("ids") > 0) & F.coalesce(known & F.array_join("theirs", " ").contains(F.col("bare")), F.lit(False)))
    places = F.sequence(F.lit(0), F.size("ids") - 1)
    rest = lambda k: F.array_join(F.filter("theirs", lambda t, j: j != k), " ")
    needed = F.filter(places, lambda k: (F.size("ids") == 1) | F.get("theirs", k).contains(F.col("bare")) | ~rest(k).contains(F.col("bare")))
    return rows.groupBy("answer_id").agg(
        F.count("sentence").alias("sentences"),
        F.count_if(F.size("ids") > 0).alias("cited"),
        F.count_if("holds").alias("supported"),
        F.coalesce(F.sum(F.greatest(F.size("ids"), F.lit(0))), F.lit(0)).alias("citations"),
        F.coalesce(F.sum(F.when(F.col("holds"), F.size(needed))), F.lit(0)).alias("needed"),
    )


_CITED = re.compile(r"\[([NW]\d+(?:\s*,\s*[NW]\d+)*)\]")
# What a quote is (one line without citations, 12 to 300 characters), and how far after it a citation may be.
_QUOTED = re.compile(r"[\"“]([^\"”\[\]\n]{12,300})[\"”]")
QUOTE_REACH = 80


def _cited_quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(answer_id, quote, source_ids) for each quote with citations right after it, and one row (null, all cited ids)."""
    for batch in batches:
        rows: list[tuple] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            groups = [(m.start(), [x.strip() for x in m[1].split(",")]) for m in _CITED.finditer(text)]
            rows.append((key, None, [i for _, ids in groups for i in ids]))
            for m in _QUOTED.finditer(text):
                rows.append((key, m[1], [i for at, ids in groups if 0 <= at - m.end() <= QUOTE_REACH for i in ids]))
        kinds = (pa.int64(), pa.string(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["answer_id", "quote", "ids"])


def quote_check(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, uncited, unsupported) of (answer_id, text) and (answer_id, source_id, known, text): whether an answer with
    sources cites nothing, and its quotes that no source cited right after them holds, case and blanks apart, in order of
    their text. A quote whose citations name no source of the answer is not judged."""
    quotes = answers.where("text is not null").select("answer_id", "text").mapInArrow(_cited_quotes, "answer_id bigint, quote string, ids array<string>")
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    held = sources.select("answer_id", "source_id", "text").distinct()
    met = quotes.where("quote is not null").select("answer_id", "quote", F.explode("ids").alias("source_id")).distinct().join(held, ["answer_id", "source_id"])
    found = met.groupBy("answer_id", "quote").agg(F.bool_or(F.coalesce(plain(F.col("text")).contains(plain(F.col("quote"))), F.lit(False))).alias("found"))
    wrong = found.where("not found").groupBy("answer_id").agg(F.sort_array(F.collect_set("quote")).alias("unsupported"))
    some = sources.groupBy("answer_id").agg(F.lit(True).alias("some"))
    rows = quotes.where("quote is null").join(some, "answer_id", "left").join(wrong, "answer_id", "left")
    return rows.select("answer_id", ((F.size("ids") == 0) & F.coalesce("some", F.lit(False))).alias("uncited"), F.coalesce("unsupported", F.array().cast("array<string>")).alias("unsupported"))
