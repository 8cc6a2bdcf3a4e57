"""Ranked lists against judged passages, by overlapping places, and two runs against each other."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators.measures import resample_weight

#: Lines of a block: an interval join's equal part is the file and a block, so that one long file is spread.
LINES = 200


def blocks(start: str = "start", end: str = "end") -> Column:
    s, e = F.col(start), F.greatest(F.col(start), F.col(end))
    return F.explode(F.sequence(F.floor(s / LINES), F.floor(e / LINES)))


def reached(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """(qid, place, passage) of ranked (qid, place, file, unit, start, end), several rows for one place where copies were
    folded into it, and judged (qid, passage, file, unit, start, end): each passage of the same query that a place's lines
    meet, once."""
    a = ranked.select("qid", "place", "file", "unit", "start", "end").distinct().withColumn("block", blocks())
    b = judged.select("qid", "passage", "file", "unit", F.col("start").alias("js"), F.col("end").alias("je")).distinct().withColumn("block", blocks("js", "je"))
    return a.join(b, ["qid", "file", "unit", "block"]).where("start <= je and js <= end").select("qid", "place", "passage").distinct()


def gold_scores(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg, recall3, recall10, recall30, unjudged) of every query with a passage graded above zero. Judged has also
    (grade, group): passages of one group are copies of each other, credited once, to the first place that reaches
    one, with their best grade; of several groups first reached at one place the best counts. Recall is over groups
    that hold a passage of grade 2, null without one; unjudged is the share of the first k that reach no passage."""
    meets = reached(ranked, judged).join(judged.select("qid", "passage", "group").distinct(), ["qid", "passage"])
    groups = judged.groupBy("qid", "group").agg(F.max("grade").alias("best"))
    ideal = groups.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("best"), "group"))).where(F.col("n") <= k)
    ideal = ideal.groupBy("qid").agg(F.sum(F.col("best") / F.log2(F.col("n") + 1)).alias("ideal")).where("ideal > 0")
    first = meets.groupBy("qid", "group").agg(F.min("place").alias("place")).join(groups, ["qid", "group"])
    gain = first.where(F.col("place") <= k).groupBy("qid", "place").agg(F.max("best").alias("best")).groupBy("qid").agg(F.sum(F.col("best") / F.log2(F.col("place") + 1)).alias("gain"))
    answers = groups.where("best = 2").join(first.select("qid", "group", "place"), ["qid", "group"], "left").groupBy("qid").agg(*[F.avg(F.coalesce((F.col("place") <= n).cast("double"), F.lit(0.0))).alias(f"recall{n}") for n in (3, 10, 30)])
    shown = ranked.where(F.col("place") <= k).select("qid", "place").distinct().join(meets.select("qid", "place", F.lit(1).alias("met")).distinct(), ["qid", "place"], "left")
    unjudged = shown.groupBy("qid").agg(F.avg(F.col("met").isNull().cast("double")).alias("unjudged"))
    rows = ideal.join(gain, "qid", "left").join(answers, "qid", "left").join(unjudged, "qid", "left")
    return rows.select("qid", (F.coalesce("gain", F.lit(0.0)) / F.col("ideal")).alias("ndcg"), "recall3", "recall10", "recall30", F.coalesce("unjudged", F.lit(0.0)).alias("unjudged"))


def paired(runs: DataFrame, resamples: int = 10_000) -> DataFrame:
    """(mean, low, high, wins, ties, losses) of (qid, new, old): the differences' mean, its 95 % interval over paired
    resamples, each question drawn with its difference, and how many questions won, tied (within 1e-9) and lost.

    A resample is a sum of weighted differences, so resamples are aggregated before they are exchanged."""
    d = runs.select("qid", (F.col("new") - F.col("old")).alias("d"))
    drawn = d.select("qid", "d", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).withColumn("w", resample_weight(F.col("b"), F.col("qid")))
    means = drawn.groupBy("b").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m"))
    interval = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    counts = d.agg(F.avg("d").alias("mean"), F.count_if(F.col("d") > 1e-9).alias("wins"), F.count_if(F.abs("d") <= 1e-9).alias("ties"), F.count_if(F.col("d") < -1e-9).alias("losses"))
    # both sides are one row
    return counts.join(F.broadcast(interval)).select("mean", "low", "high", "wins", "ties", "losses")


def quote_span(text: str, quote: str) -> tuple[int, int] | None:
    """The first and last line, from 1, of the smallest run of lines that holds the quote, blanks and case apart: the one
    that ends first, and of those the one that begins last. None where no run does."""
    plain = [" ".join(line.lower().split()) for line in text.split("\n")]
    wanted = " ".join(quote.lower().split())
    if not wanted:
        return None
    joined = " ".join(x for x in plain if x)
    at = joined.find(wanted)
    if at < 0:
        return None
    # where each line that is not blank begins and ends in the joined text
    spans, pos = [], 0
    for n, x in enumerate(plain, 1):
        if x:
            spans.append((pos, pos + len(x), n))
            pos += len(x) + 1
    # the earliest end over all places; at that end the latest beginning
    last = next(n for b, e, n in spans if e >= at + len(wanted))
    stop = next(e for b, e, n in spans if n == last)
    first = joined.rfind(wanted, 0, stop)
    return next(n for b, e, n in reversed(spans) if b <= first), last


def located(pairs: DataFrame) -> DataFrame:
    """(quote, source_key, first_line, last_line) of (quote, source_key, text): where each quote stands in the text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = [quote_span(t, q) if t is not None else None for q, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s and s[0] for s in spots], pa.int32()), pa.array([s and s[1] for s in spots], pa.int32())], names=["quote", "source_key", "first_line", "last_line"])

    return pairs.select("quote", "source_key", "text").mapInArrow(found, "quote string, source_key bigint, first_line int, last_line int")
