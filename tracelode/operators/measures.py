"""Measures of retrieval and statistics of runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_measures(run: DataFrame, judged: DataFrame) -> DataFrame:
    """(qid, ndcg10, recall10, recall100, mrr10) of run (qid, id, rank) against judged (qid, id, grade > 0)."""
    hit = run.join(judged, ["qid", "id"]).groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= 10, F.col("grade") / F.log2(F.col("rank") + 1))).alias("gain"),
        F.count_if(F.col("rank") <= 10).alias("in10"), F.count_if(F.col("rank") <= 100).alias("in100"),
        F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"),
    )
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "id"))
    ideal = judged.withColumn("place", place).groupBy("qid").agg(F.sum(F.when(F.col("place") <= 10, F.col("grade") / F.log2(F.col("place") + 1))).alias("ideal"), F.count("*").alias("relevant"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(hit, "qid", "left").select(
        "qid", F.round(zero(F.col("gain") / F.col("ideal")), 6).alias("ndcg10"), F.round(zero(F.col("in10") / F.col("relevant")), 6).alias("recall10"),
        F.round(zero(F.col("in100") / F.col("relevant")), 6).alias("recall100"), F.round(zero(1 / F.col("first")), 6).alias("mrr10"),
    )


def auroc(scored: DataFrame) -> DataFrame:
    """One row: the chance that a positive scores above a negative, ties counting half; of (score, positive)."""
    return auroc_of_counts(scored.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n")))


def auroc_of_counts(by_score: DataFrame) -> DataFrame:
    """The same of (score, p, n), a row for each score with its positives and negatives.

    By counts of each score, running sums within a thousand ranges of scores, and those of the ranges before: no window
    holds all rows."""
    span = by_score.agg(F.min("score").alias("lo"), F.greatest(F.max("score") - F.min("score"), F.lit(1e-9)).alias("width"))
    ranged = by_score.join(F.broadcast(span)).withColumn("range", F.floor(1000 * (F.col("score") - F.col("lo")) / F.col("width")))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("range").agg(F.sum("n").alias("m")).select("range", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(within), F.lit(0)) + F.col("before")
    sums = ranged.join(before, "range").withColumn("below", below).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("wins"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(F.round(F.col("wins") / (F.col("p") * F.col("n")), 6).alias("auroc"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def chance(*parts: Column) -> Column:
    """A reproducible number in 0 … 1 for these values, by MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("bigint") / 4294967296.0


#: Cumulative chances of 0 to 5 events at a mean of one.
POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406)


def resample_weight(seed: Column, unit: Column) -> Column:
    """How often a unit is drawn in a resample: Poisson of mean one, which needs no numbering of the units."""
    u = chance(seed, unit)
    return sum((u >= p).cast("int") for p in POISSON[1:]) + (u >= POISSON[0]).cast("int")


def exact_interval(successes: int, trials: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson limits by bisection on the binomial tails."""

    def tail(p: float, low: bool) -> float:
        ks = range(successes, trials + 1) if low else range(successes + 1)
        return sum(math.exp(math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + (k * math.log(p) if k else 0) + ((trials - k) * math.log1p(-p) if k < trials else 0)) for k in ks)

    def limit(low: bool) -> float:
        a, b, alpha = 0.0, 1.0, (1 - level) / 2
        for _ in range(60):
            mid = (a + b) / 2
            if (tail(mid, low) < alpha) == low:
                a = mid
            else:
                b = mid
        return (a + b) / 2

    return (0.0 if successes == 0 else limit(True)), (1.0 if successes == trials else limit(False))
