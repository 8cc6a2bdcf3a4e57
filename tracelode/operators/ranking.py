"""Ranked lists as long relations (qid, id, score): top n, normalisation, fusion, reranking, folding and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(scores: DataFrame, n: int, position: str = "id") -> DataFrame:
    """The n best of each query as (…, rank from 1); equal scores in order of position. −inf and NaN never come out."""
    finite = scores.where(~F.isnan("score") & (F.col("score") > F.lit(float("-inf"))))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), position)
    return finite.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def min_max(score: Column, *within: str) -> Column:
    """Scores scaled to 0 … 1 within each list; all equal gives 1."""
    w = Window.partitionBy(*within)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi == lo, 1.0).otherwise((score - lo) / (hi - lo))


def padded(lexical: DataFrame, queries: DataFrame, positions: DataFrame, n: int) -> DataFrame:
    """The sparse scores with zero for unmatched documents, as far as the top n can reach: the first n documents by
    position are enough, as a query with fewer than n matches leaves that many of them."""
    first = positions.where(F.col("position") <= n).select("id", "position")
    slots = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("position")).join(first, "position").select("qid", "id")
    zeros = slots.join(lexical.select("qid", "id"), ["qid", "id"], "left_anti").select("qid", "id", F.lit(0.0).alias("score"))
    return lexical.select("qid", "id", "score").unionByName(zeros)


def fuse_min_max(lexical: DataFrame, dense: DataFrame, rho: float = 0.5, n: int = 100) -> DataFrame:
    """(qid, id, fused, rank): each view's best n scaled over itself, then weighted and added; a document missing in a
    view adds nothing. The lexical view counts only if it matched at all. Equal sums stand in the order of the lexical
    list, then of the dense one."""
    a = top(lexical, n).withColumn("best", F.max("score").over(Window.partitionBy("qid"))).where("best > 0")
    a = a.select("qid", "id", (rho * min_max(F.col("score"), "qid")).alias("part"), F.col("rank").alias("a"), F.lit(None).cast("int").alias("b"))
    b = top(dense, n).select("qid", "id", ((1 - rho) * min_max(F.col("score"), "qid")).alias("part"), F.lit(None).cast("int").alias("a"), F.col("rank").alias("b"))
    summed = a.unionByName(b).groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("fused"), F.max("a").alias("a"), F.max("b").alias("b"))
    order = Window.partitionBy("qid").orderBy(F.desc("fused"), F.asc_nulls_last("a"), "b")
    return summed.withColumn("rank", F.row_number().over(order)).select("qid", "id", "fused", "rank")


def fuse_reciprocal(lists: DataFrame, k: int = 60) -> DataFrame:
    """(qid, id, fused, rank) of (qid, view, id, rank): the sum of 1 / (k + rank)."""
    summed = lists.groupBy("qid", "id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("fused"))
    return summed.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("fused"), "id")))


def reranked(ranked: DataFrame, scores: DataFrame, depth: int) -> DataFrame:
    """The first `depth` of each list by their new score, equal ones as they stood; the rest keeps its order and has no
    score."""
    head = ranked.join(scores.select("qid", "id", F.col("score").alias("new")), ["qid", "id"], "left")
    scored = head.withColumn("score", F.when(F.col("rank") <= depth, F.col("new")))
    order = Window.partitionBy("qid").orderBy((F.col("rank") > depth), F.desc_nulls_last("score"), "rank")
    return scored.withColumn("place", F.row_number().over(order)).select("qid", "id", "score", F.col("place").alias("rank"))


def fold_copies(ranked: DataFrame, same: DataFrame, depth: int = 30) -> DataFrame:
    """(qid, id, rank, leader): in order of rank each of the first `depth` joins the first kept entry that it is alike,
    else it is kept (and is its own leader). Greedy, not transitive; `same` has (qid, leader, follower) by rank order.

    The state is the array of kept ids, folded over at most `depth` entries of one list."""
    pairs = same.groupBy("qid", "follower").agg(F.collect_set("leader").alias("near"))
    rows = ranked.where(F.col("rank") <= depth).join(pairs.select("qid", F.col("follower").alias("id"), "near"), ["qid", "id"], "left")
    entries = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", F.coalesce("near", F.array().cast("array<bigint>")).alias("near")))).alias("list"))
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.array().cast("array<struct<id:bigint,rank:int,leader:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        leader = F.filter(acc["kept"], lambda k: F.array_contains(x["near"], k))
        own = F.size(leader) == 0
        row = F.struct(x["id"].alias("id"), x["rank"].alias("rank"), F.when(own, x["id"]).otherwise(F.get(leader, 0)).alias("leader"))
        return F.struct(F.when(own, F.concat(acc["kept"], F.array(x["id"]))).otherwise(acc["kept"]).alias("kept"), F.concat(acc["out"], F.array(row)).alias("out"))

    return entries.select("qid", F.explode(F.aggregate("list", start, step)["out"]).alias("e")).select("qid", "e.id", "e.rank", "e.leader")


def page(ranked: DataFrame, number: int, size: int) -> DataFrame:
    return ranked.where(F.col("rank").between((number - 1) * size + 1, number * size))


def unit_interval(scores: DataFrame) -> DataFrame:
    """Scores as chances: where a list has one outside 0 … 1, the logistic function of all of them."""
    outside = F.max(F.when((F.col("score") < 0) | (F.col("score") > 1), 1).otherwise(0)).over(Window.partitionBy("qid"))
    return scores.withColumn("score", F.when(outside == 1, 1 / (1 + F.exp(-F.col("score")))).otherwise(F.col("score")))
