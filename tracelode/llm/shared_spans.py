"""Problem 2: long exact spans shared between records, by a compacted de Bruijn graph over sampled k-mers.

Tokens are cut by content: of every window of `span` characters the k-mer (half as long) of least hash is an anchor, so
equal text has equal anchors wherever it stands and in whatever script. Anchors are the nodes of the graph, the text
from one anchor to the end of the next is the edge between them. Nodes and edges found in one record alone are dropped.
A path is compacted where it does not branch: where a node and the edges on both its sides occur equally often, so all
records that have one have all. A compacted path of `span` characters is shared as a whole.

Only the windows that hold a repeated anchor and do not lie inside such a path are compared one by one, by hash; at
last every span is held against the text of the record that it is shared with, by coordinates.

Every exchange is an aggregate (counts, least and greatest place) or a join of occurrences with such an aggregate, whose
keys are unique: a passage that a third of all records have is never collected.

Defined cases: null texts, null keys and texts below `span` characters have no spans; a passage repeated within one record alone
is not shared; repeated rows count once, of several texts under one key the least is taken; touching or overlapping
spans are one. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm.arrays import BASE, U64, bundles, gram_hashes, mix, points
from tracelode.tables import written

SPAN = 100
BUDGET = 1_000_000


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the text that each belongs to, and where each text begins."""
    lengths = np.array([len(t) for t in texts], np.int64)
    return points("".join(texts)), np.repeat(np.arange(len(texts)), lengths), np.concatenate(([0], np.cumsum(lengths)[:-1]))


def anchors(texts: list[str], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, node, edge, position of the next anchor or −1) of every anchor, in order."""
    k = span // 2
    cp, owner, begin = _flat(texts)
    if len(cp) < span:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, U64, U64, np.int64))
    h = gram_hashes(cp, k)
    wide = np.lib.stride_tricks.sliding_window_view(h, span - k + 1)
    least = wide.argmin(axis=1) + np.arange(len(wide))
    inside = owner[: len(wide)] == owner[span - 1 : span - 1 + len(wide)]
    at = np.unique(least[inside])
    text = owner[at]
    after = np.append(at[1:], -1)
    joined = np.append(text[1:] == text[:-1], False) if len(at) else np.empty(0, bool)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(len(cp), BASE))))
        back = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(len(cp), U64(_inverse(int(BASE)))))))
        total = np.concatenate(([U64(0)], np.cumsum((cp.astype(U64) + U64(1)) * power[:-1], dtype=U64)))
        stop = np.where(joined, after + k, at)
        edge = mix((total[stop] - total[at]) * back[at] + (stop - at).astype(U64))
    return text, at - begin[text], h[at], edge, np.where(joined, after - begin[text], -1)


_ANCHORS = "rec bigint, pos int, node bigint, edge bigint, next int"


def _anchored(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for part in bundles([len(t) for t in texts], BUDGET):
            text, pos, node, edge, after = anchors(texts[part], span)
            has = after >= 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[part][text], pa.int64()), pa.array(pos.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(edge.view(np.int64), mask=~has), pa.array(after.astype(np.int32), mask=~has)], names=["rec", "pos", "node", "edge", "next"]
            )


def _windows(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows that hold a repeated anchor and do not lie inside a compacted path."""
    k = span // 2
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        marks, paths = batch.column(2), batch.column(3)
        for part in bundles([len(t) for t in texts], BUDGET):
            own = texts[part]
            cp, owner, begin = _flat(own)
            if len(cp) < span:
                continue
            edge = np.zeros(len(cp) + span + 1, np.int32)
            n = marks[part.start : part.stop]
            at = n.flatten().to_numpy(zero_copy_only=False) + np.repeat(begin, n.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            np.add.at(edge, np.maximum(at - (span - k), 0), 1)
            np.add.at(edge, at + 1, -1)
            wanted = np.cumsum(edge)[: len(cp)] > 0
            edge[:] = 0
            p = paths[part.start : part.stop]
            lengths = p.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            inner = p.flatten()
            if len(inner):
                s = inner.field(0).to_numpy(zero_copy_only=False) + np.repeat(begin, lengths)
                e = inner.field(1).to_numpy(zero_copy_only=False) + np.repeat(begin, lengths)
                some = e - span > s + 1
                np.add.at(edge, s[some] + 1, 1)
                np.add.at(edge, e[some] - span, -1)
                wanted &= np.cumsum(edge)[: len(cp)] == 0
            h = gram_hashes(cp, span)
            i = np.flatnonzero(wanted[: len(h)] & (owner[: len(h)] == owner[span - 1 : span - 1 + len(h)]))
            yield pa.RecordBatch.from_arrays([pa.array(h[i].view(np.int64)), pa.array(ids[part][owner[i]], pa.int64()), pa.array((i - begin[owner[i]]).astype(np.int32))], names=["h", "rec", "i"])


def _other(lo: str, hi: str) -> tuple[F.Column, F.Column]:
    """The record and place that a span of `rec` is shared with: the least, or the greatest where that is its own."""
    own = F.col(f"{lo}.rec") == F.col("rec")
    return F.when(own, F.col(f"{hi}.rec")).otherwise(F.col(f"{lo}.rec")), F.when(own, F.col(f"{hi}.at")).otherwise(F.col(f"{lo}.at"))


def shared(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """Of (rec bigint, text): verified stretches (rec, first, last, other, other_first), of at least `span` characters,
    that stand word for word in the record `other`; stretches may overlap."""
    k = span // 2
    texts = texts.where((F.length("text") >= span) & F.col("rec").isNotNull()).groupBy("rec").agg(F.min("text").alias("text"))
    texts = written(texts)
    all_anchors = written(texts.mapInArrow(partial(_anchored, span=span), _ANCHORS))
    nodes = all_anchors.groupBy("node").agg(F.count("*").alias("n"), F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo <> hi").select("node", "n")
    repeated = written(all_anchors.join(nodes, "node"))
    spot = F.struct("rec", F.col("pos").alias("at"))
    edges = repeated.where("edge is not null").groupBy("edge").agg(F.count("*").alias("times"), F.min(spot).alias("lo"), F.max(spot).alias("hi")).where("lo.rec <> hi.rec")
    along = Window.partitionBy("rec").orderBy("pos")
    goes_on = (F.lag("next").over(along) == F.col("pos")) & (F.lag("times").over(along) == F.col("times")) & (F.col("n") == F.col("times"))
    steps = repeated.join(edges, "edge").withColumn("starts", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("path", F.sum("starts").over(along))
    other, place = _other("lo", "hi")
    paths = (
        steps.withColumns({"other": other, "place": place})
        .groupBy("rec", "path")
        .agg(F.min("pos").alias("first"), (F.max("next") + k).alias("last"), F.min_by(F.struct("other", "place"), "pos").alias("o"))
        .where(F.col("last") - F.col("first") >= span)
        .select("rec", "first", "last", F.col("o.other").alias("other"), F.col("o.place").alias("other_first"))
    )
    paths = written(paths)
    marks = repeated.groupBy("rec").agg(F.collect_list("pos").alias("marks"))
    inside = paths.groupBy("rec").agg(F.collect_list(F.struct("first", "last")).alias("paths"))
    windows = written(texts.join(marks, "rec").join(inside, "rec", "left").select("rec", "text", "marks", "paths").mapInArrow(partial(_windows, span=span), "h bigint, rec bigint, i int"))
    spot = F.struct("rec", F.col("i").alias("at"))
    met = windows.groupBy("h").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi")).where("lo.rec <> hi.rec")
    along = Window.partitionBy("rec").orderBy("i")
    found = windows.join(met, "h").select("rec", "i", other.alias("other"), place.alias("place"))
    same = (F.col("i") - F.lag("i").over(along) == 1) & (F.col("other") == F.lag("other").over(along)) & (F.col("place") - F.lag("place").over(along) == 1)
    runs = (
        found.withColumn("starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
        .withColumn("run", F.sum("starts").over(along))
        .groupBy("rec", "run")
        .agg(F.min("i").alias("first"), (F.max("i") + span).alias("last"), F.min_by(F.struct("other", "place"), "i").alias("o"))
        .select("rec", "first", "last", F.col("o.other").alias("other"), F.col("o.place").alias("other_first"))
    )
    both = paths.unionByName(runs)
    mine = both.join(texts, "rec").select(*both.columns, F.expr("substring(text, first + 1, last - first)").alias("mine"))
    theirs = texts.select(F.col("rec").alias("other"), F.col("text").alias("other_text"))
    return mine.join(theirs, "other").where("mine = substring(other_text, other_first + 1, last - first)").select("rec", "first", "last", "other", "other_first")


def merged(stretches: DataFrame) -> DataFrame:
    """(rec, first, last) with touching and overlapping stretches made one."""
    before = Window.partitionBy("rec").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("rec").orderBy("first", "last")
    starts = F.when(F.col("first") <= F.max("last").over(before), 0).otherwise(1)
    return stretches.select("rec", "first", "last").withColumn("starts", starts).withColumn("run", F.sum("starts").over(order)).groupBy("rec", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("rec", "first", "last")


def records(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(rec bigint, text) of both tables: even numbers are answers, odd ones sources."""
    return answers.select((F.col("answer_id") * 2).alias("rec"), "text").unionByName(sources.select((F.col("source_key") * 2 + 1).alias("rec"), "text"))


def named(rec: str) -> F.Column:
    """The record's name: A and the answer's id, or S and the source's key."""
    return F.expr(f"concat(if(pmod({rec}, 2) = 0, 'A', 'S'), cast(({rec} - pmod({rec}, 2)) / 2 as bigint))")
