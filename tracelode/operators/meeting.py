"""Sparse products of two tables that both grow: every query meets every document, and only what a query asks for goes on.

Documents are laid in parts of bounded size by the hash of their id, each query is sent to every part. A part's documents
are held by one task; the queries pass them a thousand at a time. Terms that many of both have are a matrix product, the
rest are laid out pair by pair. No pair of a query and a document is exchanged unless it is a result."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents and queries in one product; bytes of terms in a part; the share of a product's pairs from which a term is
#: multiplied with the others at once; pairs that are laid out at once; columns of one matrix product.
BLOCK, CHUNK, PART, SHARE, PAIRS, COLUMNS = 2_048, 1_024, 48_000_000, 1 / 128, 2_000_000, 512

_SCHEMA = "part int, kind int, id bigint, length int, keys array<bigint>, weights array<double>, marks array<int>, label string"


@dataclass
class Side:
    """Documents or queries by term: those with keys[i] are rows[ends[i] : ends[i + 1]], with their weights and marks."""

    ids: np.ndarray
    length: np.ndarray
    label: list[str | None]
    keys: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    marks: np.ndarray | None


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of arrays and their number in each row."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def _side(batch: pa.RecordBatch | pa.Table) -> Side:
    """A term that a row has more than once has the sum of its weights, which are one where none are given."""
    column = lambda name: c.combine_chunks() if isinstance(c := batch.column(name), pa.ChunkedArray) else c
    keys, sizes = _numbers(column("keys"))
    n = len(sizes)
    weights, marks = _numbers(column("weights"))[0], _numbers(column("marks"))[0]
    unique, at = np.unique(keys, return_inverse=True)
    code, first, back = np.unique(at * n + np.repeat(np.arange(n), sizes), return_index=True, return_inverse=True)
    weights = np.bincount(back, weights if len(weights) else None, len(code)).astype(np.float64)
    ends = np.searchsorted(code, np.arange(len(unique) + 1) * n)
    return Side(column("id").to_numpy(), column("length").to_numpy(zero_copy_only=False), column("label").to_pylist(), unique, ends, code % max(1, n), weights, marks[first] if len(marks) else None)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i] … begin[i] + size[i] - 1 for each i, in one array."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def _pairs(d: Side, q: Side, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in d and q of each meeting in the terms d.keys[i] = q.keys[j], some PAIRS at a time."""
    nd, nq = d.ends[i + 1] - d.ends[i], q.ends[j + 1] - q.ends[j]
    group = np.cumsum(nd * nq) // PAIRS
    for g in np.split(np.arange(len(i)), np.flatnonzero(np.diff(group)) + 1) if len(i) else []:
        own = _ranges(d.ends[i[g]], nd[g])
        times = np.repeat(nq[g], nd[g])
        yield np.repeat(own, times), _ranges(np.repeat(q.ends[j[g]], nd[g]), times)


def product(d: Side, q: Side, weights: np.ndarray) -> np.ndarray:
    """The sums of q's weights times these of d over their common terms, a row for each query. Above zero are those that
    have a common term, as all weights are."""
    n, m = len(q.ids), len(d.ids)
    _, i, j = np.intersect1d(d.keys, q.keys, assume_unique=True, return_indices=True)
    often = (d.ends[i + 1] - d.ends[i]) * (q.ends[j + 1] - q.ends[j]) >= SHARE * n * m
    out = np.zeros((n, m))
    for begin in range(0, int(often.sum()), COLUMNS):
        a, b = i[often][begin : begin + COLUMNS], j[often][begin : begin + COLUMNS]
        left, right = np.zeros((n, len(b))), np.zeros((len(a), m))
        nq, nd = q.ends[b + 1] - q.ends[b], d.ends[a + 1] - d.ends[a]
        at, of = _ranges(q.ends[b], nq), _ranges(d.ends[a], nd)
        left[q.rows[at], np.repeat(np.arange(len(b)), nq)] = q.weights[at]
        right[np.repeat(np.arange(len(a)), nd), d.rows[of]] = weights[of]
        out += left @ right
    for of, at in _pairs(d, q, i[~often], j[~often]):
        out += np.bincount(q.rows[at] * m + d.rows[of], q.weights[at] * weights[of], n * m).reshape(n, m)
    return out


def counts(d: Side, q: Side) -> np.ndarray:
    return product(d, q, d.weights)


def marked(d: Side, q: Side) -> np.ndarray:
    """The highest mark of a query's terms that the document has, 0 where there is none."""
    out = np.zeros((len(q.ids), len(d.ids)), np.int8)
    if q.marks is None:
        return out
    _, i, j = np.intersect1d(d.keys, q.keys, assume_unique=True, return_indices=True)
    mark = q.marks[q.ends[j]]
    for level in np.unique(mark[mark > 0]):
        for of, at in _pairs(d, q, i[mark == level], j[mark == level]):
            out[q.rows[at], d.rows[of]] = level
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves up; nothing here is below zero."""
    return np.floor(x * 1e6 + 0.5) / 1e6


Score = Callable[[Side, Side], np.ndarray]
Reduce = Callable[[Side, list[Side]], Iterator[pa.RecordBatch]]


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if c.dtype == object else None) for c in columns.values()], names=list(columns))


def every(q: Side, blocks: list[Side], score: Score, six: bool = False) -> Iterator[pa.RecordBatch]:
    """(qid, id, score) of all that meet, the score as it is or in six digits."""
    for d in blocks:
        s = score(d, q)
        for begin in range(0, len(q.ids), 128):
            i, j = np.nonzero(s[begin : begin + 128])
            x = s[begin + i, j]
            yield _rows(qid=q.ids[begin + i], id=d.ids[j], score=rounded(x) if six else x)


def best(q: Side, blocks: list[Side], score: Score, n: int, least: float, unmet: bool = False) -> Iterator[pa.RecordBatch]:
    """(qid, id, score) of each query's n best by rounded score, then by id, of those whose rounded score is at least
    this; unmet: also of those without a common term."""
    row, ids, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    last = np.full(len(q.ids), least)
    for d in blocks:
        s = score(d, q)
        if len(d.ids) > n:
            own = np.partition(s, len(d.ids) - n, axis=1)[:, len(d.ids) - n]
            i, j = np.nonzero(s >= np.maximum(own, last)[:, None] - 1e-6)
        else:
            i, j = np.nonzero(s >= last[:, None] - 1e-6)
        x = s[i, j]
        if not unmet:
            i, j, x = (v[x > 0] for v in (i, j, x))
        x = rounded(x)
        keep = x >= last[i]
        row, ids, found = np.concatenate([row, i[keep]]), np.concatenate([ids, d.ids[j[keep]]]), np.concatenate([found, x[keep]])
        order = np.lexsort((ids, -found, row))
        row, ids, found = row[order], ids[order], found[order]
        begin = np.searchsorted(row, np.arange(len(q.ids)))
        place = np.arange(len(row)) - begin[row]
        last[row[place == n - 1]] = found[place == n - 1]
        row, ids, found = (x[place < n] for x in (row, ids, found))
    yield _rows(qid=q.ids[row], id=ids, score=found)


def judged(q: Side, blocks: list[Side]) -> Iterator[pa.RecordBatch]:
    """(qid, id, grade) of the pairs that meet in a marked term."""
    for d in blocks:
        m = marked(d, q)
        i, j = np.nonzero(m)
        yield _rows(qid=q.ids[i], id=d.ids[j], grade=m[i, j].astype(np.int64))


def _reached(s: np.ndarray, least: float) -> np.ndarray:
    """How many scores of each row are at least this in six digits."""
    out = (s >= least + 1e-6).sum(axis=1)
    i, j = np.nonzero(np.abs(s - least) < 1e-6)
    return out + np.bincount(i[(rounded(s[i, j]) >= least) & (s[i, j] < least + 1e-6)], minlength=len(s))


def summary(q: Side, blocks: list[Side], score: Score, strong: float) -> Iterator[pa.RecordBatch]:
    """(qid, best, without, matched, strong): the best score of all, the best without the pairs that meet in a marked
    term, how many are above zero and how many at least `strong`; only of queries that meet a document."""
    n = len(q.ids)
    whole, without, positive, many = np.full(n, -1.0), np.full(n, -1.0), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in blocks:
        s = score(d, q)
        whole = np.maximum(whole, np.where(s > 0, s, -1.0).max(axis=1))
        positive += _reached(s, 1e-6)
        many += _reached(s, strong)
        if q.marks is not None:
            i, j = np.nonzero(marked(d, q))
            s[i, j] = 0.0
        without = np.maximum(without, np.where(s > 0, s, -1.0).max(axis=1))
    k = np.flatnonzero(whole > 0)
    none = without[k] <= 0
    yield pa.RecordBatch.from_arrays([pa.array(q.ids[k]), pa.array(rounded(whole[k])), pa.array(rounded(without[k]), mask=none), pa.array(positive[k]), pa.array(many[k])], names=["qid", "best", "without", "matched", "strong"])


def by_label(q: Side, blocks: list[Side], score: Score) -> Iterator[pa.RecordBatch]:
    """(qid, label, id, score, matches): for each query and label the best document and how many meet the query."""
    for d in blocks:
        s = score(d, q)
        names, at = np.unique(np.array(d.label, dtype=object).astype(str), return_inverse=True)
        for k, name in enumerate(names):
            own = np.flatnonzero(at == k)
            own = own[np.argsort(d.ids[own])]
            part = s[:, own]
            matches = (part > 0).sum(axis=1)
            top = part.max(axis=1)
            # the first by id of those whose rounded score is the best
            close = part >= top[:, None] - 1e-6
            i, j = np.nonzero(close & (part > 0))
            x = rounded(part[i, j])
            i, j, x = (v[x == rounded(top)[i]] for v in (i, j, x))
            rows, first = np.unique(i, return_index=True)
            yield _rows(qid=q.ids[rows], label=np.full(len(rows), name, dtype=object), id=d.ids[own[j[first]]], score=x[first], matches=matches[rows])


def judged_scores(q: Side, blocks: list[Side], score: Score) -> Iterator[pa.RecordBatch]:
    """(score, n) of the pairs that meet in a marked term, in six digits."""
    for d in blocks:
        x, n = np.unique(rounded(score(d, q)[np.nonzero(marked(d, q))]), return_counts=True)
        yield _rows(score=x, n=n)


def between(q: Side, blocks: list[Side], levels: np.ndarray, score: Score) -> Iterator[pa.RecordBatch]:
    """(score, n) of the other pairs that meet, by the levels: at one as they are, below one by half a digit less than
    the first that is above them, above all by one more than the last."""
    below = np.append(levels - 5e-7, levels[-1] + 1 if len(levels) else 0.0)
    for d in blocks:
        s = score(d, q)
        s[np.nonzero(marked(d, q))] = 0.0
        x = rounded(s[s > 0])
        at = np.searchsorted(levels, x)
        same = np.append(levels, np.inf)[at] == x
        for values, n in ((levels, np.bincount(at[same], minlength=len(levels))), (below, np.bincount(at[~same], minlength=len(below)))):
            yield _rows(score=values[n > 0], n=n[n > 0])


def _meet(batches: Iterator[pa.RecordBatch], reduce: Reduce) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    levels: list[np.ndarray] = []
    blocks: list[Side] | None = None
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        first, k = (int(x) for x in np.searchsorted(kinds, (0, 1)))
        if first:
            levels.append(_numbers(batch.column("weights").slice(0, first))[0])
        if k > first:
            held.append(batch.slice(first, k - first))
        if k == len(batch):
            continue
        if blocks is None:
            rows = pa.Table.from_batches(held) if held else None
            blocks = [_side(rows.slice(b, BLOCK)) for b in range(0, len(rows), BLOCK)] if held else []
            held, rows = [], None
            if levels:
                reduce = partial(reduce, levels=np.unique(np.concatenate(levels)))
        for begin in range(k, len(batch) if blocks else 0, CHUNK):
            yield from reduce(_side(batch.slice(begin, CHUNK)), blocks)


def met(documents: DataFrame, queries: DataFrame, terms: float, reduce: Reduce, schema: str, levels: DataFrame | None = None) -> DataFrame:
    """What `reduce` makes of every query and every part of the documents. documents: (id, length, keys and, where they
    are not to be counted, their weights, label); queries: (id, keys, weights, marks); terms: how many keys all documents
    have, about; levels: (weights), numbers that `reduce` gets in order. Rows of parts are to be put together by the caller."""
    context = documents.sparkSession.sparkContext
    parts = max(2 * context.defaultParallelism, math.ceil(8 * terms / PART))
    own = {"part": F.pmod(F.xxhash64("id"), F.lit(parts).cast("bigint")).cast("int"), "kind": F.lit(0)}
    sent = {"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "kind": F.lit(1)}
    both = _laid(documents, own).unionByName(_laid(queries, sent))
    if levels is not None:
        both = both.unionByName(_laid(levels, sent | {"kind": F.lit(-1)}))
    return both.repartitionById(parts, F.col("part")).sortWithinPartitions("kind").mapInArrow(partial(_meet, reduce=reduce), schema)


def _laid(df: DataFrame, own: dict[str, Column]) -> DataFrame:
    have = own | {c: F.col(c) for c in df.columns}
    return df.select(*[have[name].alias(name) if name in own else have.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (x.split(" ") for x in _SCHEMA.split(", "))])
