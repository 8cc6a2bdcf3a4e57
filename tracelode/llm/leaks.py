"""Problem 8: evaluation passages in a corpus, by latent semantic retrieval, common subsequences and run checks.

Texts are lower-cased and stripped to letters and digits. Terms are character 8-grams: of every WINDOW neighbouring ones
the one of least hash, so equal stretches have equal terms whatever stands around them and in whatever script. Corpus
passages are two neighbouring blocks of BLOCK characters, item passages have ITEM characters, and every common run of 60
characters lies whole in some passage of either side.

1. One pass cuts the corpus into the items' terms, places and document counts: a table of small integers, and all that
   the steps before the last read.
2. The TF-IDF rows of the item passages, weighed by the corpus' counts, are factored by randomised SVD in groups of RANK
   neighbouring passages, each group in a task of its own. A group has no more passages than factors, so its factors
   hold every passage whole and products in the latent space are those of the passages themselves.
3. Each corpus passage is projected into each group's latent space and searched against its item passages. For a run
   the wanted product is the least that any 60 characters of the item passage contribute; for alike passages it is a
   cosine of CLOSE. Passages that reach neither even with the highest value that any item passage has of each of
   their terms are left out before.
4. Candidates are held against the texts: runs of 60 by hash and then by character, and passages alike by the longest
   common subsequence and the item's answer tokens (its numbers and names).

A run's terms are chosen by windows that lie wholly in it, so both sides have them whatever stands around, and weights
are not negative: no pair with a run is below the wanted product.

Items are taken in blocks of at most LETTERS characters, longer ones in overlapping parts, each block with its own pass
over the texts, and groups in lists of at most ROWS factor rows, each with its own pass over the table. So all that is
sent has a bound: of a block at most LETTERS terms (24 bytes) and runs (16 bytes), and ROWS x RANK numbers.

Defined cases: null and empty texts, null ids, and items below 60 letters and digits match nothing; repeated rows count once; an
item text under several ids matches for each. Extra columns are not read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.arrays import U64, bundles, gram_hashes, points
from tracelode.llm.sieve import sieved
from tracelode.tables import written

RUN = 60
GRAM, WINDOW = 8, 8
BLOCK, ITEM, STEP = 60, 200, 100
RANK = 256
LETTERS = 1_000_000
#: Rows of factors that are sent at once: 50 MB.
ROWS = 50_000
SIEVE = 22
BUDGET = 500_000
#: Blocks of one row of the table of terms.
STRETCH = 1 << 15
_PIECE = 4_096
#: From this cosine on a passage is held against the item's by longest common subsequence; both from these shares on
#: make a reordered or partly changed copy.
CLOSE, SUBSEQUENCE, ANSWERS = 0.3, 0.7, 0.5


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point its lower case, or 0 if it is neither letter nor digit."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if c.isalnum():
            low = [x for x in c.lower() if x.isalnum()]
            out[code] = ord(low[0]) if low else code
    return out


def stripped(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters and digits of all texts in one array, and the length that each text has there."""
    cp = letter_table()[points("".join(texts))]
    ends = np.cumsum([len(t) for t in texts])
    kept = cp != 0
    total = np.concatenate(([0], np.cumsum(kept)))
    return cp[kept], np.diff(np.concatenate(([0], total[ends])))


def _begins(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)


def _chosen(h: np.ndarray) -> np.ndarray:
    """For every window of WINDOW neighbouring grams the place of the one that counts: the first of least hash."""
    best, at = h.copy(), np.arange(len(h), dtype=np.int32)
    width = 1
    while width < WINDOW:  # least of 2, 4, 8 neighbours
        left, right = best[:-width], best[width:]
        later = right < left
        at = np.where(later, at[width:], at[:-width])
        best = np.where(later, right, left)
        width *= 2
    return at


def terms(cp: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position in its text) of the terms that count."""
    h = gram_hashes(cp, GRAM)
    if len(h) < WINDOW:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = _chosen(h)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    reach = GRAM + WINDOW - 1
    inside = owner[: len(at)] == owner[reach - 1 : reach - 1 + len(at)]
    at = at[inside]
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    return h[at], owner[at], at - (ends - lengths)[owner[at]]


def slot_table(hashes: np.ndarray) -> np.ndarray:
    """Open addressing: for each slot the number of the term there plus one, at most half of the slots being taken. For
    sorted, different hashes; by their low bits, as terms are those of small hashes."""
    table = np.zeros(1 << max(4, int(2 * len(hashes)).bit_length()), np.int32)
    place = (hashes & U64(len(table) - 1)).astype(np.int64)
    todo = np.arange(len(hashes))
    while len(todo):
        free = table[place[todo]] == 0
        first = todo[free]
        # of terms that want one slot, the last written stays
        table[place[first]] = first + 1
        lost = table[place[todo]] != todo + 1
        todo = todo[lost]
        place[todo] = (place[todo] + 1) & (len(table) - 1)
    return table


def _lookup(table: np.ndarray, hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The numbers of the terms with these hashes, −1 for others."""
    out = np.full(len(h), -1, np.int64)
    place = (h & U64(len(table) - 1)).astype(np.int64)
    at = np.flatnonzero(table[place])
    while len(at):
        term = table[place[at]]
        hit = hashes[term - 1] == h[at]
        out[at[hit]] = term[hit] - 1
        at = at[~hit]
        place[at] = (place[at] + 1) & (len(table) - 1)
        at = at[table[place[at]] != 0]
    return out


@dataclass
class Runs:
    """Hashes of all runs of the items, sorted, with their parts and places; the stripped parts; a sieve by hash."""

    hashes: np.ndarray
    parts: np.ndarray
    places: np.ndarray
    texts: list[np.ndarray]
    sieve: np.ndarray


@dataclass
class Items:
    """The item side: parts of items with their ids; terms; passages as sparse rows (passage, term, count); runs. With
    the corpus counted: weights of terms, that of an unknown one, and the least product of a run in each passage."""

    ids: np.ndarray
    texts: list[str]
    hashes: np.ndarray
    slots: np.ndarray
    rows: np.ndarray
    cols: np.ndarray
    counts: np.ndarray
    part_of: np.ndarray
    place_of: np.ndarray
    runs: Runs
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    rest: float = 0.0
    wanted: np.ndarray = field(default_factory=lambda: np.empty(0))
    norms: np.ndarray = field(default_factory=lambda: np.empty(0))
    tops: np.ndarray = field(default_factory=lambda: np.empty(0))

    def weigh(self, df: np.ndarray, total: int) -> None:
        """Takes in the counts of the corpus: of each term, and of all documents."""
        self.weights = np.log((total + 1) / (np.minimum(df, total) + 1)) + 1
        self.rest = float(np.log(total + 1) + 1)
        self.wanted = _least_products(self)
        value = self.values()
        self.norms = np.sqrt(np.bincount(self.rows, value**2, minlength=len(self.part_of)))
        self.tops = np.zeros(len(self.hashes))
        np.maximum.at(self.tops, self.cols, value)

    def least(self, whole: np.ndarray, passages: slice = slice(None)) -> np.ndarray:
        """The least product that is wanted, of a run or by cosine, of a row with this whole energy and any of these item
        passages; a part in a thousand less, for single precision."""
        return np.minimum(self.wanted[passages].min(), CLOSE * np.sqrt(whole) * self.norms[passages].min()) * (1 - 1e-3)

    def values(self) -> np.ndarray:
        return self.counts * self.weights[self.cols]


def item_parts(items: list[tuple[int, str]]) -> tuple[np.ndarray, list[str]]:
    """Items as parts of at most half a block; neighbouring parts overlap by more than a passage."""
    ids, texts = [], []
    most, over = LETTERS // 2, 4 * ITEM
    for i, t in items:
        for begin in range(0, max(1, len(t) - over), most - over):
            ids.append(i)
            texts.append(t[begin : begin + most])
    return np.array(ids, np.int64), texts


def indexed(items: list[tuple[int, str]]) -> Items | None:
    """The item side before the corpus is counted; None where no item has a term."""
    ids, texts = item_parts(items)
    cp, lengths = stripped(texts)
    h, part, at = terms(cp, lengths)
    if not len(h):
        return None
    hashes, term = np.unique(h, return_inverse=True)
    # a term lies in the passages that begin in its own step and in the one before
    own = np.concatenate((part << 32 | at // STEP, (part << 32 | (at // STEP - 1))[at >= STEP]))
    cols = np.concatenate((term, term[at >= STEP]))
    passages, rows = np.unique(own, return_inverse=True)
    cell, counts = np.unique(rows * len(hashes) + cols, return_counts=True)
    begin = _begins(lengths)
    run = gram_hashes(cp, RUN)
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = np.flatnonzero(owner[: len(run)] == owner[RUN - 1 : RUN - 1 + len(run)])
    inside = inside[np.argsort(run[inside], kind="stable")]
    sieve = np.zeros(1 << SIEVE, bool)
    sieve[run[inside] >> U64(64 - SIEVE)] = True
    runs = Runs(run[inside], owner[inside].astype(np.int32), (inside - begin[owner[inside]]).astype(np.int32), [cp[b : b + n] for b, n in zip(begin, lengths)], sieve)
    return Items(ids, texts, hashes, slot_table(hashes), cell // len(hashes), cell % len(hashes), counts, passages >> 32, passages & 0xFFFFFFFF, runs)


def _least_products(items: Items) -> np.ndarray:
    """For each item passage the least that the terms of one of its runs add to a product: terms chosen by windows that
    lie wholly in the run, which any text with the run has too. Infinite where no run begins."""
    out = np.full(len(items.part_of), np.inf)
    number = {(int(p), int(k)): n for n, (p, k) in enumerate(zip(items.part_of, items.place_of))}
    inner = RUN - GRAM + 1 - WINDOW  # windows in a run, less one
    for part, cp in enumerate(items.runs.texts):
        h = gram_hashes(cp, GRAM)
        if len(cp) < RUN:
            continue
        at = _chosen(h)
        weight = items.weights[_lookup(items.slots, items.hashes, h[at])] ** 2
        new = np.concatenate(([True], at[1:] != at[:-1]))
        total = np.concatenate(([0.0], np.cumsum(np.where(new, weight, 0.0))))
        starts = np.arange(len(cp) - RUN + 1)
        least = weight[starts] + total[starts + inner + 1] - total[starts + 1]
        for k in range(-(-len(starts) // STEP)):
            if (part, k) in number:
                out[number[part, k]] = least[k * STEP : (k + 1) * STEP].min()
    return out


_TABLE = "doc_id bigint, first bigint, size int, place binary, term binary, other binary"


def _tabled(batches: Iterator[pa.RecordBatch], slots: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each document with a known term, in stretches of blocks: the block (16 bits) and number (32 bits) of each known
    term, and how many others each block has (8 bits)."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[tuple] = []
        for part in bundles([len(t) for t in texts], BUDGET):
            cp, lengths = stripped(texts[part])
            h, text, at = terms(cp, lengths)
            term = _lookup(slots, hashes, h)
            block = at // BLOCK
            edges = np.searchsorted(text, np.arange(len(lengths) + 1))
            with_known = np.unique(text[term >= 0])
            for t in with_known.tolist():
                own = slice(edges[t], edges[t + 1])
                b, n = block[own], term[own]
                blocks = int(-(-lengths[t] // BLOCK))
                for first in range(0, blocks, STRETCH):
                    # stretches overlap by a block, which is the second of the last passage
                    size = min(STRETCH + 1, blocks - first)
                    mine = (b >= first) & (b < first + size)
                    known = mine & (n >= 0)
                    if known.any():
                        others = np.bincount(b[mine & (n < 0)] - first, minlength=size).astype(np.uint8)
                        out.append((ids[part.start + t], first, size, (b[known] - first).astype(np.uint16).tobytes(), n[known].astype(np.int32).tobytes(), others.tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "first", "size", "place", "term", "other"])


def _counted(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Stretches with each term."""
    total = np.zeros(n, np.int64)
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            total[np.unique(np.frombuffer(blob, np.int32))] += 1
    for begin in range(0, n, _PIECE):
        yield pa.RecordBatch.from_arrays([pa.array([begin], pa.int32()), pa.array([total[begin : begin + _PIECE].tobytes()], pa.binary())], names=["piece", "cells"])


def _sum(table: pa.Table, kind: type) -> pa.Table:
    cells = np.sum([np.frombuffer(x, kind) for x in table.column("cells").to_pylist()], axis=0, dtype=kind)
    return pa.table({"piece": table.column("piece")[:1], "cells": pa.array([cells.tobytes()], pa.binary())})


def _summed(rows: DataFrame, kind: type) -> np.ndarray:
    """Pieces of (piece, cells) summed over all tasks, in order."""

    def add(pieces: pa.Table) -> pa.Table:
        return _sum(pieces, kind)

    got = rows.groupBy("piece").applyInArrow(add, "piece int, cells binary").collect()
    return np.concatenate([np.frombuffer(r["cells"], kind) for r in sorted(got, key=lambda r: r["piece"])]) if got else np.empty(0, kind)


def _passages(row: dict, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(passage, term) of the known terms of a stretch, each passage being two blocks, all terms' energy in each passage,
    unknown ones with it, and how many passages there are."""
    size = row["size"]
    block, term = np.frombuffer(row["place"], np.uint16).astype(np.int64), np.frombuffer(row["term"], np.int32)
    other = np.frombuffer(row["other"], np.uint8) * items.rest**2
    n = max(1, size - 1)
    energy = other[:n].copy()
    energy[: size - 1] += other[1:size]
    left, right = block < n, block > 0
    return np.concatenate((block[left], block[right] - 1)), np.concatenate((term[left], term[right])), energy, n


def _matrix(rows: list[dict], items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse TF-IDF rows (row, term, value), sorted by row, of the passages that may reach a wanted product: with the
    highest value that any item passage has of each of their terms. Each row's stretch, passage and whole energy."""
    parts, owners, places, wholes = [], [], [], []
    base = 0
    for r, row in enumerate(rows):
        at, term, other, n = _passages(row, items)
        cell, count = np.unique(at * len(items.hashes) + term, return_counts=True)
        at, term = cell // len(items.hashes), cell % len(items.hashes)
        value = count * items.weights[term]
        whole = np.bincount(at, value**2, minlength=n) + other
        kept = np.bincount(at, value * items.tops[term], minlength=n) >= items.least(whole)
        if kept.any():
            number = np.cumsum(kept) - 1 + base
            mine = kept[at]
            parts.append((number[at[mine]], term[mine], value[mine]))
            chosen = np.flatnonzero(kept)
            owners.append(np.full(len(chosen), r))
            places.append(chosen + row["first"])
            wholes.append(whole[chosen])
            base += len(chosen)
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.float64, np.int64, np.int64, np.float64))
    return (*(np.concatenate(z) for z in zip(*parts)), np.concatenate(owners), np.concatenate(places), np.concatenate(wholes))


def _projected(row: np.ndarray, column: np.ndarray, value: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Sparse rows, sorted, times the transpose of `factors` (a row for each dimension): a column for each row."""
    edges = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1)) if len(row) else np.empty(0, np.int64)
    out = np.zeros((len(factors), len(edges)), np.float32)
    value = value.astype(np.float32)
    for begin in range(0, len(edges), 1_000):
        e = edges[begin : begin + 1_000]
        stop = edges[begin + 1_000] if begin + 1_000 < len(edges) else len(row)
        part = np.take(factors, column[e[0] : stop], axis=1)
        part *= value[e[0] : stop]
        out[:, begin : begin + 1_000] = np.add.reduceat(part, e - e[0], axis=1)
    return out


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    for batch in batches:
        for begin in range(0, len(batch), 256):
            yield batch.slice(begin, 256).to_pylist()


def randomised_svd(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int], rank: int, seed: int = 11) -> np.ndarray:
    """Right singular vectors (shape[1] x rank) of a sparse matrix: a random range of the rows, sharpened by two power
    iterations, and an exact SVD inside it."""
    order = np.argsort(rows, kind="stable")
    rows, cols, values = rows[order], cols[order], values[order].astype(np.float32)
    starts = np.searchsorted(rows, np.arange(shape[0]))
    by_col = np.argsort(cols, kind="stable")
    col_rows, col_values = rows[by_col], values[by_col]
    col_starts = np.searchsorted(cols[by_col], np.arange(shape[1]))

    def times(x: np.ndarray) -> np.ndarray:
        out = np.zeros((shape[0], x.shape[1]), np.float32)
        full = np.flatnonzero(np.diff(np.append(starts, len(rows))))
        for part in np.array_split(full, max(1, len(rows) // 20_000)):
            if len(part):
                b, e = starts[part[0]], np.append(starts, len(rows))[part[-1] + 1]
                out[part] = np.add.reduceat(values[b:e, None] * x[cols[b:e]], starts[part] - b, axis=0)
        return out

    def turned(y: np.ndarray) -> np.ndarray:
        out = np.zeros((shape[1], y.shape[1]), np.float32)
        full = np.flatnonzero(np.diff(np.append(col_starts, len(cols))))
        for part in np.array_split(full, max(1, len(cols) // 20_000)):
            if len(part):
                b, e = col_starts[part[0]], np.append(col_starts, len(cols))[part[-1] + 1]
                out[part] = np.add.reduceat(col_values[b:e, None] * y[col_rows[b:e]], col_starts[part] - b, axis=0)
        return out

    rank = min(rank, *shape)
    width = min(rank + 16, *shape)
    q = np.linalg.qr(times(np.random.default_rng(seed).standard_normal((shape[1], width)).astype(np.float32)))[0]
    for _ in range(2):
        q = np.linalg.qr(times(np.linalg.qr(turned(q))[0]))[0]
    b = turned(q)  # the transpose of what the range makes of the matrix
    u, _, _ = np.linalg.svd(b, full_matrices=False)
    return np.ascontiguousarray(u[:, :rank])


@dataclass
class Group:
    """The factors of at most RANK neighbouring item passages: their terms, a column of the factors for each, and the
    latent vectors of the passages."""

    first: int
    terms: np.ndarray
    factors: np.ndarray
    vectors: np.ndarray


def _factored(table: pa.Table) -> pa.Table:
    """Of the passages (group, passage, terms, values) of one group: its terms, factors and latent vectors."""
    order = np.argsort(table.column("passage").to_numpy())
    cols = [np.frombuffer(table.column("terms")[int(i)].as_py(), np.int32) for i in order]
    values = np.concatenate([np.frombuffer(table.column("values")[int(i)].as_py(), np.float64) for i in order])
    rows = np.repeat(np.arange(len(order)), [len(c) for c in cols])
    own, col = np.unique(np.concatenate(cols), return_inverse=True)
    factors = np.ascontiguousarray(randomised_svd(rows, col, values, (len(order), len(own)), RANK).T)
    vectors = np.ascontiguousarray(_projected(rows, col, values, factors).T)
    return pa.table({"group": table.column("group")[:1], "terms": pa.array([own.astype(np.int32).tobytes()], pa.binary()), "factors": pa.array([factors.tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary())})


def factored(spark: SparkSession, items: Items) -> Iterator[list[Group]]:
    """The groups of the item passages, each factored in a task of its own, in lists of at most ROWS factor rows."""
    value = items.values()
    edges = np.searchsorted(items.rows, np.arange(len(items.part_of) + 1))
    rows = [(i // RANK, i, items.cols[a:b].astype(np.int32).tobytes(), value[a:b].astype(np.float64).tobytes()) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
    passages = spark.createDataFrame(rows, "group int, passage int, terms binary, values binary")
    done = written(passages.groupBy("group").applyInArrow(_factored, "group int, terms binary, factors binary, vectors binary"))
    some: list[Group] = []
    for r in done.orderBy("group").toLocalIterator():
        own = np.frombuffer(r["terms"], np.int32)
        n = min(RANK, len(items.part_of) - r["group"] * RANK)
        group = Group(r["group"] * RANK, own, np.frombuffer(r["factors"], np.float32).reshape(-1, len(own)), np.frombuffer(r["vectors"], np.float32).reshape(n, -1))
        if some and sum(len(g.terms) for g in some) + len(own) > ROWS:
            yield some
            some = []
        some.append(group)
    if some:
        yield some


def _latent_pairs(row: np.ndarray, term: np.ndarray, value: np.ndarray, whole: np.ndarray, items: Items, groups: list[Group]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item passage, cosine) of all pairs whose product reaches the wanted one of a run or the cosine CLOSE."""
    out = []
    size = np.sqrt(whole)
    for group in groups:
        local = np.full(len(items.hashes), -1, np.int32)
        local[group.terms] = np.arange(len(group.terms), dtype=np.int32)
        which = local[term]
        mine = which >= 0
        own = slice(group.first, group.first + len(group.vectors))
        able = np.bincount(row[mine], value[mine] * items.tops[term[mine]], minlength=len(whole)) >= items.least(whole, own)
        mine &= able[row]
        if not mine.any():
            continue
        rows, at = np.unique(row[mine], return_inverse=True)
        x = _projected(at, which[mine], value[mine], group.factors)
        for begin in range(0, len(rows), 2_000):
            r = rows[begin : begin + 2_000]
            dot = (group.vectors @ x[:, begin : begin + 2_000]).T
            i, j = np.nonzero((dot >= items.wanted[own] * (1 - 1e-3)) | (dot >= CLOSE * (1 - 1e-3) * size[r, None] * items.norms[own]))
            out.append((r[i], j + group.first, dot[i, j] / (size[r[i]] * items.norms[own][j])))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


_CANDIDATES = "doc_id bigint, parts array<int>, alike array<struct<part:int,block:bigint,passage:int,cosine:double>>"


def _searched(batches: Iterator[pa.RecordBatch], items: Items, groups: list[Group]) -> Iterator[pa.RecordBatch]:
    """For each stretch with candidates: the item parts of which it may hold a run, and the nearest passage pair of each
    part with a cosine of at least CLOSE."""
    for rows in _stretches(batches):
        row, term, value, owner, place, whole = _matrix(rows, items)
        i, j, cosine = _latent_pairs(row, term, value, whole, items, groups)
        found: dict[int, set[int]] = {}
        close: dict[int, dict[int, tuple[float, int, int]]] = {}
        for o, p, k, q, c in zip(owner[i].tolist(), items.part_of[j].tolist(), place[i].tolist(), j.tolist(), cosine.tolist()):
            found.setdefault(o, set()).add(p)
            own = close.setdefault(o, {})
            if c >= CLOSE and (p not in own or c > own[p][0]):
                own[p] = (c, k, q)
        out = [(rows[o]["doc_id"], sorted(found[o]), [{"part": p, "block": k, "passage": q, "cosine": c} for p, (c, k, q) in close[o].items()]) for o in sorted(found)]
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.struct([("part", pa.int32()), ("block", pa.int64()), ("passage", pa.int32()), ("cosine", pa.float64())])))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["doc_id", "parts", "alike"])


def _run_pairs(cp: np.ndarray, lengths: np.ndarray, runs: Runs, wanted: list[set[int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """(text, part) with a common run of RUN characters, of the wanted parts of each text, and where the first one begins
    in either."""
    h = gram_hashes(cp, RUN)
    at = np.flatnonzero(runs.sieve[h >> U64(64 - SIEVE)])
    lo, hi = np.searchsorted(runs.hashes, h[at], "left"), np.searchsorted(runs.hashes, h[at], "right")
    held = hi > lo
    at, lo, hi = at[held], lo[held], hi[held]
    begin = _begins(lengths)
    text = np.searchsorted(np.cumsum(lengths), at, side="right")
    inside = at + RUN <= begin[text] + lengths[text]
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for p, o, a, b in zip(at[inside].tolist(), text[inside].tolist(), lo[inside], hi[inside]):
        for part, place in zip(runs.parts[a:b].tolist(), runs.places[a:b].tolist()):
            if (o, part) not in out and part in wanted[o] and np.array_equal(runs.texts[part][place : place + RUN], cp[p : p + RUN]):
                out[o, part] = (p - int(begin[o]), place)
    return out


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


_ANSWER = re.compile(r"[A-ZÀ-ÞА-Я][^\W\d_]{3,}|\d{2,}")


def answer_tokens(text: str) -> set[str]:
    """An item's numbers and names, lower-cased."""
    return {m[0].lower() for m in _ANSWER.finditer(text)}


def _string(cp: np.ndarray) -> str:
    return cp.tobytes().decode("utf-32-le", "surrogatepass")


def _verified(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """Candidates held against the texts of (doc_id, text, parts, alike)."""
    answers: dict[int, set[str]] = {}
    for batch in batches:
        ids, texts, parts, alike = (batch.column(k).to_pylist() for k in range(4))
        rows = []
        for part in bundles([len(t) for t in texts], BUDGET):
            cp, lengths = stripped(texts[part])
            begin = _begins(lengths)
            exact = _run_pairs(cp, lengths, items.runs, [set(p) for p in parts[part]])
            near = {(o, a["part"]): (a["block"], a["passage"], a["cosine"]) for o, own in enumerate(alike[part]) for a in own}
            for o, p in sorted(exact.keys() | near.keys()):
                if (o, p) in near:
                    block, passage, cosine = near[o, p]
                    k = int(items.place_of[passage]) * STEP
                else:  # a run whose passages are less than CLOSE: its own place
                    block, k, cosine = exact[o, p][0] // BLOCK, exact[o, p][1] // STEP * STEP, 0.0
                there = _string(items.runs.texts[p][k : k + ITEM])
                window = _string(cp[begin[o] + max(0, block * BLOCK - BLOCK) : begin[o] + min(int(lengths[o]), (block + 4) * BLOCK)])
                share = common_subsequence(there, window) / max(1, len(there))
                if p not in answers:
                    answers[p] = answer_tokens(items.texts[p])
                wanted = {t for t in answers[p] if t in there}
                held = sum(t in window for t in wanted) / len(wanted) if wanted else 0.0
                if (o, p) in exact or share >= SUBSEQUENCE and (held >= ANSWERS or not wanted):
                    rows.append((ids[part.start + o], int(items.ids[p]), (o, p) in exact, round(share, 4), round(held, 4), round(cosine, 4)))
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "item_id", "run", "subsequence", "answers", "cosine"])


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, repeated rows once, in blocks of at most LETTERS characters; a longer item stands alone. One block at a
    time is on the driver."""
    block, size = [], 0
    for r in items.where("length(text) > 0 and item_id is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r["text"]) > LETTERS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def _block_matches(texts: DataFrame, block: list[tuple[int, str]]) -> DataFrame | None:
    items = indexed(block)
    if items is None:
        return None
    table = written(texts.mapInArrow(partial(_tabled, slots=items.slots, hashes=items.hashes), _TABLE))
    df = _summed(table.select("term").mapInArrow(partial(_counted, n=len(items.hashes)), "piece int, cells binary"), np.int64)
    if not len(df):
        return None
    total = texts.count()
    items.weigh(df, total)
    found = [written(table.mapInArrow(partial(_searched, items=items, groups=some), _CANDIDATES)) for some in factored(texts.sparkSession, items)]
    found = reduce(DataFrame.unionByName, found).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("parts"))).alias("parts"), F.flatten(F.collect_list("alike")).alias("alike"))
    candidates = sieved(texts.withColumnRenamed("doc_id", "id"), found.select(F.col("doc_id").alias("id"))).withColumnRenamed("id", "doc_id").join(found, "doc_id")
    kind = "doc_id bigint, item_id bigint, run boolean, subsequence double, answers double, cosine double"
    return candidates.select("doc_id", "text", "parts", "alike").mapInArrow(partial(_verified, items=items), kind)


def matches(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, run, subsequence, answers, cosine): pairs with a common run of RUN letters and digits, and those
    whose passages are alike without one: reordered, or partly put in other words. The best of each pair."""
    texts = documents.select("doc_id", "text").where("length(text) > 0 and doc_id is not null")
    kind = "doc_id bigint, item_id bigint, run boolean, subsequence double, answers double, cosine double"
    out = documents.sparkSession.createDataFrame([], kind)
    for block in item_blocks(items):
        found = _block_matches(texts, block)
        if found is not None:
            out = out.unionByName(found)
    best = F.max_by(F.struct("subsequence", "answers", "cosine"), F.struct("subsequence", "answers", "cosine")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), best).select("doc_id", "item_id", "run", "b.subsequence", "b.answers", "b.cosine")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) with a common run of RUN letters and digits."""
    return matches(documents, items).where("run").select("doc_id", "item_id")
