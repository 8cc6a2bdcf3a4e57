"""Problem 1: near-copies by Jaccard similarity of character shingles, through the generalised pigeonhole principle.

Every text becomes a sketch of BINS min-hash values. Two texts of similarity s agree in a bin with probability s, so
near-copies differ in at most TAU bins but for a chance that `miss_probability` gives. The bits of one min-hash value
flip together, so they stay in one partition; bins whose values collide often are put into partitions with one another.
A partition i gets its own threshold t_i (−1: never probed), all t_i + 1 summing to TAU + 1: then every pair within
TAU differing bins differs in at most t_i bins of some partition i. The thresholds minimise the candidates that
histograms of the whole collection predict, by dynamic programming. Texts that meet in a key with many others are not
paired there but probed again by that key and one more partition; keys that the forecast's histograms show to be hot are not
gathered at all before that. Texts that are still many are compared by their tags in blocks of bounded size. Candidates are then held against the whole sketch
and at last against the exact shingle sets, so every pair that comes out is right.

Equal texts are folded before and unfolded after, so a group of copies costs one sketch.

Defined cases: a null text or id has no row; an empty or blank text has the empty string as its only shingle, so all of them
are equal; a text below SHINGLE characters is its own only shingle; repeated rows of an id count once; of an id with
several texts, the last check reads the least. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.arrays import U64, bundles, gram_hashes, mix, points
from tracelode.llm.sieve import sieved
from tracelode.operators.linkage import components
from tracelode.tables import cut, written

SHINGLE = 8
BINS = 64
#: Differing bins allowed. At similarity 0.8 exactly, 2 of 10,000 pairs exceed it; at 0.85 fewer than 1 of 10^6.
TAU = 24
PARTITIONS = 13
#: Texts up to SMALL shingles use one hash function per bin; from OVERLAP shingles on, one hash for all bins. Texts
#: between the two have both sketches, so the two texts of a near-copy always have one kind in common.
SMALL, OVERLAP = 256, 200
#: Cells of the histograms that predict candidates, for each partition and threshold.
CELLS = 4096
BUDGET = 2_000_000


def miss_probability(similarity: float, bins: int = BINS, tau: int = TAU) -> float:
    """Chance that a pair of this similarity differs in more than tau bins."""
    p = 1 - similarity
    return sum(math.comb(bins, k) * p**k * (1 - p) ** (bins - k) for k in range(tau + 1, bins + 1))


def normalised(text: str) -> str:
    return " ".join(text.casefold().split())


def shingles(text: str, n: int = SHINGLE) -> set[str]:
    t = normalised(text)
    return {t[i : i + n] for i in range(max(1, len(t) - n + 1))}


_SEEDS = mix(np.arange(1, BINS + 1, dtype=U64) * U64(0x632BE59BD9B4E019)) | U64(1)


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle counts, and the two kinds of sketches (uint32, BINS wide) of normalised texts. A kind that a text does
    not have is zero."""
    count = np.zeros(len(texts), np.int64)
    small, large = np.zeros((len(texts), BINS), np.uint32), np.zeros((len(texts), BINS), np.uint32)
    for part in bundles([len(t) for t in texts], BUDGET):
        own = texts[part]
        # the padding makes a text below SHINGLE characters one whole shingle
        padded = [t if len(t) >= SHINGLE else t + "\x00" * (SHINGLE - len(t)) for t in own]
        lengths = np.array([len(t) for t in padded])
        cp = points("".join(padded))
        ends = np.cumsum(lengths)
        h = gram_hashes(cp, SHINGLE)
        owner = np.repeat(np.arange(len(own)), lengths)[: len(h)]
        last = ends[owner] - SHINGLE
        keep = np.arange(len(h)) <= last
        h, owner = h[keep], owner[keep]
        # text, bin, value: one sort removes repeated shingles and orders the values of each bin
        key = (owner.astype(U64) << U64(38)) | (h >> U64(26))
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        text_of = (key >> U64(38)).astype(np.int64)
        n = np.bincount(text_of, minlength=len(own))
        count[part] = n
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        for i in np.flatnonzero(n <= SMALL):
            values = key[starts[i] : starts[i] + n[i]] & U64((1 << 38) - 1)
            with np.errstate(over="ignore"):
                grid = (values[:, None] + U64(1)) * _SEEDS[None, :]
            small[part.start + i] = ((grid ^ (grid >> U64(29))) * U64(0xBF58476D1CE4E5B9) >> U64(32)).min(axis=0)
        big = n >= OVERLAP
        if big.any():
            chosen = big[text_of]
            k = key[chosen]
            slot = k >> U64(32)
            first = np.concatenate(([True], slot[1:] != slot[:-1]))
            k, slot = k[first], slot[first]
            row, bin_ = (slot >> U64(6)).astype(np.int64), (slot & U64(63)).astype(np.int64)
            out = np.zeros((len(own), BINS), np.uint32)
            full = np.zeros((len(own), BINS), bool)
            out[row, bin_] = (k & U64(0xFFFFFFFF)).astype(np.uint32)
            full[row, bin_] = True
            # an empty bin borrows from bins in an order that depends on the bin alone
            step = 0
            todo = np.argwhere(~full & big[:, None])
            while len(todo):
                step += 1
                source = (mix(todo[:, 1].astype(U64) * U64(1000003) + U64(step)) & U64(63)).astype(np.int64)
                got = full[todo[:, 0], source]
                out[todo[got, 0], todo[got, 1]] = out[todo[got, 0], source[got]] + np.uint32(step)
                todo = todo[~got]
            large[part] = out
    return count, small, large


_SKETCH = "id bigint, digest binary, n int, kind int, sketch binary, tag binary"


def _tags(m: np.ndarray) -> np.ndarray:
    """Four bits of each bin, packed: two sketches differ in at least as many bins as their tags in half bytes."""
    low = ((m ^ (m >> 4) ^ (m >> 8) ^ (m >> 12)) & 15).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << 4)


def _rows(m: np.ndarray) -> pa.Array:
    width = m.shape[1] * m.itemsize
    flat = m.tobytes()
    return pa.array([flat[i : i + width] for i in range(0, len(flat), width)], pa.binary())


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digest(normalised(t)) for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "digest"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        texts = [normalised(t) for t in batch.column(1).to_pylist()]
        digest = [_digest(t) for t in texts]
        n, small, large = sketches(texts)
        for kind, values, which in ((0, small, n <= SMALL), (1, large, n >= OVERLAP)):
            at = np.flatnonzero(which)
            if len(at):
                m = values[at].astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at], pa.int64()), pa.array([digest[i] for i in at], pa.binary()), pa.array(n[at].astype(np.int32)), pa.array(np.full(len(at), kind, np.int32)), _rows(m), _rows(_tags(m))],
                    names=["id", "digest", "n", "kind", "sketch", "tag"],
                )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BINS)


def _bin_rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A histogram of each bin's values, in 256 cells."""
    total = np.zeros((BINS, 256), np.int64)
    for batch in batches:
        m = (_matrix(batch.column(0)) & 255).astype(np.int64)
        total += np.bincount((m + 256 * np.arange(BINS)).ravel(), minlength=256 * BINS).reshape(BINS, 256)
    yield pa.RecordBatch.from_arrays([pa.array([0] * BINS, pa.int32()), pa.array(range(BINS), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], names=["t", "part", "cells"])


BASE_KEY = U64(0xD6E8FEB86659FD93)


def _variant_keys(m: np.ndarray, bins: tuple[int, ...], t: int, kind: np.ndarray, salt: int) -> Iterator[np.ndarray]:
    """Keys of a partition that two sketches share if and (but for collisions) only if they differ in at most t of its
    bins: one for each choice of t bins that are left out."""
    with np.errstate(over="ignore"):
        terms = [mix(m[:, b].astype(U64) + (U64(b + 1) << U64(32))) for b in bins]
        whole = np.sum(terms, axis=0, dtype=U64)
        for out in combinations(range(len(bins)), t):
            left = whole - np.sum([terms[i] for i in out], axis=0, dtype=U64) if out else whole
            yield mix(left + U64(1 + salt * 64 + sum(1 << i for i in out)) * BASE_KEY + kind.astype(U64))


def _forecast(batches: Iterator[pa.RecordBatch], layout: list[tuple[int, ...]]) -> Iterator[pa.RecordBatch]:
    """Histograms of the keys of every partition at thresholds 0, 1 and 2."""
    total = np.zeros((len(layout), 3, CELLS), np.int64)
    for batch in batches:
        m, kind = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
        for i, bins in enumerate(layout):
            for t in range(3):
                for key in _variant_keys(m, bins, t, kind, i):
                    total[i, t] += np.bincount((key >> U64(52)).astype(np.int64), minlength=CELLS)
    p, t = np.divmod(np.arange(3 * len(layout)), 3)
    yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array([total[a, b].tobytes() for a, b in zip(p, t)], pa.binary())], names=["t", "part", "cells"])


def _add(table: pa.Table, gathered: int) -> pa.Table:
    cells = sum(np.frombuffer(x, np.int64) for x in table.column("cells").to_pylist())
    n = int(cells.sum())
    pairs = max(0.0, (float((cells.astype(float) ** 2).sum()) - n * n / len(cells)) / 2)
    hot = np.flatnonzero(cells > 2 * n / len(cells) + gathered)
    return pa.table({"t": table.column("t")[:1], "part": table.column("part")[:1], "pairs": pa.array([pairs]), "keys": pa.array([n], pa.int64()), "hot": pa.array([hot.tolist()], pa.list_(pa.int32()))})


def grouped_bins(rates: dict[int, float], parts: int = PARTITIONS) -> list[tuple[int, ...]]:
    """Partitions of neighbouring bins in the order of their collision rates."""
    order = sorted(rates, key=lambda b: (-rates[b], b))
    cuts = [round(i * len(order) / parts) for i in range(parts + 1)]
    return [tuple(sorted(order[a:b])) for a, b in zip(cuts, cuts[1:])]


def allocated(cost: dict[tuple[int, int], float], parts: int, tau: int = TAU) -> list[int]:
    """Thresholds of least cost with sum(t + 1) = tau + 1; cost has (partition, threshold) for thresholds 0 to 2, and
    −1 costs nothing."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(parts):
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, chosen) in best.items():
            for t in (-1, 0, 1, 2):
                to, c = min(tau + 1, used + t + 1), so_far + (cost[i, t] if t >= 0 else 0.0)
                if to not in after or c < after[to][0]:
                    after[to] = (c, [*chosen, t])
        best = after
    return best[tau + 1][1]


#: Texts with one key above which they are not paired at once: they are probed again among themselves, by the other
#: partitions together with that key. Boilerplate that a third of all texts have is then no group of its own.
HOT = 300
#: Entries of a cell of the forecast's histograms beyond twice the cells' mean from which its keys are not gathered at all
#: but go straight to the second round: so no key brings more than this and twice the mean into one task.
GATHERED = 200_000
#: Texts that agree in two partitions above which they are compared in blocks of this size, by their tags.
BLOCK = 2_000
#: Bits of a key within its bucket. A false meeting of two keys costs one comparison of tags and nothing else.
LOW_BITS = 24
#: Ratio of the steps in which shingle counts are kept, in one byte.
STEP = 1.05


def _planes(x: np.ndarray, width: int) -> bytes:
    """The bytes of integers by significance, so that the exchange's compression removes the empty ones."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = []
    for blob in column.to_pylist():
        wide = np.zeros((len(blob) // width, 8), np.uint8)
        wide[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, -1).T
        out.append(wide.view("<i8").ravel())
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _packed(keys: np.ndarray, rows: np.ndarray, ids: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """For each bucket of keys one row: the keys' low bits, the ids and the steps of the shingle counts."""
    step = (np.log(np.maximum(n, 1)) / np.log(STEP)).astype(np.int64)
    order = np.argsort(keys)
    keys, rows = keys[order], rows[order]
    code = _codes(keys, buckets)
    bucket = code >> LOW_BITS
    at = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else [0]
    parts = list(zip(at[:-1], at[1:]))
    low, own, size = code & ((1 << LOW_BITS) - 1), ids[rows].astype(np.int64), step[rows]
    return pa.RecordBatch.from_arrays([pa.array(bucket[[a for a, _ in parts]].astype(np.int32))] + [pa.array([_planes(x[a:b], w) for a, b in parts], pa.binary()) for x, w in ((low, LOW_BITS // 8), (own, 8), (size, 2))], names=["bucket", "low", "ids", "sizes"])


def _codes(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A key's bucket and low bits in one number."""
    bucket = ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    return bucket << LOW_BITS | (keys & U64((1 << LOW_BITS) - 1)).astype(np.int64)


def _in_cells(keys: np.ndarray, cells: list[int]) -> np.ndarray:
    return np.isin((keys >> U64(52)).astype(np.int64), cells) if cells else np.zeros(len(keys), bool)


def _probes(batches: Iterator[pa.RecordBatch], layout: list[tuple[int, ...]], thresholds: list[int], buckets: int, hot: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """Packed keys of (id, n, kind, sketch), those of hot cells left out."""
    for batch in batches:
        ids, n, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        m = _matrix(batch.column(3))
        keys, rows = [], []
        for i, (bins, t) in enumerate(zip(layout, thresholds)):
            if t >= 0:
                for k in _variant_keys(m, bins, t, kind, i):
                    kept = np.flatnonzero(~_in_cells(k, hot[i]))
                    keys.append(k[kept])
                    rows.append(kept.astype(np.int32))
        yield _packed(np.concatenate(keys), np.concatenate(rows), ids, n, buckets)


def _hot_entries(batches: Iterator[pa.RecordBatch], layout: list[tuple[int, ...]], thresholds: list[int], buckets: int, hot: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """(hot key's code, id) of the keys of hot cells."""
    for batch in batches:
        ids, kind = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        m = _matrix(batch.column(3))
        codes, own = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, (bins, t) in enumerate(zip(layout, thresholds)):
            if t >= 0 and hot[i]:
                for k in _variant_keys(m, bins, t, kind, i):
                    many = _in_cells(k, hot[i])
                    codes.append(_codes(k[many], buckets))
                    own.append(ids[many])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes)), pa.array(np.concatenate(own), pa.int64())], names=["hot", "id"])


def _block_pairs(table: pa.Table, tau: int) -> pa.Table:
    """Of the texts (id, block, tag) of two blocks of one key: pairs (a, b), a < b, one of either block, that differ in at
    most tau half bytes of their tags."""
    ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
    tags = np.frombuffer(b"".join(table.column("tag").to_pylist()), np.uint8).reshape(-1, BINS // 2)
    p, q = int(table.column("p")[0].as_py()), int(table.column("q")[0].as_py())
    left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for begin in range(0, len(left), 64):
        rows = left[begin : begin + 64]
        unlike = tags[rows][:, None, :] ^ tags[right][None, :, :]
        differ = np.count_nonzero(unlike & 15, axis=2) + np.count_nonzero(unlike >> 4, axis=2)
        i, j = np.nonzero(differ <= tau)
        a.append(ids[rows[i]])
        b.append(ids[right[j]])
    x, y = np.concatenate(a), np.concatenate(b)
    x, y = np.minimum(x, y), np.maximum(x, y)
    return pa.table({"a": pa.array(x[x < y], pa.int64()), "b": pa.array(y[x < y], pa.int64())})


def _second_probes(batches: Iterator[pa.RecordBatch], layout: list[tuple[int, ...]], thresholds: list[int], others: list[list[int]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed keys of (hot, id, n, kind, sketch), each joined with the hot key. The partition that the hot key is of is
    left out; the thresholds of the rest sum up as if it were not there, so no pair is lost."""
    for batch in batches:
        hot, ids, n, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        m = _matrix(batch.column(4))
        of = np.full(len(ids), -1)
        for i, (bins, t) in enumerate(zip(layout, thresholds)):
            if t >= 0:
                for k in _variant_keys(m, bins, t, kind, i):
                    of[_codes(k, buckets) == hot] = i
        keys, rows = [], []
        for i in np.unique(of[of >= 0]):
            at = np.flatnonzero(of == i)
            for j, (bins, t) in enumerate(zip(layout, others[i])):
                if t >= 0:
                    for k in _variant_keys(m[at], bins, t, kind[at], j):
                        keys.append(mix(k ^ mix(hot[at].astype(U64) + U64(1))))
                        rows.append(at)
        if keys:
            yield _packed(np.concatenate(keys), np.concatenate(rows), ids, n, buckets)


def _pairs(table: pa.Table, hot: int) -> pa.Table:
    """Pairs (a, b) of ids with one key; of keys with more than `hot` ids (a: the key, b: an id) instead."""
    bucket = table.column("bucket")[0].as_py()
    low, ids, size = (_unplaned(table.column(c), w) for c, w in (("low", LOW_BITS // 8), ("ids", 8), ("sizes", 2)))
    order = np.lexsort((ids, low))
    low, ids, size = low[order], ids[order], size[order]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(low)) + 1, [len(low)]))
    many = np.repeat(np.diff(edges) > hot, np.diff(edges))
    codes = low[many] | bucket << LOW_BITS
    again = np.unique(np.stack([codes, ids[many]]), axis=1)
    low, ids, size = low[~many], ids[~many], size[~many]
    apart = math.log(1 / 0.8) / math.log(STEP) + 1
    a, b = [], []
    step = 1
    at = np.arange(len(low))
    while len(at):
        at = at[at + step < len(low)]
        at = at[low[at] == low[at + step]]  # the rows whose run still reaches `step` rows further
        left, right = at, at + step
        ok = (ids[left] != ids[right]) & (np.abs(size[left] - size[right]) <= apart)
        a.append(ids[left[ok]])
        b.append(ids[right[ok]])
        step += 1
    both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.empty((2, 0), np.int64)
    return pa.table({"a": pa.array(np.concatenate((both[0], again[0])), pa.int64()), "b": pa.array(np.concatenate((both[1], again[1])), pa.int64()), "hot": pa.array(np.arange(both.shape[1] + again.shape[1]) >= both.shape[1])})


def _close(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS // 2) for i in (2, 3))
        unlike = x ^ y
        near = ((unlike & 15) != 0).sum(axis=1) + ((unlike >> 4) != 0).sum(axis=1) <= tau
        yield batch.select([0, 1]).filter(pa.array(near))


def _exact(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            p, q = shingles(x), shingles(y)
            both = len(p & q)
            keep.append(both >= threshold * (len(p) + len(q) - both) - 1e-12)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def near_copy_links(texts: DataFrame, threshold: float = 0.8, hot: int = HOT, block: int = BLOCK, gathered: int = GATHERED) -> tuple[DataFrame, DataFrame]:
    """Of (id, text): the links (a, b), a < b, between the least ids of different texts of at least this similarity
    (0.8 or more, for which TAU is made), and the membership (id, rep) of every id with a text."""
    if threshold < 0.8:
        raise ValueError("the sketches are made for a similarity of 0.8 or more")

    def add(table: pa.Table) -> pa.Table:
        return _add(table, gathered)

    texts = texts.where("id is not null and text is not null").select("id", "text")
    # digests are made twice, which costs less than to keep the sketches of all texts
    digests = texts.mapInArrow(_digests, "id bigint, digest binary").distinct()
    members = digests.join(digests.groupBy("digest").agg(F.min("id").alias("rep")), "digest").select("id", "rep")
    reps = cut(texts.mapInArrow(_sketch, _SKETCH).groupBy("digest", "kind").agg(F.min_by(F.struct("id", "n", "sketch", "tag"), "id").alias("x")).select("x.id", "x.n", "kind", "x.sketch", "x.tag"))
    rates = {r["part"]: r["pairs"] for r in reps.select("sketch").mapInArrow(_bin_rates, "t int, part int, cells binary").groupBy("t", "part").applyInArrow(add, "t int, part int, pairs double, keys bigint, hot array<int>").collect()}
    rates = {b: rates.get(b, 0.0) for b in range(BINS)}
    layout = grouped_bins(rates)
    found = reps.select("sketch", "kind").mapInArrow(partial(_forecast, layout=layout), "t int, part int, cells binary").groupBy("t", "part").applyInArrow(add, "t int, part int, pairs double, keys bigint, hot array<int>").collect()
    # a key costs about as much as a candidate pair: both are rows of an exchange
    cost = {(r["part"], r["t"]): r["pairs"] + r["keys"] for r in found} or {(i, t): 1.0 for i in range(len(layout)) for t in range(3)}
    thresholds = allocated(cost, len(layout))
    keys = sum(r["keys"] for r in found if thresholds[r["part"]] == r["t"])
    cells = {r["part"]: r["hot"] for r in found if thresholds[r["part"]] == r["t"]}
    cells = [cells.get(i, []) for i in range(len(layout))]
    buckets = 1 << max(4, min(30, math.ceil(math.log2(keys / 100_000 + 1))))
    packed, pairs = "bucket int, low binary, ids binary, sizes binary", "a bigint, b bigint, hot boolean"

    def first(table: pa.Table) -> pa.Table:
        return _pairs(table, hot)

    def second(table: pa.Table) -> pa.Table:
        return _pairs(table, block)

    def last(table: pa.Table) -> pa.Table:
        return _block_pairs(table, TAU)

    sketched = reps.select("id", "n", "kind", "sketch")
    found = written(sketched.mapInArrow(partial(_probes, layout=layout, thresholds=thresholds, buckets=buckets, hot=cells), packed).groupBy("bucket").applyInArrow(first, pairs).distinct())
    candidates = found.where("not hot").select("a", "b")
    again = found.where("hot").select(F.col("a").alias("hot"), F.col("b").alias("id"))
    if any(cells):
        again = again.unionByName(sketched.mapInArrow(partial(_hot_entries, layout=layout, thresholds=thresholds, buckets=buckets, hot=cells), "hot bigint, id bigint")).distinct()
    if not again.isEmpty():
        others = [allocated({k: v if k[0] != i else math.inf for k, v in cost.items()}, len(layout)) for i in range(len(layout))]
        probed = again.join(sketched, "id").select("hot", "id", "n", "kind", "sketch")
        probed = probed.mapInArrow(partial(_second_probes, layout=layout, thresholds=thresholds, others=others, buckets=buckets), packed)
        met = written(probed.groupBy("bucket").applyInArrow(second, pairs).distinct())
        candidates = candidates.unionByName(met.where("not hot").select("a", "b"))
        # texts that agree in two partitions and are still many: nearly all of them are near-copies. They are compared block
        # by block, each pair of blocks in a task of its own, and only what is near by its tags comes out
        many = met.where("hot").select(F.col("a").alias("code"), F.col("b").alias("id"))
        sizes = many.groupBy("code").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        placed = many.join(sizes, "code").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(reps.select("id", "tag"), "id")
        beside = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("code", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "id", "block", "tag")
        candidates = candidates.unionByName(beside.groupBy("code", "p", "q").applyInArrow(last, "a bigint, b bigint")).distinct()
    side = reps.select("id", "kind", "tag")
    near = (
        candidates.join(side.select(F.col("id").alias("a"), "kind", F.col("tag").alias("tag_a")), "a")
        .join(side.select(F.col("id").alias("b"), "kind", F.col("tag").alias("tag_b")), ["b", "kind"])
        .select("a", "b", "tag_a", "tag_b")
        .mapInArrow(partial(_close, tau=TAU), "a bigint, b bigint")
        .distinct()
    )
    near = cut(near)
    wanted = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    one = sieved(texts, wanted).join(wanted, "id").groupBy("id").agg(F.min("text").alias("text"))
    links = (
        near.join(one.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(one.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(partial(_exact, threshold=threshold), "a bigint, b bigint")
    )
    return cut(links), members


def near_copy_pairs(texts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """All pairs (id_a, id_b), id_a < id_b, of near-copies, copies unfolded."""
    links, members = near_copy_links(texts, threshold)
    left, right = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.join(left, "a").join(right, "b").select("x", "y")
    many = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rep").alias("a"))
    within = left.join(many, "a").join(right.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y")
    return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_copy_groups(texts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, rep, links) of every id with a text: the least id of the texts that near-copies connect with it, also by way of
    others, and how many different texts are near-copies of its own."""
    links, members = near_copy_links(texts, threshold)
    counts = links.select(F.explode(F.array("a", "b")).alias("own")).groupBy("own").agg(F.count("*").alias("links"))
    linked = components(links.select(F.explode(F.array("a", "b")).alias("id"), F.col("a").alias("key"))).withColumnRenamed("id", "own").withColumnRenamed("component", "group")
    rows = members.withColumnRenamed("rep", "own").join(counts, "own", "left").join(linked, "own", "left")
    return rows.select("id", F.coalesce("group", "own").alias("rep"), F.coalesce("links", F.lit(0)).alias("links"))
