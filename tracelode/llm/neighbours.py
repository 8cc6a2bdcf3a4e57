"""Problem 6: most similar vectors by a hierarchical k-means tree and best-bin-first traversal.

The tree is fitted on a bounded sample (SAMPLE to MOST_SAMPLE vectors, eight for each leaf, the least by hash) and every usable vector is indexed in the
leaf that its own traversal reaches first. A traversal keeps a priority queue of tree nodes by distance and opens the
nearest one next; it is done for a whole batch at once. How many leaves are visited is calibrated: exact neighbours of
PROBES vectors against all vectors are found by brute force, and visits are widened until the wanted share of those
neighbours lies in visited leaves. Vectors meet in their leaves in one exchange, at half precision where that loses
nothing; each pair met counts for both sides, and the calibration counts a pair as met where either side visits the
other's leaf. Cosines in a leaf are exact to 12 digits, so no vector that was met is lost, however dense its region.

Equal vectors are folded before and unfolded after; leaves are split by the sample's density, so a dense region gets
more of them.

Defined cases: null vectors, wrong lengths, null, NaN or infinite elements and all-zero vectors are not usable and have
no neighbours; length does not matter; ties of similarity go to the lesser id; repeated rows count once; an empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.tables import cut, written

DIMENSIONS = 64
#: Vectors of the sample: eight for each leaf, within these bounds.
SAMPLE, MOST_SAMPLE, PROBES = 32_768, 262_144, 1_024
BRANCHES = 16
#: Vectors in a leaf at least.
LEAF_VECTORS = 512
BATCH = 2_000


@dataclass
class Tree:
    """Nodes in rows; the children of a node are neighbours in the arrays; leaf is −1 for inner nodes."""

    centres: np.ndarray
    first: np.ndarray
    children: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's k-means from k different rows; empty clusters vanish."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        used, label = np.unique(label, return_inverse=True)
        sums = np.zeros((len(used), x.shape[1]), np.float64)
        np.add.at(sums, label, x)
        centres = (sums / np.bincount(label)[:, None]).astype(np.float32)
    return centres, label


def fitted(x: np.ndarray, most: int, branches: int = BRANCHES, seed: int = 7) -> Tree:
    """A tree whose leaves hold at most `most` rows of x, as far as rows differ."""
    rng = np.random.default_rng(seed)
    centres, first, children, leaf = [np.zeros(x.shape[1], np.float32)], [0], [0], [-1]
    todo = [(0, np.arange(len(x)))]
    found = 0
    while todo:
        node, rows = todo.pop(0)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        if len(rows) > most:
            c, label = _means(x[rows], max(2, min(branches, -(-len(rows) // most))), rng)
            if len(c) > 1:
                parts = [(c[i], rows[label == i]) for i in range(len(c)) if (label == i).any()]
        if not parts:
            leaf[node], found = found, found + 1
            continue
        first[node], children[node] = len(centres), len(parts)
        for centre, own in parts:
            todo.append((len(centres), own))
            centres.append(centre)
            first.append(0)
            children.append(0)
            leaf.append(-1)
    return Tree(np.array(centres, np.float32), np.array(first), np.array(children), np.array(leaf))


def visits(tree: Tree, x: np.ndarray, most: int) -> np.ndarray:
    """The first `most` leaves of each row's best-bin-first traversal, in order; −1 where there are no more."""
    n, out = len(x), np.full((len(x), most), -1, np.int64)
    if tree.children[0] == 0:
        out[:, 0] = 0
        return out
    queue = np.full((n, len(tree.centres)), np.inf, np.float32)
    half = (tree.centres**2).sum(axis=1) / 2

    def opened(rows: np.ndarray, node: int) -> None:
        own = slice(tree.first[node], tree.first[node] + tree.children[node])
        queue[rows, own] = half[own] - x[rows] @ tree.centres[own].T

    opened(np.arange(n), 0)
    seen = np.zeros(n, np.int64)
    active = np.arange(n)
    while len(active):
        best = queue[active].argmin(axis=1)
        ended = np.isinf(queue[active, best])
        active, best = active[~ended], best[~ended]
        queue[active, best] = np.inf
        at_leaf = tree.leaf[best] >= 0
        rows = active[at_leaf]
        out[rows, seen[rows]] = tree.leaf[best[at_leaf]]
        seen[rows] += 1
        rows, nodes = active[~at_leaf], best[~at_leaf]
        order = np.argsort(nodes, kind="stable")
        rows, nodes = rows[order], nodes[order]
        edges = np.flatnonzero(np.diff(nodes)) + 1
        for part in np.split(np.arange(len(nodes)), edges):
            if len(part):
                opened(rows[part], nodes[part[0]])
        active = active[seen[active] < most]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _units(column: pa.Array, dimensions: int) -> np.ndarray:
    return _unit(_unpacked(column, dimensions))


def _usable(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    """(id, packed vector, its digest) of what is usable."""
    for batch in batches:
        ids, rows = batch.column(0), batch.column(1)
        lengths = rows.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        keep = np.flatnonzero((lengths == dimensions) & ids.is_valid().to_numpy(zero_copy_only=False))
        # a null element counts as not a number
        x = rows.take(pa.array(keep)).flatten().cast(pa.float32(), safe=False).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(keep), dimensions)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        vecs = _packed(x[good] + np.float32(0))  # −0 becomes 0
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep[good])), pa.array(vecs, pa.binary()), pa.array([xxhash.xxh3_128_digest(v) for v in vecs], pa.binary())], names=["id", "vec", "digest"])


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, len(batch), BATCH):
            yield batch.slice(begin, BATCH)


def _packed(x: np.ndarray) -> list[bytes]:
    """Vectors at half precision where every element has it, else as they are."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    same = (half == x).all(axis=1)
    return [(h if s else v).tobytes() for h, v, s in zip(half, x, same)]


def _unpacked(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    rows = column.to_pylist()
    half = np.array([len(r) == 2 * dimensions for r in rows], bool)
    x = np.empty((len(rows), dimensions), np.float32)
    for chosen, kind in ((half, np.float16), (~half, np.float32)):
        x[chosen] = np.frombuffer(b"".join(rows[i] for i in np.flatnonzero(chosen)), kind).reshape(-1, dimensions)
    return x


def _placed(batches: Iterator[pa.RecordBatch], tree: Tree, most: int, every: int, dimensions: int) -> Iterator[pa.RecordBatch]:
    """Rows (leaf, id, member, asks, packed) for the leaf that a vector is indexed in and those that it asks."""
    for batch in _batched(batches):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        x = _units(batch.column(1), dimensions).astype(np.float32)
        asks = ids % every == 0
        leaves = np.full((len(ids), most), -1, np.int64)
        for chosen, n in ((asks, most), (~asks, 1)):
            if chosen.any():
                leaves[chosen, :n] = visits(tree, x[chosen], n)
        row, place = np.nonzero(leaves >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(leaves[row, place].astype(np.int32)), pa.array(ids[row], pa.int64()), pa.array(place == 0), pa.array(asks[row]), batch.column(1).take(pa.array(row))], names=["leaf", "id", "member", "asks", "packed"])


#: Digits of a cosine; what differs by less is a tie.
DIGITS = 12


def _best(near: np.ndarray, x: np.ndarray, y: np.ndarray, rows: np.ndarray, columns: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row id, column id, cosine) of each row's k best columns of at least `floor`, its own id left out. `near` has the
    cosines of x and y in single precision; what may be among the best within its error is computed exactly."""
    error = np.float32((x.shape[1] + 8) * 2.0**-23)
    least = np.full(len(rows), floor - error, np.float32)
    # its own id may be among them, so one more
    many = np.flatnonzero((near >= least[:, None]).sum(axis=1) > k + 1) if near.shape[1] > k + 1 else []
    if len(many):
        least[many] = np.maximum(least[many], np.partition(near[many], near.shape[1] - k - 1, axis=1)[:, near.shape[1] - k - 1] - 2 * error)
    i, j = np.nonzero(near >= least[:, None])
    other = rows[i] != columns[j]
    i, j = i[other], j[other]
    c = np.round(np.minimum(np.einsum("ij,ij->i", x[i], y[j]), 1.0), DIGITS)
    order = np.lexsort((columns[j], -c, i))
    i, j, c = i[order], j[order], c[order]
    kept = (np.arange(len(i)) - np.searchsorted(i, i) < k) & (c >= floor)
    return rows[i[kept]], columns[j[kept]], c[kept]


def _meet(table: pa.Table, k: int, floor: float, both: bool, dimensions: int) -> pa.Table:
    """Within a leaf: the best members of each row that asks, and where every row asks, the best askers of each member."""
    ids = table.column("id").to_numpy()
    member, asks = (table.column(c).to_numpy() for c in ("member", "asks"))
    x = _units(table.column("packed"), dimensions)
    single = x.astype(np.float32)
    own, out = np.flatnonzero(member), []
    if len(own):
        for begin in range(0, len(ids), BATCH // 2):
            rows = begin + np.flatnonzero(asks[begin : begin + BATCH // 2])
            for at in range(0, len(own), 4 * BATCH):
                columns = own[at : at + 4 * BATCH]
                near = single[rows] @ single[columns].T
                out.append(_best(near, x[rows], x[columns], ids[rows], ids[columns], k, floor))
                if both:
                    out.append(_best(near.T, x[columns], x[rows], ids[columns], ids[rows], k, floor))
    a, b, c = (np.concatenate(z) for z in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.table({"x": pa.array(a, pa.int64()), "y": pa.array(b, pa.int64()), "cos": pa.array(c.astype(np.float64))})


def _brute(batches: Iterator[pa.RecordBatch], probes: tuple[np.ndarray, np.ndarray], k: int, floor: float, dimensions: int) -> Iterator[pa.RecordBatch]:
    """A batch's best neighbours of every probe, with their vectors."""
    ids, q = probes
    for batch in _batched(batches):
        own = batch.column(0).to_numpy(zero_copy_only=False)
        x = _units(batch.column(1), dimensions)
        a, b, c = _best(q.astype(np.float32) @ x.astype(np.float32).T, q, x, ids, own, k, floor)
        order = np.argsort(own)
        at = order[np.searchsorted(own, b, sorter=order)]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c.astype(np.float64)), batch.column(1).take(pa.array(at))], names=["x", "y", "cos", "vec"])


def _top(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("x").orderBy(F.desc("cos"), "y")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def calibrated(vectors: DataFrame, tree: Tree, k: int, floor: float, recall: float, every: int = 1, dimensions: int = DIMENSIONS) -> tuple[int, float]:
    """The least number of leaf visits with this recall on the probes, and the recall measured."""
    asking = vectors.where(F.col("id") % every == 0)
    chosen = asking.orderBy(F.xxhash64("id", F.lit("probe")), "id").limit(PROBES).collect()
    if not chosen:
        return 1, 1.0
    ids = np.array([r["id"] for r in chosen], np.int64)
    q = _units(pa.array([bytes(r["vec"]) for r in chosen], pa.binary()), dimensions)
    near = _top(vectors.mapInArrow(partial(_brute, probes=(ids, q), k=k, floor=floor, dimensions=dimensions), "x bigint, y bigint, cos double, vec binary"), k).select("x", "vec").collect()
    if not near:
        return min(4, tree.leaves), 1.0
    where = {int(i): n for n, i in enumerate(ids)}
    mine = np.array([where[r["x"]] for r in near])
    theirs = _units(pa.array([bytes(r["vec"]) for r in near], pa.binary()), dimensions).astype(np.float32)
    q = q.astype(np.float32)
    there = visits(tree, theirs, tree.leaves if every == 1 else 1)
    ranks = (visits(tree, q, tree.leaves)[mine] == there[:, :1]).argmax(axis=1)
    if every == 1:
        ranks = np.minimum(ranks, (there == visits(tree, q, 1)[mine]).argmax(axis=1))
    ranks.sort()
    for most in range(1, tree.leaves + 1):
        share = np.searchsorted(ranks, most) / len(ranks)
        if share >= recall:
            break
    return most, float(share)


def neighbours(vectors: DataFrame, k: int = 10, floor: float = -1.0, recall: float = 0.99, every: int = 1, dimensions: int = DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """Of (id, vec): (x, y, cos) with the k best y of every x whose id is divisible by `every`, and the membership
    (id, x, least) of ids in equal vectors: x is the least id of its group, `least` the id's place in it. Vectors of
    another length than `dimensions` are not usable."""
    usable = vectors.select("id", "vec").mapInArrow(partial(_usable, dimensions=dimensions), "id bigint, vec binary, digest binary")
    # the least id stands for its group; where only another member asks, that one does
    first = usable.groupBy("digest").agg(F.min_by("vec", "id").alias("vec"), F.min("id").alias("x"), F.max("id").alias("last"), F.min(F.when(F.col("id") % every == 0, F.col("id"))).alias("asker"))
    reps = written(first.select(F.coalesce("asker", "x").alias("id"), "vec", (F.col("x") != F.col("last")).alias("many"), F.when(F.col("x") != F.col("last"), F.col("digest")).alias("digest")))
    group = Window.partitionBy("x").orderBy("id")
    members = usable.select("id", "digest").join(reps.where("many").select("digest", F.col("id").alias("x")), "digest").select("id", "x").distinct()
    members = cut(members.withColumn("place", F.row_number().over(group)).select("id", "x", F.when(F.col("place") <= k + 1, F.col("place")).alias("least")))
    n = reps.count()
    # leaves grow with the root of the collection, so that neither visits nor a leaf grow with the whole of it
    leaf = max(LEAF_VECTORS, int(1.4 * n**0.5))
    size = min(MOST_SAMPLE, max(SAMPLE, 8 * n // leaf))
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(size).select("vec").toArrow().column("vec")
    x = _units(sample, dimensions).astype(np.float32) if len(sample) else np.zeros((0, dimensions), np.float32)
    tree = fitted(x, max(8, len(x) * leaf // max(1, n)))
    plain = reps.select("id", "vec")
    most, _ = calibrated(plain, tree, k, floor, recall, every, dimensions)
    # one more than calibrated: the probes' own recall is measured on a sample
    placed = plain.mapInArrow(partial(_placed, tree=tree, most=min(most + 1, tree.leaves), every=every, dimensions=dimensions), "leaf int, id bigint, member boolean, asks boolean, packed binary")

    def meet(table: pa.Table) -> pa.Table:
        return _meet(table, k, floor, every == 1, dimensions)

    met = placed.groupBy("leaf").applyInArrow(meet, "x bigint, y bigint, cos double").groupBy("x", "y").agg(F.max("cos").alias("cos"))
    return _top(met, k).select("x", "y", "cos"), members


def neighbour_ids(vectors: DataFrame, k: int = 10, floor: float = -1.0, recall: float = 0.99, every: int = 1, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, place, other, cosine): of every usable id divisible by `every` its k most similar ids of at least `floor`."""
    near, members = neighbours(vectors, k, floor, recall, every, dimensions)
    few = members.where(F.col("least").isNotNull())
    # what a group offers to others: its k + 1 least ids; a vector without equals offers itself
    offered = near.join(few.select(F.col("x").alias("y"), F.col("id").alias("other")), "y", "left").select("x", F.coalesce("other", "y").alias("other"), "cos")
    inside = few.select("x", F.col("id").alias("other"), F.lit(1.0).alias("cos"))
    best = Window.partitionBy("x").orderBy(F.desc("cos"), "other")
    lists = offered.unionByName(inside).withColumn("p", F.row_number().over(best)).where(F.col("p") <= k + 1)
    asked = lists.join(members.select("x", "id"), "x", "left").select(F.coalesce("id", "x").alias("id"), "other", "cos").where("id <> other")
    asked = asked.where(F.col("id") % every == 0)
    final = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    return asked.withColumn("place", F.row_number().over(final)).where(F.col("place") <= k).select("id", "place", "other", F.col("cos").alias("cosine"))


def similar_pairs(vectors: DataFrame, k: int = 10, floor: float = 0.9) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of at least `floor`, where one is among the k most similar of the other."""
    return neighbour_ids(vectors, k, floor).select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
