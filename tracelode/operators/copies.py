"""Near-copies within short ranked lists: what is laid beside a list is a profile of bounded size for each text, and only
texts whose profiles leave it open are compared by their shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.tables import written

#: Characters of a shingle; counts in a profile.
SIZE, COUNTS = 8, 1_024
_KEPT = "id bigint, text string, n bigint, whole bigint, profile binary"


def shingles(text: str) -> np.ndarray:
    """The set of SIZE-character substrings as sorted 64-bit hashes; a shorter text is its own only one."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(x) < SIZE:
        x = np.append(x, np.full(SIZE - len(x), 0xFFFFFFFF, np.uint64))
    m = len(x) - SIZE + 1
    h = np.zeros(m, np.uint64)
    for k in range(SIZE):
        h = (h ^ x[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h * np.uint64(0xD6E8FEB86659FD93))


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, n, whole, profile): the number of shingles, a hash of all of them and how many fall on each of COUNTS
    equal ranges of hashes, 255 for more."""
    for batch in batches:
        n, whole, profile = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text)
            n.append(len(s))
            whole.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
            profile.append(np.minimum(np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=COUNTS), 255).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(whole, pa.int64()), pa.array(profile, pa.binary())], names=["id", "text", "n", "whole", "profile"])


def _possible(rows: pa.Table, threshold: float) -> pa.Table:
    """(qid, leader, follower, sure) of the pairs of one list that may be alike, sure where their sets are equal. Sets of a
    and b shingles of which c are common differ in a + b - 2c, and no less than their profiles do."""
    rows = rows.sort_by("rank")
    rank, ids, n, whole = (rows.column(c).to_numpy() for c in ("rank", "id", "n", "whole"))
    counts = np.frombuffer(b"".join(rows.column("profile").to_pylist()), np.uint8).reshape(-1, COUNTS).astype(np.int16)
    share = (1 - threshold) / (1 + threshold)
    leader, follower, sure = [], [], []
    for i in range(len(ids) - 1):
        j = i + 1 + np.flatnonzero((rank[i + 1 :] > rank[i]) & (np.minimum(n[i + 1 :], n[i]) >= threshold * np.maximum(n[i + 1 :], n[i])))
        apart = np.abs(counts[j] - counts[i]).sum(axis=1)
        j = j[apart <= share * (n[j] + n[i]) + 1e-6 * n[i]]
        leader.append(np.full(len(j), ids[i]))
        follower.append(ids[j])
        sure.append((n[j] == n[i]) & (whole[j] == whole[i]))
    join = lambda parts, kind: np.concatenate(parts or [np.zeros(0)]).astype(kind)
    leader, follower, sure = join(leader, np.int64), join(follower, np.int64), join(sure, bool)
    return pa.table({"qid": pa.array(np.full(len(leader), rows.column("qid")[0].as_py()), pa.int64()), "leader": leader, "follower": follower, "sure": sure})


def _alike(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            a, b = shingles(a), shingles(b)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both >= threshold * (len(a) + len(b) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def near_in_lists(ranked: DataFrame, texts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(qid, leader, follower) of (qid, rank, id) and (id, text): entries of one list whose sets of shingles of the
    normalised texts have at least this Jaccard similarity, the leader ranked before. Lists are short. Each text's
    shingles are cut once, however many lists it is in; a pair of texts is compared once."""
    known = texts.where("text is not null").join(ranked.select("id").distinct(), "id", "left_semi").select("id", F.replace(T.normalized("text"), F.lit("ß"), F.lit("ss")).alias("text"))
    known = written(known.mapInArrow(_profiled, _KEPT))
    listed = ranked.select("qid", F.col("rank").cast("bigint").alias("rank"), "id").join(known.drop("text"), "id")
    near = written(listed.groupBy("qid").applyInArrow(lambda rows: _possible(rows, threshold), "qid bigint, leader bigint, follower bigint, sure boolean"))
    open_pairs = near.where("not sure").select("leader", "follower").distinct()
    a, b = (known.select(F.col("id").alias(n), F.col("text").alias(x)) for n, x in (("leader", "a"), ("follower", "b")))
    pairs = open_pairs.join(a, "leader").join(b, "follower").select("leader", "follower", "a", "b")
    held = pairs.mapInArrow(partial(_alike, threshold=threshold), "leader bigint, follower bigint").distinct()
    return near.where("sure").select("qid", "leader", "follower").unionByName(near.where("not sure").join(held, ["leader", "follower"], "left_semi").select("qid", "leader", "follower")).distinct()
