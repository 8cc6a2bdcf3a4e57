"""Whole passages looked for in texts: many at once, in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of the passages of one block, which is sent to every task.
BLOCK = 4_000_000


def _held(batches: Iterator[pa.RecordBatch], passages: list[str]) -> Iterator[pa.RecordBatch]:
    automaton = ahocorasick.Automaton()
    for p in passages:
        automaton.add_word(p, p)
    automaton.make_automaton()
    for batch in batches:
        found = [(p, k) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in {p for _, p in automaton.iter(t)}]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([k for _, k in found], pa.int64())], names=["quote", "source_key"])


def _blocks(quotes: DataFrame) -> Iterator[list[str]]:
    block, size = [], 0
    for r in quotes.toLocalIterator():
        block.append(r["quote"])
        size += len(r["quote"])
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def holders(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote, source_key) of each different quote, not empty, in each of (source_key, text) that holds it whole. Quotes are
    taken in blocks of bounded size, one block at a time on the driver, each with a pass over the texts."""
    out = texts.sparkSession.createDataFrame([], "quote string, source_key bigint")
    for block in _blocks(quotes):
        out = out.unionByName(texts.select("source_key", "text").mapInArrow(partial(_held, passages=block), "quote string, source_key bigint"))
    return out
