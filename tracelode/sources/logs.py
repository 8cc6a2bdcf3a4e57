"""Line-by-line JSON that may be torn, judgement sets, and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; lines that do not parse are skipped."""
    parsed = spark.read.text(path).select("value", F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNotNull().alias("whole"))
    return parsed.where("whole and r is not null").select("r.*")


def last_records(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def judgements(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A retrieval set made clean: texts with their title before them, grades above zero on known documents, and queries
    that have one. Columns: corpus (id, title, text), queries (qid, text), qrels (qid, id, grade)."""
    texts = corpus.select("id", F.trim(F.concat_ws("\n", F.when(F.col("title") != "", F.col("title")), "text")).alias("text"))
    good = qrels.where("grade > 0").join(texts.select("id"), "id", "left_semi")
    return texts, queries.join(good.select("qid").distinct(), "qid", "left_semi"), good


def write_whole(df: DataFrame, path: str) -> None:
    """All or nothing, by Spark's commit protocol."""
    df.write.mode("overwrite").parquet(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _embed(batches: Iterator[pa.RecordBatch], model: Callable[[list[str]], list[list[float]]], size: int) -> Iterator[pa.RecordBatch]:
    import numpy as np

    def vectors(texts: list[str]) -> list[list[float] | None]:
        """A refused batch is halved; a refused text is halved until it is 64 characters."""
        try:
            return model(texts)
        except ValueError:
            if len(texts) > 1:
                half = len(texts) // 2
                return vectors(texts[:half]) + vectors(texts[half:])
            return vectors([texts[0][: len(texts[0]) // 2]]) if len(texts[0]) > 64 else [None]

    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        out: list = []
        for begin in range(0, len(texts), size):
            for v in vectors(texts[begin : begin + size]):
                x = None if v is None else np.asarray(v, np.float64)
                norm = 0.0 if x is None else float(np.sqrt((x * x).sum()))
                out.append(None if not norm or not np.isfinite(norm) else [float(y) for y in (x / norm).astype(np.float16)])
        yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.float32()))], names=["id", "vec"])


def embedded(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], size: int = 32) -> DataFrame:
    """(id, vec) by an injected model, in batches; vectors have unit length and half precision; null where the model
    gives nothing usable."""
    return texts.select("id", "text").where("text is not null").mapInArrow(partial(_embed, model=model, size=size), "id bigint, vec array<float>")
