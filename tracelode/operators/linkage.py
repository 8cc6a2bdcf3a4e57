"""Records that share a key are one, transitively: connected components by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.tables import cut


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) of links (id, key): the least id reachable over shared keys.

    Each round gives every key its ids' least label and every id its keys' least label, then jumps to its label's
    label, so long chains shrink by half. Both steps are aggregates with partial sums, so a key that a third of all
    records have is never gathered. Every round is checkpointed; ids and labels never reach the driver."""
    links = cut(links.where("key is not null").select("id", "key").distinct())
    labels = cut(links.select("id", F.col("id").alias("component")).distinct())
    for _ in range(most):
        by_key = links.join(labels, "id").groupBy("key").agg(F.min("component").alias("least"))
        by_id = links.join(by_key, "key").groupBy("id").agg(F.min("least").alias("least"))
        hop = labels.select(F.col("id").alias("least"), F.col("component").alias("jump"))
        after = cut(by_id.join(hop, "least", "left").select("id", F.least("least", F.coalesce("jump", "least")).alias("component")))
        if after.join(labels.withColumnRenamed("component", "before"), "id").where("component <> before").isEmpty():
            return after
        labels = after
    raise RuntimeError("components did not settle")
