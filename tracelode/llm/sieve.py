"""A semi-join filter of fixed size: most rows that a join would drop are dropped in the scan, before any exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap; it is broadcast, and never larger than 2 MB however many ids it holds. Above its capacity it
#: passes more rows, which the join that follows drops.
BITS = 1 << 24
_CELL = 32_768


def sieved(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key may be in ids[key]: all that are, and few others."""
    position = F.pmod(F.xxhash64(key), F.lit(BITS))
    bitmap = ids.select(position.alias("p")).groupBy(F.expr(f"p div {_CELL}").alias("cell")).agg(F.expr(f"bitmap_construct_agg(p % {_CELL})").alias("bits"))
    at = F.pmod(F.xxhash64(key), F.lit(_CELL))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("bigint")
    placed = rows.withColumns({"cell": F.expr(f"pmod(xxhash64({key}), {BITS}) div {_CELL}"), "at": at})
    return placed.join(F.broadcast(bitmap), "cell").where(F.getbit(byte, F.expr("cast(at % 8 as int)")) == 1).drop("cell", "at", "bits")
