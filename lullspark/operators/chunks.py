"""Ordered scans over series of any length.

``Window.partitionBy(series)`` puts a whole series into one task, and one series
may hold a third of all rows. Every scan here works on ``(keys, chunk)`` instead,
where chunks are ordered and small, and carries what crosses a chunk border
through a table of one row per chunk.

A chunk is either a span of time (``time_chunk``: bounded because an instant
occurs once per series) or a slice of a range-partitioned sort
(``range_chunks``: bounded whatever the values are). Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullspark.session import materialise

CHUNK = "_chunk"
DAY_MS = 86_400_000


def time_chunk(ts: str, width_ms: int) -> Column:
    return F.expr(f"(`{ts}` - pmod(`{ts}`, {width_ms}L)) div {width_ms}L")


def with_time_chunk(df: DataFrame, ts: str, width_ms: int) -> DataFrame:
    return df.withColumn(CHUNK, time_chunk(ts, width_ms))


def range_chunks(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Sort globally and number the sorted partitions.

    The range partitioner splits hot keys and hot values as long as ``order``
    tells rows apart. Its cut points come from a sample, so the sorted rows are
    checkpointed: chunk totals and chunk rows then read the same files.
    """
    return materialise(df.orderBy(*order).withColumn(CHUNK, F.spark_partition_id().cast("long")))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: dict[str, Column],
    peers: bool = False,
) -> DataFrame:
    """Running totals per series in ``order``; ``df`` carries ``_chunk``.

    With ``peers`` rows equal in ``order`` share one total (they must then be in
    one chunk, as rows of one instant are).
    """
    keys = list(keys)
    by_chunk = [*keys, CHUNK]
    valued = df.select("*", *[value.alias(f"_v_{out}") for out, value in sums.items()])
    totals = df.groupBy(*by_chunk).agg(
        *[F.sum(value).alias(f"_t_{out}") for out, value in sums.items()]
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by_chunk, *[F.sum(f"_t_{out}").over(before).alias(f"_o_{out}") for out in sums]
    )
    inside = Window.partitionBy(*by_chunk).orderBy(*order)
    inside = (
        inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        if peers
        else inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = valued.select("*", *[F.sum(f"_v_{out}").over(inside).alias(f"_r_{out}") for out in sums])
    return local.join(offsets, by_chunk, "left").select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"_r_{out}"), F.lit(0)) + F.coalesce(F.col(f"_o_{out}"), F.lit(0))).alias(out)
            for out in sums
        ],
    )


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str) -> DataFrame:
    """1-based row number per series; ``df`` carries ``_chunk``."""
    return running_sum(df, keys, order, {out: F.lit(1).cast("long")})
