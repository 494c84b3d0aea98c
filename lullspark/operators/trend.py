"""How many events touched the trailing window of each instant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lullspark.operators.chunks import row_index, running_sum, with_time_chunk
from lullspark.session import materialise

DAY_MS = 86_400_000
CHUNK_MS = 365 * DAY_MS


def trailing_event_trend(
    series: DataFrame,
    events: DataFrame,
    keys: Sequence[str] = ("region",),
    ts: str = "unix_timestamp_ms",
    window_ms: int = 365 * DAY_MS,
    skip: int = 365,
    fill: bool = False,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Event count and whole event days in ``(ts - window, ts]`` per series instant.

    An event touches ``ts`` from its start until ``end + window``. So each event is
    a step up and a step down, and the answer is a running total: no event is ever
    paired with an instant. Durations are not clipped to the window. Instants
    without an event are left out unless ``fill``; then the first ``skip`` rows of
    each series are dropped. Rows are numbered chunk by chunk, from totals that are
    stored once, so a series of any length and resolution stays spread.
    """
    keys = list(keys)
    length = F.col("end_time") - F.col("start_time")
    steps = F.array(
        F.struct(F.col("start_time").alias(ts), F.lit(1).cast("long").alias("_n"), length.alias("_ms")),
        F.struct(
            (F.col("end_time") + F.lit(window_ms)).alias(ts), F.lit(-1).cast("long").alias("_n"), (-length).alias("_ms")
        ),
    )
    deltas = events.select(*keys, F.inline(steps))
    points = series.select(*keys, ts, F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_ms"))
    marked = deltas.withColumn("_point", F.lit(False)).unionByName(points.withColumn("_point", F.lit(True)))
    totals = running_sum(
        with_time_chunk(marked, ts, chunk_ms),
        keys,
        [ts],
        {"occurrences": F.col("_n"), "_total_ms": F.col("_ms")},
        peers=True,
    ).where(F.col("_point"))
    if not fill:
        totals = totals.where(F.col("occurrences") > 0)
    if skip:
        totals = row_index(materialise(totals), keys, [ts], "_row").where(F.col("_row") > skip)
    return totals.select(
        *keys,
        ts,
        F.col("occurrences").alias("occurrences_in_last_rolling_year"),
        F.expr(f"_total_ms div {DAY_MS}L").alias("total_days_in_last_rolling_year"),
    )
