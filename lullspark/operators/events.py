"""Low-share events: maximal runs at or below a threshold.

All thresholds are searched in one pass. A value is coded by how many of the
sorted thresholds it exceeds, so it is LOW for threshold ``i`` exactly when its
level is at most ``i``. The rows are shuffled once, by series and time chunk,
however many thresholds there are; only rows that open a chunk or change the level
are spread over the thresholds.

A run that starts and ends inside a chunk is final there. What touches a chunk
border goes through a table of at most two rows per chunk and threshold, where
runs that continue are put together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullspark.operators.chunks import CHUNK, with_time_chunk

SERIES = ("region", "resolution")
CHUNK_MS = 28 * 86_400_000


def _level(value: Column, thresholds: Sequence[float]) -> Column:
    above = F.lit(0)
    for t in thresholds:
        above = above + F.when(value > F.lit(t), F.lit(1)).otherwise(F.lit(0))
    return F.when(value.isNull(), F.lit(len(thresholds))).otherwise(above)


def low_runs(
    df: DataFrame,
    value: str,
    thresholds: Sequence[float],
    keys: Sequence[str] = SERIES,
    ts: str = "unix_timestamp_ms",
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """``*keys, threshold, start_time, end_time`` of every run.

    The end is the first instant that is HIGH again, null for a run still open
    where the series stops. Null values are HIGH, missing rows are not seen.
    """
    keys = list(keys)
    cuts = sorted(set(thresholds))
    by_chunk = [*keys, CHUNK]
    coded = with_time_chunk(df.select(*keys, ts, _level(F.col(value), cuts).alias("_level")), ts, chunk_ms)
    inside = Window.partitionBy(*by_chunk).orderBy(ts)
    marked = coded.withColumn("_from", F.lag("_level").over(inside)).where(
        F.col("_from").isNull() | (F.col("_from") != F.col("_level"))
    )
    opens = F.col("_from").isNull()
    crossed = F.when(opens, F.sequence(F.lit(0), F.lit(len(cuts) - 1))).otherwise(
        F.sequence(F.least("_from", "_level"), F.greatest("_from", "_level") - 1)
    )
    markers = marked.select(
        *by_chunk, F.col(ts).alias("_at"), "_level", opens.alias("_opens"), F.explode(crossed).alias("_cut")
    ).select(*by_chunk, "_at", "_opens", "_cut", (F.col("_level") <= F.col("_cut")).alias("_low"))
    # Markers of one chunk and threshold alternate, so a run ends at the next one.
    along = Window.partitionBy(*by_chunk, "_cut").orderBy("_at")
    spans = markers.withColumn("_end", F.lead("_at").over(along))
    unfinished = F.col("_low") & F.col("_end").isNull()
    edge = F.col("_opens") | unfinished
    kept = spans.where(F.col("_low") | F.col("_opens")).select(
        *keys,
        "_cut",
        "_at",
        "_opens",
        "_low",
        unfinished.alias("_unfinished"),
        # The instant this marker's neighbourhood is HIGH again, if it says so.
        F.when(F.col("_low"), F.col("_end")).otherwise(F.col("_at")).alias("_high"),
        # Runs inside a chunk are final and stay apart; what touches a border meets by series.
        F.when(~edge, F.col(CHUNK)).alias("_place"),
    )
    series = Window.partitionBy(*keys, "_cut", "_place")
    forward = series.orderBy("_at")
    onward = series.orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        kept.select(
            *keys,
            "_cut",
            "_at",
            (F.col("_low") & ~(F.col("_opens") & F.lag("_unfinished", 1, False).over(forward))).alias("_starts"),
            F.last("_high", ignorenulls=True).over(onward).alias("_end"),
        )
        .where("_starts")
        .select(
            *keys,
            F.get(F.array(*[F.lit(float(c)) for c in cuts]), F.col("_cut")).alias("threshold"),
            F.col("_at").alias("start_time"),
            F.col("_end").alias("end_time"),
        )
    )


def transitions(
    df: DataFrame,
    value: str,
    thresholds: Sequence[float],
    keys: Sequence[str] = SERIES,
    ts: str = "unix_timestamp_ms",
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """``*keys, threshold, ts, event_bucket``: START and END instants. A series begins HIGH."""
    runs = low_runs(df, value, thresholds, keys, ts, chunk_ms)
    points = F.array(
        F.struct(F.col("start_time").alias(ts), F.lit("START").alias("event_bucket")),
        F.struct(F.col("end_time").alias(ts), F.lit("END").alias("event_bucket")),
    )
    return runs.select(*keys, "threshold", F.inline(points)).where(F.col(ts).isNotNull())


def find_events(
    df: DataFrame,
    value: str,
    thresholds: float | Sequence[float],
    min_duration_ms: int = 86_400_000,
    keys: Sequence[str] = SERIES,
    ts: str = "unix_timestamp_ms",
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """``start_time, *keys, end_time, threshold`` of runs of a minimum duration.

    A run still open where the series stops ends at its own start, so any positive
    minimum duration drops it.
    """
    cuts = [thresholds] if isinstance(thresholds, (int, float)) else list(thresholds)
    runs = low_runs(df, value, cuts, keys, ts, chunk_ms)
    end = F.coalesce("end_time", "start_time")
    return runs.where(end - F.col("start_time") >= F.lit(min_duration_ms)).select(
        "start_time", *keys, end.alias("end_time"), "threshold"
    )
