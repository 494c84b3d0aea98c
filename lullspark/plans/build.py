"""The batch build: derived tables in dependency order, and all thresholds at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullspark.operators import enrich, level_sets, series, weather
from lullspark.operators.chunks import CHUNK
from lullspark.operators.events import find_events
from lullspark.operators.upsert import clear_sentinel
from lullspark.registry import MEASURES, THRESHOLDS
from lullspark.session import materialise
from lullspark.sources.tables import SPAN_MS, publish, scan

DAY_MS = 86_400_000
SHARE = "share_of_renewable_energies_computed"
SERIES_PARTS = ["resolution", "region"]
WEATHER_KEY = [["date_ms", "resolution"]]
EVENT_KEY = [["threshold_percent", "region", "resolution", "start_time", "end_time"]]


def enriched_thresholds(
    market: DataFrame,
    share_rows: DataFrame,
    weather_rows: DataFrame,
    thresholds: Sequence[float] = THRESHOLDS,
    region: str = "DE",
    resolution: str = "quarterhour",
    after_ms: int = enrich.PRICES_SINCE_MS,
    min_duration_ms: int = DAY_MS,
    margin_ms: int = enrich.WEEK_MS,
    value: str = "share_of_renewable_energies_computed",
) -> DataFrame:
    """Enriched events of every threshold as one table, in one pass over the series.

    ``threshold_percent`` is the rounded percentage that names a threshold.
    """

    def picked(df: DataFrame) -> DataFrame:
        return df.where((F.col("region") == region) & (F.col("resolution") == resolution))

    found = find_events(
        series.time_of_interest(picked(share_rows), after_ms),
        value,
        thresholds,
        min_duration_ms,
    )
    # The search runs once; load, price and weather statistics all read its result.
    events = materialise(found)
    enriched = enrich.enrich_events(events, picked(market), weather_rows, margin_ms)
    return enriched.withColumn("threshold_percent", F.round(F.col("threshold") * 100).cast("int"))


def publish_level_sets(spark: SparkSession, root: str, value: str = SHARE) -> None:
    """The level-set tree of the published shares: the table ``level_sets`` of chunks, cut
    by time so that a chunk can be replaced, and ``level_sets_upper`` of what spans chunks."""
    publish(stored_chunks(scan(spark, root, "shares"), value), root, "level_sets", SERIES_PARTS, check_key=False, ts="chunk_start")
    publish_upper_sets(spark, root)


def stored_chunks(share_rows: DataFrame, value: str = SHARE) -> DataFrame:
    chunks = level_sets.chunk_sets(share_rows, value)
    return chunks.withColumn("chunk_start", F.col(CHUNK) * level_sets.CHUNK_MS).drop(CHUNK)


def publish_upper_sets(spark: SparkSession, root: str) -> None:
    stored = scan(spark, root, "level_sets").where("opens is not null")
    summaries = stored.withColumn(CHUNK, F.expr(f"chunk_start div {level_sets.CHUNK_MS}L"))
    publish(level_sets.upper_sets(summaries), root, "level_sets_upper", SERIES_PARTS, check_key=False)


def build_tables(
    spark: SparkSession,
    root: str,
    market: str = "market",
    weather_points: str = "weather_points",
    forecast_points: str = "forecast_points",
    **event_options,
) -> list[str]:
    """Publish every derived table under ``root``; returns their names in order.

    Each step reads the published tables before it, so a rerun may start anywhere.
    The market table may still hold sentinels of an import; here they become null.
    """
    landed = scan(spark, root, market)
    source = clear_sentinel(landed, [c for c in MEASURES if c in landed.columns])
    of_time = {"ts": "unix_timestamp_ms"}
    publish(series.share_series(source), root, "shares", SERIES_PARTS, **of_time)
    publish(series.price_change(source), root, "price_changes", SERIES_PARTS, **of_time)
    forecasts = weather.aggregate_forecast(scan(spark, root, forecast_points))
    publish(forecasts, root, "forecasts", ["model"], ts="timestamp_s", width=SPAN_MS // 1000)
    history = weather.weather_history(scan(spark, root, weather_points))
    publish(history, root, "weather", ["resolution"], WEATHER_KEY, ts="date_ms")
    events = enriched_thresholds(
        source, scan(spark, root, "shares"), scan(spark, root, "weather"), **event_options
    )
    publish(events, root, "events", ["threshold_percent"], EVENT_KEY, ts="start_time")
    return ["shares", "price_changes", "forecasts", "weather", "events"]
