"""From landed documents to the three base tables of the build.

Each step may be repeated at any time: market documents are imported once and merged,
weather and forecast documents replace the time range that they cover.
"""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullspark.operators.upsert import clear_sentinel
from lullspark.plans.refresh import refresh_table, refresh_tables
from lullspark.registry import MEASURES
from lullspark.session import materialise
from lullspark.sources.tables import SPAN_MS, has_table, publish, replace_stored_range
from lullspark.sources.weather import read_weather_forecast, read_weather_history
from lullspark.streaming.importer import merge_indexes, merge_points

MARKET_PARTS = ["resolution", "region"]
HISTORY_KEY = [["date_ms", "lat", "lng", "model", "temporal_resolution"]]
FORECAST_KEY = [["timestamp_s", "lat", "lng", "model", "temporal_resolution"]]


def ingest_market(
    spark: SparkSession, root: str, points: str, index: str | None = None, lines: bool = False
) -> set | None:
    """Import new market documents and bring the table ``market`` up to date.

    The documents are merged into ``market_import``, series by series and span by span, and
    the spans that changed are written anew in ``market``, with sentinels cleared; whoever
    asks which buckets are without a value finds them in ``market_import``.
    """
    state, name = posixpath.join(root, "market_state"), "market_import"
    if index:
        merge_indexes(spark, index, root, name, state, lines).awaitTermination()
    merge_points(spark, points, root, name, state, lines).awaitTermination()
    return refresh_table(
        spark, root, "market", name, lambda rows: clear_sentinel(rows, MEASURES), MARKET_PARTS, "unix_timestamp_ms", MARKET_PARTS
    )


def _replace_covered(
    rows: DataFrame, root: str, name: str, ts: str, key: Sequence[Sequence[str]], covered: tuple[int, int] | None
) -> list[str] | None:
    """Replace the half-open range ``covered``, or else that from the first to the last instant."""
    spark = rows.sparkSession
    if not has_table(spark, root, name):
        width = SPAN_MS if ts.endswith("_ms") else SPAN_MS // 1000
        return publish(rows, root, name, candidates=key, ts=ts, width=width)
    if covered is None:
        rows = materialise(rows)
        lo, hi = rows.agg(F.min(ts), F.max(ts) + 1).first()
        if lo is None:
            return None
        covered = lo, hi
    return replace_stored_range(rows, root, name, ts, *covered, candidates=key)


def ingest_weather(
    spark: SparkSession, root: str, path: str, lines: bool = False, covered_ms: tuple[int, int] | None = None
) -> list[str] | None:
    """Landed weather history as the table ``weather_points``."""
    rows = read_weather_history(spark, path, lines)
    return _replace_covered(rows, root, "weather_points", "date_ms", HISTORY_KEY, covered_ms)


def ingest_forecast(
    spark: SparkSession, root: str, path: str, lines: bool = False, covered_s: tuple[int, int] | None = None
) -> list[str] | None:
    """Landed forecasts as the table ``forecast_points``."""
    rows = read_weather_forecast(spark, path, lines)
    return _replace_covered(rows, root, "forecast_points", "timestamp_s", FORECAST_KEY, covered_s)


def ingest_and_build(
    spark: SparkSession,
    root: str,
    points: str,
    weather: str,
    forecast: str,
    index: str | None = None,
    lines: bool = False,
    **event_options,
) -> list[str]:
    """All base tables from landed documents, then every derived table; returns their names.

    Repeated, it reads and writes only what new documents touch and reach.
    """
    ingest_market(spark, root, points, index, lines)
    ingest_weather(spark, root, weather, lines)
    ingest_forecast(spark, root, forecast, lines)
    refresh_tables(spark, root, **event_options)
    return ["market", "weather_points", "forecast_points", "shares", "price_changes", "forecasts", "weather", "events"]
