"""The three reads of the application: series, event search and trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullspark.operators import series
from lullspark.operators.events import find_events
from lullspark.operators.level_sets import CHUNK_MS, events_of
from lullspark.operators.trend import trailing_event_trend
from lullspark.registry import check_range, check_region, check_resolution, step_ms
from lullspark.sources.tables import scan, scan_range

SHARE = "share_of_renewable_energies_computed"
# Default search window, threshold and longest minimum duration.
START_MS, END_MS = 1_000_000_000_000, 2_000_000_000_000
MAX_SHARE = 0.3
MAX_MIN_DURATION_MS = 4 * step_ms("week")


def _check(max_share: float, min_duration_ms: int) -> None:
    if not 0 <= max_share <= 1:
        raise ValueError(f"bad share: {max_share}")
    if not 0 <= min_duration_ms <= MAX_MIN_DURATION_MS:
        raise ValueError(f"bad minimum duration: {min_duration_ms}")


def stored_series(
    spark: SparkSession, root: str, name: str, region: str, resolution: str, start_ms: int, end_ms: int
) -> DataFrame:
    """One series of a published table in a closed time range; other spans are not opened."""
    check_region(region), check_resolution(resolution), check_range(start_ms, end_ms)
    return scan_range(spark, root, name, series.TS, start_ms, end_ms, {"region": region, "resolution": resolution})


def search_events(
    share_rows: DataFrame,
    region: str = "DE",
    resolution: str = "day",
    max_share: float = MAX_SHARE,
    min_duration_ms: int = step_ms("day"),
    start_ms: int = START_MS,
    end_ms: int = END_MS,
    value: str = SHARE,
) -> DataFrame:
    """Events of one series in a closed time range, in UTC ms."""
    _check(max_share, min_duration_ms)
    cut = series.slice_series(share_rows, region, resolution, start_ms, end_ms)
    return find_events(cut, value, max_share, min_duration_ms).select("start_time", "region", "resolution", "end_time")


def stored_sets(
    spark: SparkSession, root: str, region: str, resolution: str, start_ms: int, end_ms: int | None
) -> tuple[DataFrame, int]:
    """The stored level sets of one series from ``start_ms`` on, and the instant of its first
    row from there on. Of the series itself at most one chunk is read."""
    own, chunk = {"region": region, "resolution": resolution}, start_ms // CHUNK_MS * CHUNK_MS
    end = END_MS if end_ms is None else end_ms
    chunks = scan_range(spark, root, "level_sets", "chunk_start", chunk, end, own)
    begun = scan_range(spark, root, "shares", series.TS, start_ms, min(end, chunk + CHUNK_MS - 1), own)
    opens = chunks.where(F.col("opens").between(start_ms, end)).select("opens")
    first = begun.select(series.TS).union(opens).agg(F.min(series.TS).alias("first")).first()["first"]
    upper = scan(spark, root, "level_sets_upper").where((F.col("region") == region) & (F.col("resolution") == resolution))
    sets = chunks.where("opens is null").select(*upper.columns).unionByName(upper)
    return (sets.limit(0), start_ms) if first is None else (sets, first)


def search_stored_events(
    spark: SparkSession,
    root: str,
    region: str = "DE",
    resolution: str = "day",
    max_share: float = MAX_SHARE,
    min_duration_ms: int = step_ms("day"),
    start_ms: int = START_MS,
    end_ms: int = END_MS,
) -> DataFrame:
    """``search_events`` on the stored level sets: a filter for any threshold, duration and
    range."""
    _check(max_share, min_duration_ms)
    check_region(region), check_resolution(resolution), check_range(start_ms, end_ms)
    sets, first = stored_sets(spark, root, region, resolution, start_ms, end_ms)
    found = events_of(sets, max_share, min_duration_ms, first=first, last=end_ms)
    return found.select("start_time", "region", "resolution", "end_time")


def event_trend(
    share_rows: DataFrame,
    region: str = "DE",
    resolution: str = "day",
    max_share: float = MAX_SHARE,
    min_duration_ms: int = step_ms("day"),
    start_ms: int = START_MS,
    end_ms: int = END_MS,
    value: str = SHARE,
    skip: int = 365,
    fill: bool = False,
) -> DataFrame:
    """Trailing-year counts on the daily series, whatever resolution the search uses."""
    check_region(region), check_resolution(resolution), check_range(start_ms, end_ms)
    events = search_events(share_rows, region, resolution, max_share, min_duration_ms, start_ms, end_ms, value)
    days = series.slice_series(share_rows, region, "day", start_ms, end_ms)
    trend = trailing_event_trend(days, events, ["region"], skip=skip, fill=fill)
    return trend.drop("region").orderBy(F.col("unix_timestamp_ms"))
