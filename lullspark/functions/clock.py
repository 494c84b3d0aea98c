"""Instants, wall clocks and durations. Instants are epoch milliseconds (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lullspark.registry import STEP_MS

BERLIN = "Europe/Berlin"
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
WEEK_MS = 604_800_000


def to_wall_clock(ms: Column, tz: str = BERLIN) -> Column:
    """Local wall-clock time written as if it were epoch ms.

    Two instants share one wall clock when clocks go back, so never join on it.
    """
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), tz))


def local_datetime(ms: Column, tz: str = BERLIN) -> Column:
    """Wall clock as TIMESTAMP_NTZ, whatever the session zone is."""
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (ms / F.lit(1000)).cast("decimal(18,6)")
    )
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def local_year(ms: Column, tz: str = BERLIN) -> Column:
    return F.year(local_datetime(ms, tz))


def local_label(ms: Column, pattern: str = "yyyy/MM/dd HH:mm", tz: str = BERLIN) -> Column:
    return F.date_format(local_datetime(ms, tz), pattern)


def _by_resolution(resolution: Column, values: dict[str, int]) -> Column:
    picked = None
    for name, value in values.items():
        hit = resolution == name
        picked = F.when(hit, F.lit(value)) if picked is None else picked.when(hit, F.lit(value))
    return picked.cast("long")


def step_of(resolution: Column) -> Column:
    """Expected distance of neighbouring rows; null for month and year."""
    return _by_resolution(resolution, STEP_MS)


def duration_ms(n: Column, resolution: Column) -> Column:
    """``n`` steps in ms; an error for resolutions without a fixed step."""
    step = F.coalesce(
        step_of(resolution),
        F.raise_error(F.concat(F.lit("resolution without a fixed step: "), resolution)).cast("long"),
    )
    return n * step


def duration_parts(ms: Column) -> dict[str, Column]:
    return {
        "hours": ms / F.lit(HOUR_MS),
        "days": ms / F.lit(DAY_MS),
        "weeks": ms / F.lit(WEEK_MS),
    }


def steps_per_hour(resolution: Column) -> Column:
    """Energy of a quarter hour times 4 is its power; other steps count as 1."""
    return F.when(resolution == "quarterhour", F.lit(4)).otherwise(F.lit(1))


def energy_to_power(value: Column, resolution: Column) -> Column:
    return value * steps_per_hour(resolution)
