"""Derived series, and the reads that combine raw and derived ones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullspark.functions import clock, shares
from lullspark.operators.chunks import CHUNK, row_index, with_time_chunk
from lullspark.registry import (
    KEYS,
    STEP_MS,
    check_range,
    check_region,
    check_resolution,
    series_columns,
)

TS = "unix_timestamp_ms"
SERIES = ("region", "resolution")
CHUNK_MS = 28 * 86_400_000


def share_series(market: DataFrame, lenient: bool = False) -> DataFrame:
    """Wind+solar sum and share, renewable share and net import of valid rows."""
    return market.where(shares.valid_share_row()).select(
        *KEYS,
        shares.wind_solar_sum(lenient).alias("sum_of_photovoltaic_wind_onshore_offshore_computed"),
        shares.wind_solar_share(lenient).alias("share_of_photovoltaic_wind_onshore_offshore_computed"),
        shares.renewable_share(lenient).alias("share_of_renewable_energies_computed"),
        shares.net_import(lenient).alias("import_to_validate"),
    )


def previous_value(
    df: DataFrame, value: str, keys: Sequence[str] = SERIES, ts: str = TS, chunk_ms: int = CHUNK_MS
) -> DataFrame:
    """Adds ``last_time`` and ``last_value`` of the row before, however far back it is.

    Rows look back within their chunk; the first of a chunk gets the last row of the
    chunk before it that has any, from a table of one row per chunk. A null key is a key
    like any other; a row without a time has no row before it and is before no row.
    """
    by_chunk = [*keys, CHUNK]
    rows = with_time_chunk(df, ts, chunk_ms)
    last = rows.groupBy(*by_chunk).agg(F.max(ts).alias("_t"), F.max_by(value, ts).alias("_v"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK)
    carried = last.select(
        *by_chunk, F.lag("_t").over(earlier).alias("_time"), F.lag("_v").over(earlier).alias("_value")
    )
    inside = Window.partitionBy(*by_chunk).orderBy(ts)
    near = rows.withColumns(
        {"_first": F.row_number().over(inside) == 1, "_lt": F.lag(ts).over(inside), "_lv": F.lag(value).over(inside)}
    )
    n, c = near.alias("n"), carried.alias("c")
    same = reduce(and_, [F.col(f"n.{k}").eqNullSafe(F.col(f"c.{k}")) for k in by_chunk])
    timed = F.col(f"n.{ts}").isNotNull()
    return n.join(c, same).select(
        *[F.col(f"n.{name}") for name in df.columns],
        F.when(timed, F.when(F.col("_first"), F.col("_time")).otherwise(F.col("_lt"))).alias("last_time"),
        F.when(timed, F.when(F.col("_first"), F.col("_value")).otherwise(F.col("_lv"))).alias("last_value"),
    )


def previous_within(
    df: DataFrame,
    value: str,
    reach_ms: Column,
    keys: Sequence[str] = SERIES,
    ts: str = TS,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Adds ``last_time`` and ``last_value`` of the row before, looking back ``reach_ms``.

    A row is copied into the next chunk when the border is within reach, so one
    shuffle by ``(keys, chunk)`` is enough. Rows further back are not seen: the
    result is exact wherever the distance to the row before is at most the reach,
    and null where it is more. A reach above ``chunk_ms`` is an error.
    """
    keys = list(keys)
    too_far = F.raise_error(F.lit("the reach exceeds the chunk")).cast("long")
    reach = F.when(reach_ms <= F.lit(chunk_ms), reach_ms).when(reach_ms.isNotNull(), too_far)
    rows = with_time_chunk(df, ts, chunk_ms).withColumn("_reach", reach)
    border = (F.col(CHUNK) + 1) * F.lit(chunk_ms)
    homes = F.when(
        F.col(ts) + F.col("_reach") >= border, F.array(F.col(CHUNK), F.col(CHUNK) + 1)
    ).otherwise(F.array(F.col(CHUNK)))
    spread = rows.withColumn("_home", F.explode(homes))
    inside = Window.partitionBy(*keys, "_home").orderBy(ts)
    near = F.col(ts) - F.lag(ts).over(inside) <= F.col("_reach")
    return (
        spread.withColumns(
            {
                "last_time": F.when(near, F.lag(ts).over(inside)),
                "last_value": F.when(near, F.lag(value).over(inside)),
            }
        )
        .where(F.col("_home") == F.col(CHUNK))
        .drop("_home", "_reach", CHUNK)
    )


def price_change(
    market: DataFrame,
    price: str = "market_price_ger_lux",
    lenient: bool = False,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Absolute and relative price change against the row exactly one step before.

    Month and year rows have no fixed step and never qualify; neither do the
    local days of 23 or 25 hours.
    """
    step = clock.step_of(F.col("resolution"))
    stepped = market.where(F.col("resolution").isin(list(STEP_MS))).select(*KEYS, price)
    paired = previous_within(stepped, price, step, chunk_ms=chunk_ms)
    current, last = F.col(price), F.col("last_value")
    return paired.where(
        current.isNotNull() & last.isNotNull() & (last != 0) & (F.col(TS) - F.col("last_time") == step)
    ).select(
        *KEYS,
        current.alias("current_price"),
        "last_time",
        last.alias("last_price"),
        shares.price_change_abs(current, last, lenient).alias("gerlux_price_change_abs_computed"),
        shares.price_change_rel(current, last, lenient).alias("gerlux_price_change_rel_computed"),
    )


def slice_series(
    df: DataFrame, region: str, resolution: str, start_ms: int, end_ms: int, ts: str = TS
) -> DataFrame:
    """One series in a closed time range; the filters reach the Parquet scan."""
    check_region(region)
    check_resolution(resolution)
    check_range(start_ms, end_ms)
    return df.where(
        (F.col("region") == region) & (F.col("resolution") == resolution) & F.col(ts).between(start_ms, end_ms)
    )


def time_of_interest(df: DataFrame, after_ms: int, ts: str = TS) -> DataFrame:
    """Only instants strictly after ``after_ms``."""
    return df.where(F.col(ts) > F.lit(after_ms))


def combine_derived(prices: DataFrame, share_rows: DataFrame) -> DataFrame:
    """Full outer join of the two derived series on their shared key."""
    return prices.join(share_rows, KEYS, "full")


def attach_weather(
    series: DataFrame, weather: DataFrame, how: str = "left", wall: bool = False, tz: str = clock.BERLIN
) -> DataFrame:
    """Weather of the same instant and resolution; only hour and day rows match.

    ``weather`` carries ``date_ms``. ``wall`` compares the series' wall clock with
    it instead of the instant.
    """
    at = clock.to_wall_clock(F.col(TS), tz) if wall else F.col(TS)
    known = weather.where(F.col("resolution").isin("hour", "day")).withColumnRenamed("resolution", "_res")
    keyed = series.withColumn("_at", at)
    joined = keyed.join(known, (F.col("_at") == F.col("date_ms")) & (F.col("resolution") == F.col("_res")), how)
    return joined.drop("_at", "_res", "date_ms")


def merge_series(raw: DataFrame, derived: DataFrame) -> DataFrame:
    """Raw and derived columns side by side; a missing side is null."""
    return raw.join(derived, KEYS, "full")


def drop_empty_rows(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Sentinels become null; rows without any value go."""
    cleared = df.withColumns({m: shares.clear_sentinel(F.col(m)) for m in measures})
    return cleared.dropna(how="all", subset=list(measures))


def read_series(
    market: DataFrame,
    share_rows: DataFrame,
    prices: DataFrame,
    weather: DataFrame,
    ids: list[int] | None,
    region: str,
    resolution: str,
    start_ms: int,
    end_ms: int,
    wall: bool = False,
    tz: str = clock.BERLIN,
) -> DataFrame:
    """The selected series of one region and resolution, ordered, in wall-clock time.

    Joins use the instant; the wall clock, which repeats an hour in autumn, is only
    put on at the end.
    """
    raw_cols, derived_cols = series_columns(ids)

    def cut(df: DataFrame) -> DataFrame:
        return slice_series(df, region, resolution, start_ms, end_ms)

    parts = []
    if raw_cols:
        parts.append(cut(market).select(*KEYS, *raw_cols))
    if derived_cols:
        both = attach_weather(combine_derived(cut(prices), cut(share_rows)), weather, wall=wall, tz=tz)
        parts.append(both.select(*KEYS, *derived_cols))
    rows = merge_series(*parts) if len(parts) == 2 else parts[0]
    measures = [*raw_cols, *derived_cols]
    kept = drop_empty_rows(rows, measures)
    return kept.withColumn(TS, clock.to_wall_clock(F.col(TS), tz)).select(*KEYS, *measures).orderBy(TS)


def moving_average(
    df: DataFrame,
    value: str,
    period: int,
    keys: Sequence[str] = SERIES,
    ts: str = TS,
    compat: bool = False,
    chunk_ms: int = CHUNK_MS,
    block_rows: int = 65_536,
) -> DataFrame:
    """Mean time and mean value of every run of ``period`` rows of a series.

    Rows are numbered once, then cut into blocks of ``block_rows``; a block also
    gets the rows after it that its windows reach, so each is complete in one task.
    A window is the end of one stretch of ``period`` rows and the beginning of the
    next, so two running sums per stretch give every window in constant time, by
    addition only.

    By default nulls are skipped and every full window counts. ``compat`` counts
    null as 0 and leaves out the last two full windows of a series.
    """
    if period < 1:
        raise ValueError(f"bad period: {period}")
    keys = list(keys)
    # Rows that must follow for a window to count.
    ahead = period + 1 if compat else period - 1
    numbered = row_index(with_time_chunk(df.select(*keys, ts, value), ts, chunk_ms), keys, [ts], "_row")
    measured = F.coalesce(F.col(value), F.lit(0)) if compat else F.col(value)
    parts = {"t": F.col(ts), "v": measured.cast("double"), "n": F.when(measured.isNotNull(), F.lit(1)).otherwise(F.lit(0))}
    slots = numbered.select(
        *keys,
        "_row",
        *[col.alias(f"_{name}") for name, col in parts.items()],
        F.expr(f"(_row - 1) div {period}L").alias("_stretch"),
        F.expr(f"(_row - 1) div {block_rows}L").alias("_own"),
        F.explode(
            F.sequence(
                F.expr(f"greatest(_row - {1 + ahead}, 0L) div {block_rows}L"),
                F.expr(f"(_row - 1) div {block_rows}L"),
            )
        ).alias("_block"),
    )
    stretch = Window.partitionBy(*keys, "_block", "_stretch")
    onward = stretch.orderBy(F.col("_row").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = stretch.orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = slots.select(
        *keys,
        "_row",
        "_own",
        "_block",
        *[F.sum(f"_{name}").over(onward).alias(f"_tail_{name}") for name in parts],
        *[F.sum(f"_{name}").over(so_far).alias(f"_head_{name}") for name in parts],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("_row")
    aligned = F.expr(f"(_row - 1) % {period}L") == 0

    def window_sum(name: str) -> Column:
        tail, head = F.col(f"_tail_{name}"), F.lead(f"_head_{name}", period - 1).over(inside)
        return F.when(aligned, tail).otherwise(
            F.when(tail.isNull() & head.isNull(), None).otherwise(F.coalesce(tail, F.lit(0)) + F.coalesce(head, F.lit(0)))
        )

    windows = sums.select(
        *keys,
        *[window_sum(name).alias(name) for name in parts],
        ((F.col("_own") == F.col("_block")) & F.lead("_row", ahead).over(inside).isNotNull()).alias("_full"),
    )
    return windows.where("_full").select(
        *keys,
        F.expr(f"(2 * t + {period} - pmod(2 * t + {period}, {2 * period}L)) div {2 * period}L").alias("mean_time"),
        F.try_divide("v", "n").alias("mean_value"),
    )
