"""Every operator on the driver's tables, one query each."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lullspark.functions import clock, indices, labels, shares
from lullspark.operators import analyses, correlation, enrich, series, upsert, weather
from lullspark.operators.events import find_events, transitions
from lullspark.operators.level_sets import events_of, level_sets
from lullspark.operators.trend import trailing_event_trend
from lullspark.plans import build, ingest, requests
from lullspark.plans import projections as P
from lullspark.registry import KEYS, REGIONS, RESOLUTIONS, THRESHOLDS, registry_frame
from lullspark.session import materialise, shared_checkpoint_dir
from lullspark.sources import market as market_docs
from lullspark.sources import tables
from lullspark.sources import weather as weather_docs
from lullspark.streaming import live

HOUR, DAY, WEEK = clock.HOUR_MS, clock.DAY_MS, clock.WEEK_MS
JAN, TENTH, TWENTIETH = P.JAN_2024_MS, P.JAN_2024_MS + 9 * DAY, P.JAN_2024_MS + 19 * DAY
WS_SHARE = "share_of_photovoltaic_wind_onshore_offshore_computed"
RE_SHARE = "share_of_renewable_energies_computed"
SEARCH = [0.3, 0.35, 0.4]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def plain(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Decimals as doubles; doubles rounded when asked."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        if digits is not None and isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        out.append(c.alias(f.name))
    return df.select(*out)


# --- shared inputs ----------------------------------------------------------


def hour_shares(spark: SparkSession, sf: str, resolution: str = "hour") -> DataFrame:
    grid = P.market_grid(spark, sf, resolution)
    pair = shares.share_from_pair(F.col("power_consumption_residual_load"), F.col("power_consumption_total"))
    return grid.select(*KEYS, pair.alias("share"))


def sparse_price(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly grid whose price is missing where residual load is over two thirds."""
    known = F.col("power_consumption_residual_load") * 3 <= F.col("power_consumption_total") * 2
    return P.market_grid(spark, sf).withColumn("market_price_ger_lux", F.when(known, F.col("market_price_ger_lux")))


def quarter_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = series.share_series(P.market_grid(spark, sf, "quarterhour"))
    # Searched once; the statistics read the events for their pieces and for blank rows.
    return materialise(find_events(rows, WS_SHARE, SEARCH, HOUR))


def january_weather(spark: SparkSession, sf: str) -> DataFrame:
    points = P.weather_points(spark, sf, P.IN_JANUARY)
    return weather.aggregate_weather(points, "hour")


def daily_market(spark: SparkSession, sf: str) -> DataFrame:
    days = P.daily_by_region(spark, sf)
    return days.select(
        *KEYS,
        "share",
        F.col("price").alias("market_price_ger_lux"),
        F.col("load").alias("power_consumption_total"),
        F.col("load").alias("power_consumption_residual_load"),
    )


# --- events -----------------------------------------------------------------


@query
def find_events_hourly(spark, sf):
    return find_events(hour_shares(spark, sf), "share", 0.35, HOUR)


@query
def find_events_quarterhour(spark, sf):
    return find_events(hour_shares(spark, sf, "quarterhour"), "share", 0.35, HOUR)


@query
def find_events_daily_by_region(spark, sf):
    return find_events(P.daily_by_region(spark, sf), "share", 0.35, DAY)


@query
def events_multi_threshold(spark, sf):
    return find_events(hour_shares(spark, sf), "share", THRESHOLDS, HOUR)


@query
def search_events(spark, sf):
    rows = series.share_series(P.market_grid(spark, sf))
    return requests.search_events(rows, "DE", "hour", 0.35, 2 * HOUR, JAN, TWENTIETH, WS_SHARE)


@query
def search_stored_events(spark, sf):
    """The same search on the stored level-set tree of the published shares."""
    root = posixpath.join(shared_checkpoint_dir(spark), f"levels-{uuid.uuid4().hex}")
    rows = series.share_series(P.market_grid(spark, sf))
    tables.publish(rows, root, "shares", build.SERIES_PARTS, ts=series.TS)
    build.publish_level_sets(spark, root, WS_SHARE)
    return requests.search_stored_events(spark, root, "DE", "hour", 0.35, 2 * HOUR, JAN, TWENTIETH)


@query
def events_level_sets(spark, sf):
    """All thresholds by a filter of the level sets, found once."""
    return events_of(level_sets(hour_shares(spark, sf), "share", chunk_ms=7 * DAY), THRESHOLDS, HOUR)


@query
def state_transitions(spark, sf):
    moves = transitions(P.daily_by_region(spark, sf), "share", SEARCH)
    return moves.select(*KEYS, "threshold", "event_bucket")


@query
def classify_share(spark, sf):
    rows = hour_shares(spark, sf)
    return rows.select(*KEYS, shares.classify(F.col("share"), 0.35).alias("current_share"))


@query
def time_of_interest(spark, sf):
    cut = series.time_of_interest(hour_shares(spark, sf), TENTH)
    return find_events(cut, "share", 0.35, HOUR)


@query
def events_in_trailing_window(spark, sf):
    days = materialise(P.daily_by_region(spark, sf))
    events = find_events(days, "share", SEARCH, DAY)
    points = days.select(*KEYS, F.explode(F.array(*[F.lit(t) for t in SEARCH])).alias("threshold"))
    return trailing_event_trend(points, events, ["region", "threshold"], window_ms=30 * DAY, skip=0)


@query
def q_trailing_event_trend(spark, sf):
    days = materialise(P.daily_by_region(spark, sf))
    return trailing_event_trend(days, find_events(days, "share", 0.35, DAY), ["region"])


@query
def trailing_event_trend_filled(spark, sf):
    days = materialise(P.daily_by_region(spark, sf))
    return trailing_event_trend(days, find_events(days, "share", 0.2, 2 * DAY), ["region"], fill=True)


# --- event statistics -------------------------------------------------------


def event_sums(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.market_sums(quarter_events(spark, sf), P.market_grid(spark, sf, "quarterhour"))


def event_prices(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.price_stats(enrich.load_stats(event_sums(spark, sf)))


@query
def event_load_stats(spark, sf):
    stats = enrich.load_stats(event_sums(spark, sf))
    return plain(
        stats.select(
            *enrich.EVENT, "duration", "avg_res_load_power_during", "res_load_week_before", "res_load_week_after",
            "peak_res_load_power_during", "energy_consumption_during", "avg_res_load_power_before_after",
        )
    )


@query
def event_price_stats(spark, sf):
    return plain(
        event_prices(spark, sf).select(
            *enrich.EVENT, "avg_weighted_price_during", "avg_weighted_price_week_before",
            "avg_weighted_price_week_after", "avg_price_during", "avg_price_week_before", "avg_price_week_after",
        ),
        6,
    )


@query
def event_extent(spark, sf):
    stats = enrich.extent(event_prices(spark, sf))
    return plain(stats.select(*enrich.EVENT, "extent", "storage_made_electricity_value"))


@query
def event_price_delta(spark, sf):
    stats = enrich.price_delta(event_prices(spark, sf))
    return plain(
        stats.select(
            *enrich.EVENT, "price_increase_during", "relative_price_increase_during",
            "price_increase_during_weighted", "relative_price_increase_during_weighted", "in_before_after_range",
        )
    )


@query
def event_cost(spark, sf):
    stats = enrich.cost(enrich.price_delta(event_prices(spark, sf)))
    return plain(stats.select(*enrich.EVENT, "event_cost", "event_cost_weighted"))


@query
def event_calendar(spark, sf):
    dated = enrich.calendar(find_events(P.daily_by_region(spark, sf), "share", SEARCH, DAY))
    return plain(
        dated.select(*enrich.EVENT, "day_of_week", "day_of_month", "month", "year", "duration_ms", "duration_days")
    )


@query
def event_weather_stats(spark, sf):
    return plain(enrich.weather_stats(quarter_events(spark, sf), january_weather(spark, sf)))


@query
def enriched_events(spark, sf):
    market = P.market_grid(spark, sf, "quarterhour")
    full = build.enriched_thresholds(
        market,
        series.share_series(market),
        january_weather(spark, sf),
        after_ms=JAN,
        min_duration_ms=HOUR,
        value=WS_SHARE,
    )
    return plain(full, 6)


@query
def event_feature_matrix(spark, sf):
    stats = enrich.calendar(enrich.price_delta(enrich.extent(event_prices(spark, sf))))
    return plain(
        analyses.event_feature_matrix(
            stats.where(F.col("threshold") == 0.35), "duration_days", "extent", "in_before_after_range",
            "hourly_repi_30mix", min_duration_days=0.05,
        )
    )


@query
def event_feature_matrix_thresholds(spark, sf):
    stats = enrich.calendar(enrich.price_delta(enrich.extent(event_prices(spark, sf))))
    return plain(
        analyses.event_feature_matrix(
            stats, "duration_days", "extent", "in_before_after_range", "hourly_repi_30mix",
            min_duration_days=0.05, keys=["threshold", "start_time"],
        )
    )


# --- derived series ---------------------------------------------------------


@query
def q_shares(spark, sf):
    return plain(series.share_series(P.market_grid(spark, sf)))


@query
def net_import(spark, sf):
    grid = P.market_grid(spark, sf, "quarterhour")
    return plain(grid.select(*KEYS, shares.total_production().alias("total_production"), shares.net_import().alias("net_import")))


@query
def share_from_pair(spark, sf):
    return plain(hour_shares(spark, sf), 9)


@query
def price_change(spark, sf):
    return plain(series.price_change(P.market_grid(spark, sf, "quarterhour")))


@query
def price_change_daily(spark, sf):
    return plain(series.price_change(daily_market(spark, sf)))


@query
def energy_to_power(spark, sf):
    grid = P.market_grid(spark, sf, "quarterhour").unionByName(P.market_grid(spark, sf))
    power = clock.energy_to_power(F.col("power_consumption_residual_load"), F.col("resolution"))
    return plain(grid.select(*KEYS, power.alias("res_load_power")))


@query
def duration_columns(spark, sf):
    events = find_events(hour_shares(spark, sf), "share", 0.35, HOUR)
    length = F.col("end_time") - F.col("start_time")
    steps = F.expr(f"(end_time - start_time) div {HOUR}L")
    return plain(
        events.select(
            "start_time",
            clock.duration_ms(steps, F.col("resolution")).alias("ms"),
            *[c.alias(k) for k, c in clock.duration_parts(length).items()],
        ),
        6,
    )


# --- wide tables ------------------------------------------------------------

FEED_SERIES = ["view", "click", "signup", "purchase", "error"]


@query
def widen_series(spark, sf):
    return plain(upsert.widen(P.long_feed(spark, sf), names=FEED_SERIES))


@query
def union_feeds(spark, sf):
    feed = P.long_feed(spark, sf)
    both = upsert.union_feeds(feed.where("is_bucket_timestamp"), feed.where("not is_bucket_timestamp"))
    return both.groupBy("series", "is_bucket_timestamp").agg(F.count(F.lit(1)).alias("n"))


@query
def union_feeds_rows(spark, sf):
    feed = P.long_feed(spark, sf)
    return plain(upsert.union_feeds(feed.where("is_bucket_timestamp"), feed.where("not is_bucket_timestamp")))


@query
def upsert_sparse(spark, sf):
    feed = P.long_feed(spark, sf)
    base = upsert.widen(feed.where(F.col("unix_timestamp_ms") < TWENTIETH), names=FEED_SERIES)
    delta = upsert.widen(feed.where(F.col("unix_timestamp_ms") >= TENTH), names=FEED_SERIES)
    # The newer half only has prices of the first three kinds.
    delta = delta.withColumns({c: F.lit(None).cast("decimal(11,2)") for c in FEED_SERIES[3:]})
    return plain(upsert.upsert_sparse(base, delta, measures=FEED_SERIES))


@query
def upsert_sparse_whole(spark, sf):
    feed = P.long_feed(spark, sf)
    base = upsert.widen(feed.where(F.col("unix_timestamp_ms") < TWENTIETH), names=FEED_SERIES)
    delta = upsert.widen(feed.where(F.col("unix_timestamp_ms") >= TENTH), names=FEED_SERIES)
    return plain(upsert.upsert_sparse(base, delta, measures=FEED_SERIES))


@query
def bucket_starts(spark, sf):
    return upsert.bucket_starts(upsert.widen(P.long_feed(spark, sf, step_ms=1), names=FEED_SERIES), "view")


@query
def clear_sentinel(spark, sf):
    wide = upsert.widen(P.long_feed(spark, sf), names=FEED_SERIES)
    return plain(upsert.clear_sentinel(wide, FEED_SERIES).drop("is_bucket_timestamp"))


@query
def replace_range(spark, sf):
    points = P.forecast_points(spark, sf).select("timestamp_s", "s_nationkey", "model", "wind_speed_80m")
    lo, hi = 852_076_800, 883_612_800
    fresh = points.where((F.col("timestamp_s") >= lo) & (F.col("timestamp_s") < hi) & (F.col("model") == "A"))
    raised = fresh.withColumn("wind_speed_80m", (F.col("wind_speed_80m") + 1).cast("decimal(11,2)"))
    return plain(upsert.replace_range(points, raised, "timestamp_s", lo, hi, {"model": "A"}))


@query
def outside_range(spark, sf):
    return plain(
        upsert.outside_range(P.daily_by_region(spark, sf).drop("load", "share"), "unix_timestamp_ms", 852_076_800_000, 883_612_800_000)
    )


@query
def assert_unique(spark, sf):
    feed = P.long_feed(spark, sf)
    return upsert.key_violations(feed)


@query
def published_table(spark, sf):
    root = posixpath.join(shared_checkpoint_dir(spark), f"published-{uuid.uuid4().hex}")
    tables.publish(series.share_series(P.market_grid(spark, sf)), root, "shares", ["resolution"])
    return plain(tables.scan(spark, root, "shares"))


@query
def replace_range_stored(spark, sf):
    """A year of one model replaced by its first half, so the second half is emptied."""
    points = P.forecast_points(spark, sf).select("timestamp_s", "s_nationkey", "model", "wind_speed_80m")
    lo, mid, hi = 852_076_800, 867_801_600, 883_612_800
    fresh = points.where((F.col("timestamp_s") >= lo) & (F.col("timestamp_s") < mid) & (F.col("model") == "A"))
    raised = fresh.withColumn("wind_speed_80m", (F.col("wind_speed_80m") + 1).cast("decimal(8,2)"))
    root = posixpath.join(shared_checkpoint_dir(spark), f"replaced-{uuid.uuid4().hex}")
    key = {"candidates": [["timestamp_s", "s_nationkey", "model"]]}
    tables.publish(points, root, "points", ["model"], **key)
    tables.replace_stored_range(raised, root, "points", "timestamp_s", lo, hi, {"model": "A"}, ["model"], **key)
    return plain(tables.scan(spark, root, "points"))


@query
def replace_range_spans(spark, sf):
    """The same replacement in a table cut by time: only the spans of the year are written."""
    points = P.forecast_points(spark, sf).select("timestamp_s", "s_nationkey", "model", "wind_speed_80m")
    lo, mid, hi = 852_076_800, 867_801_600, 883_612_800
    fresh = points.where((F.col("timestamp_s") >= lo) & (F.col("timestamp_s") < mid) & (F.col("model") == "A"))
    raised = fresh.withColumn("wind_speed_80m", (F.col("wind_speed_80m") + 1).cast("decimal(8,2)"))
    root = posixpath.join(shared_checkpoint_dir(spark), f"spans-{uuid.uuid4().hex}")
    key = {"candidates": [["timestamp_s", "s_nationkey", "model"]]}
    tables.publish(points, root, "points", ["model"], ts="timestamp_s", width=tables.SPAN_MS // 1000, **key)
    tables.replace_stored_range(raised, root, "points", "timestamp_s", lo, hi, {"model": "A"}, **key)
    return plain(tables.scan(spark, root, "points"))


@query
def stored_series(spark, sf):
    """A range of one series from a published table; only its spans are opened."""
    root = posixpath.join(shared_checkpoint_dir(spark), f"series-{uuid.uuid4().hex}")
    grid = P.market_grid(spark, sf).select(*KEYS, "power_consumption_residual_load", "power_consumption_total")
    tables.publish(grid, root, "market", build.SERIES_PARTS, ts=series.TS)
    return plain(requests.stored_series(spark, root, "market", "DE", "hour", TENTH, TWENTIETH))


@query
def publish_keeps_last(spark, sf):
    """A refresh with every row twice fails its key check; readers keep the version before."""
    days = P.daily_by_region(spark, sf).drop("load", "share")
    root = posixpath.join(shared_checkpoint_dir(spark), f"kept-{uuid.uuid4().hex}")
    tables.publish(days, root, "days", ["region"])
    try:
        tables.publish(days.unionByName(days), root, "days", ["region"])
    except ValueError:
        return plain(tables.scan(spark, root, "days"))
    raise AssertionError("a table with repeated keys was published")


# --- series reads -----------------------------------------------------------


@query
def slice_series(spark, sf):
    cut = series.slice_series(P.market_grid(spark, sf), "DE", "hour", TENTH, TWENTIETH)
    return plain(cut.select(*KEYS, "power_consumption_residual_load", "power_consumption_total"))


@query
def combine_derived(spark, sf):
    grid = sparse_price(spark, sf)
    combined = series.combine_derived(series.price_change(grid), series.share_series(grid))
    return plain(combined.select(*KEYS, "gerlux_price_change_abs_computed", "gerlux_price_change_rel_computed", RE_SHARE))


@query
def attach_weather(spark, sf):
    rows = series.share_series(P.market_grid(spark, sf)).select(*KEYS, WS_SHARE)
    joined = series.attach_weather(rows, january_weather(spark, sf))
    return plain(joined.select(*KEYS, WS_SHARE, "wind_speed_100_avg", "repi_power_exp"))


@query
def attach_weather_wall(spark, sf):
    rows = series.share_series(P.market_grid(spark, sf)).select(*KEYS, WS_SHARE)
    joined = series.attach_weather(rows, january_weather(spark, sf), wall=True)
    return plain(joined.select(*KEYS, WS_SHARE, "wind_speed_100_avg", "repi_power_exp"))


@query
def merge_series(spark, sf):
    grid = sparse_price(spark, sf)
    raw = series.time_of_interest(grid, TENTH).select(*KEYS, "power_consumption_total")
    return plain(series.merge_series(raw, series.price_change(grid).select(*KEYS, "last_time", "current_price")))


@query
def merge_series_whole(spark, sf):
    grid = sparse_price(spark, sf)
    raw = grid.select(*KEYS, "power_consumption_total")
    return plain(series.merge_series(raw, series.price_change(grid).select(*KEYS, "last_time", "current_price")))


@query
def wall_clock(spark, sf):
    days = P.daily_by_region(spark, sf)
    at = clock.to_wall_clock(F.col("unix_timestamp_ms"))
    return days.select(*KEYS, at.alias("wall_ms"), clock.local_label(F.col("unix_timestamp_ms")).alias("label"))


@query
def drop_empty_rows(spark, sf):
    wide = upsert.widen(P.long_feed(spark, sf), names=FEED_SERIES)
    return plain(series.drop_empty_rows(wide.select(*KEYS, "view", "click"), ["view", "click"]))


@query
def read_series(spark, sf):
    grid = sparse_price(spark, sf)
    rows = series.read_series(
        grid, series.share_series(grid), series.price_change(grid), january_weather(spark, sf),
        [410, 4169, 1, 4, 10, 17], "DE", "hour", JAN, TWENTIETH,
    )
    return plain(rows)


@query
def read_default_series(spark, sf):
    grid = P.market_grid(spark, sf)
    none = grid.where(F.lit(False))
    return plain(series.read_series(grid, none, none, none, None, "DE", "hour", JAN, TWENTIETH))


@query
def moving_average(spark, sf):
    return plain(series.moving_average(sparse_price(spark, sf), "market_price_ger_lux", 24), 6)


@query
def moving_average_compat(spark, sf):
    return plain(series.moving_average(sparse_price(spark, sf), "market_price_ger_lux", 24, compat=True), 6)


# --- weather ----------------------------------------------------------------


@query
def weather_hourly(spark, sf):
    return plain(weather.aggregate_weather(P.weather_points(spark, sf), "hour"))


@query
def weather_daily(spark, sf):
    return plain(weather.aggregate_weather(P.weather_points(spark, sf), "day"))


@query
def weather_daily_compat(spark, sf):
    daily = weather.aggregate_weather(P.weather_points(spark, sf), "day", compat=True)
    return plain(daily.select("date_ms", "wind_direction", "wind_dir_uniformity"))


@query
def weather_history(spark, sf):
    both = weather.weather_history(P.weather_points(spark, sf, P.IN_JANUARY))
    return plain(both.select("date_ms", "resolution", "wind_speed_100_avg", "direct_radiation_avg", "repi_power1avg2"))


@query
def wind_octants(spark, sf):
    points = P.weather_points(spark, sf)
    return points.groupBy("date_ms").agg(*weather.octant_counts())


@query
def dominant_direction(spark, sf):
    counts = P.weather_points(spark, sf, P.IN_JANUARY).groupBy("date_ms").agg(*weather.octant_counts())
    return plain(
        counts.select(
            "date_ms", weather.dominant_direction().alias("wind_direction"),
            weather.direction_uniformity(weather.GRID_POINTS).alias("wind_dir_uniformity"),
        )
    )


def _point_indices(null_wind: bool) -> dict[str, Column]:
    w = F.when(F.col("lat") > weather.NORTH_ABOVE_LAT, F.col("wind_speed_100m"))
    d, f = F.col("direct_radiation"), F.col("diffuse_radiation")
    return {
        "repi_30mix": indices.repi_30mix(w, d, f),
        "repi_power1avg": indices.repi_power1avg(w, d, f, null_wind),
        "repi_power1avg2": indices.repi_power1avg2(w, d, f, null_wind),
        "repi_power_exp": indices.repi_power_exp(w, d, f),
        "repi_square1avg": indices.repi_square1avg(w, d, f, null_wind),
    }


@query
def repi_all(spark, sf):
    points = P.weather_points(spark, sf)
    return plain(points.select("date_ms", "s_nationkey", *[c.alias(k) for k, c in _point_indices(False).items()]))


@query
def repi_null_wind(spark, sf):
    points = P.weather_points(spark, sf)
    return plain(points.select("date_ms", "s_nationkey", *[c.alias(k) for k, c in _point_indices(True).items()]))


@query
def forecast_agg(spark, sf):
    return plain(weather.aggregate_forecast(P.forecast_points(spark, sf)), 6)


@query
def wind_at_height(spark, sf):
    points = P.forecast_points(spark, sf)
    w80, w120, w180 = (F.col(f"wind_speed_{h}m") for h in (80, 120, 180))
    alpha = indices.mean_shear_exponent(w80, w120, w180)
    return plain(
        points.select(
            "timestamp_s", "s_nationkey", "model",
            indices.wind_at_height(w80, w120).alias("wind_100m"),
            alpha.alias("alpha_avg"),
            indices.wind_by_exponent(w80, alpha).alias("wind_100m_mean"),
        ),
        6,
    )


@query
def wind_model_comparison(spark, sf):
    return plain(weather.wind_model_comparison(P.forecast_points(spark, sf)))


@query
def live_index(spark, sf):
    return plain(weather.live_index(P.forecast_points(spark, sf), ["timestamp_s", "model"]))


# --- analyses ---------------------------------------------------------------


@query
def price_duration_curve(spark, sf):
    return plain(analyses.price_duration_curve(daily_market(spark, sf)))


@query
def align_by_rank(spark, sf):
    curve = analyses.price_duration_curve(daily_market(spark, sf))
    return plain(analyses.align_by_rank(curve, [1996, 1997, 1998, 1999, 2000, 2001]))


@query
def surplus_ranking(spark, sf):
    days = daily_market(spark, sf)
    return plain(
        analyses.surplus_ranking(days.select(*KEYS, F.col("share").alias(WS_SHARE)), days, at_least=0.5), 9
    )


@query
def share_with_price(spark, sf):
    grid = P.market_grid(spark, sf)
    return plain(analyses.share_with_price(series.share_series(grid), grid, RE_SHARE, "market_price_ger_lux"))


@query
def yearly_extremes(spark, sf):
    return plain(analyses.yearly_extremes(daily_market(spark, sf), carry=["market_price_ger_lux"]))


@query
def yearly_peak(spark, sf):
    return plain(analyses.yearly_peak(daily_market(spark, sf)))


@query
def yearly_energy(spark, sf):
    return plain(analyses.yearly_energy(daily_market(spark, sf), [1995, 1996, 1997, 1998, 1999, 2000]))


@query
def series_coverage(spark, sf):
    return analyses.series_coverage(sparse_price(spark, sf))


@query
def previous_value(spark, sf):
    """The row before of each event type; chunks are small, so it is often chunks away."""
    feed = P.event_rows(spark, sf).select("event_type", "event_id", "ms")
    found = series.previous_value(feed, "ms", ["event_type"], "event_id", chunk_ms=3)
    return found.select("event_type", "event_id", F.col("last_time").alias("last_id"), F.col("last_value").alias("last_ms"))


@query
def previous_value_chunks(spark, sf):
    """The same in chunks of thousands of rows, as production has them."""
    feed = P.event_rows(spark, sf).select("event_type", "event_id", "ms")
    found = series.previous_value(feed, "ms", ["event_type"], "event_id", chunk_ms=5000)
    return found.select("event_type", "event_id", F.col("last_time").alias("last_id"), F.col("last_value").alias("last_ms"))


@query
def earliest_k(spark, sf):
    feed = P.event_rows(spark, sf)
    first = analyses.earliest_k(feed, 3, ["event_type"], "event_id")
    return plain(first.select("event_type", "event_id", "ms", P.hundredths("cents").alias("value")))


@query
def duplicate_instants(spark, sf):
    return analyses.duplicate_instants(P.long_feed(spark, sf), ["unix_timestamp_ms"])


@query
def availability_matrix(spark, sf):
    kinds = F.create_map(*[F.lit(v) for pair in P.PRODUCTION_OF.items() for v in pair])
    feed = P.long_feed(spark, sf).withColumn("column_name", F.element_at(kinds, F.col("series")))
    return analyses.availability_matrix(
        feed, registry_frame(spark), "column_name", {"region": REGIONS, "resolution": RESOLUTIONS}
    )


@query
def value_profile(spark, sf):
    return plain(analyses.value_profile(P.long_feed(spark, sf), ["series"]))


@query
def series_class(spark, sf):
    kinds = F.create_map(*[F.lit(v) for pair in P.PRODUCTION_OF.items() for v in pair])
    counts = (
        P.event_rows(spark, sf)
        .groupBy(F.element_at(kinds, F.col("event_type")).alias("column_name"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return registry_frame(spark).join(counts, "column_name", "left").select(
        "series_id",
        labels.series_class(F.col("label")).alias("unit_class"),
        labels.axis_class(F.col("column_name"), compat=True).alias("axis"),
        labels.display_label(F.col("column_name"), ("of", "to")).alias("title"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


@query
def series_axes(spark, sf):
    """Axis of every value of the wide market table's filled series, by its column."""
    grid = P.market_regions(spark, sf)
    names = [*P.GENERATED, "market_price_ger_lux"]
    shares_too = series.share_series(grid).select(F.expr(f"stack(1, '{RE_SHARE}', {RE_SHARE})").alias("column_name", "value"))
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    long = grid.select(F.expr(f"stack({len(names)}, {pairs})").alias("column_name", "value"))
    both = long.select("column_name", F.col("value").cast("double")).unionByName(shares_too.select("column_name", F.col("value").cast("double")))
    return both.where("value is not null").groupBy(
        labels.axis_class(F.col("column_name")).alias("axis"), labels.display_label(F.col("column_name")).alias("title")
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def shares_regions(spark, sf):
    """Four regions, all generation columns, and rows that no share can be taken of."""
    return plain(series.share_series(P.market_regions(spark, sf)))


@query
def events_regions(spark, sf):
    shares_of = series.share_series(P.market_regions(spark, sf))
    return find_events(shares_of, RE_SHARE, SEARCH, HOUR)


@query
def price_change_regions(spark, sf):
    """Prices with gaps, nulls and zeros in four regions."""
    return plain(series.price_change(P.market_regions(spark, sf)))


@query
def dashboard_series(spark, sf):
    wide = upsert.widen(P.long_feed(spark, sf), names=FEED_SERIES)
    kept = series.drop_empty_rows(wide, FEED_SERIES)
    return plain(kept.select("unix_timestamp_ms", *FEED_SERIES).orderBy("unix_timestamp_ms"))


# --- correlation ------------------------------------------------------------

CORRELATED = ["power_consumption_total", "power_consumption_residual_load", "market_price_ger_lux", "wind_speed_100_avg"]


def _correlation_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = sparse_price(spark, sf).select(*KEYS, *CORRELATED[:3])
    return series.attach_weather(rows, january_weather(spark, sf).select("date_ms", "resolution", CORRELATED[3]))


@query
def corr_pearson(spark, sf):
    return plain(correlation.corr_pearson(_correlation_rows(spark, sf), CORRELATED), 6)


@query
def corr_spearman(spark, sf):
    return plain(correlation.corr_spearman(_correlation_rows(spark, sf), CORRELATED), 6)


@query
def corr_spearman_sparse(spark, sf):
    """Twelve columns with scattered nulls."""
    return plain(correlation.corr_spearman(P.sparse_columns(spark, sf), list(P.SPARSE_COLUMNS)), 6)


@query
def corr_kendall(spark, sf):
    return plain(correlation.corr_kendall(_correlation_rows(spark, sf), CORRELATED), 6)


@query
def correlation_input_history(spark, sf):
    grid = P.market_grid(spark, sf)
    rows = correlation.history_input(
        grid.select(*KEYS, "power_consumption_total", "market_price_ger_lux"),
        january_weather(spark, sf).select("date_ms", "resolution", "wind_speed_100_avg", "repi_30mix"),
        series.share_series(grid).select(*KEYS, RE_SHARE),
    )
    return plain(rows)


@query
def correlation_input_forecast(spark, sf):
    grid = P.market_grid(spark, sf)
    points = P.forecast_points(spark, sf, f"({P.IN_JANUARY}) div 1000")
    forecast = weather.aggregate_forecast(points).select(
        *weather.FORECAST_KEYS, "wind_100m_log", "repi_power1avg2", "repi_power_exp_previous_day3"
    )
    rows = correlation.forecast_input(
        grid.select(*KEYS, "power_consumption_total"), forecast, series.share_series(grid).select(*KEYS, RE_SHARE)
    )
    return plain(rows)


@query
def numeric_matrix(spark, sf):
    grid = P.market_grid(spark, sf).select(*KEYS, "power_consumption_total", "market_price_ger_lux")
    other = series.share_series(P.market_grid(spark, sf)).select(*KEYS, RE_SHARE)
    joined = grid.join(other, [grid[k] == other[k] for k in KEYS])
    return plain(correlation.numeric_matrix(joined))


# --- landed documents -------------------------------------------------------


def _landing(spark: SparkSession, name: str) -> str:
    return posixpath.join(shared_checkpoint_dir(spark), f"landed-{name}-{uuid.uuid4().hex}")


def _hourly_points(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"view": 4068, "click": 4067, "signup": 1226, "purchase": 4066, "error": 1223}
    ids = F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair])
    sums = (
        P.event_rows(spark, sf)
        .groupBy(F.element_at(ids, F.col("event_type")).alias("series_id"), F.expr(f"ms div {HOUR} * {HOUR}L").alias("ts"))
        .agg(F.sum("cents").alias("cents"))
    )
    value = F.when(F.col("cents") % 7 != 0, P.hundredths("cents").cast("double"))
    return sums.select(
        "series_id", F.lit("DE").alias("region"), F.lit("hour").alias("resolution"), "ts", value.alias("value"),
        F.expr(f"ts div {WEEK} * {WEEK}L").alias("bucket"),
    )


@query
def market_documents(spark, sf):
    parts = ["series_id", "region", "resolution"]
    points = F.sort_array(F.collect_list(F.array(F.col("ts").cast("double"), "value"))).alias("series")
    docs = _hourly_points(spark, sf).groupBy(*parts, "bucket").agg(points).drop("bucket")
    path = _landing(spark, "points")
    docs.write.partitionBy(*parts).json(path)
    return market_docs.read_market_json(spark, path, lines=True)


@query
def market_index(spark, sf):
    parts = ["series_id", "region", "resolution"]
    stamps = F.sort_array(F.collect_set("bucket")).alias("timestamps")
    docs = _hourly_points(spark, sf).groupBy(*parts).agg(stamps)
    path = _landing(spark, "index")
    docs.write.partitionBy(*parts).json(path)
    return market_docs.read_market_index(spark, path, lines=True)


@query
def ingested_price_changes(spark, sf):
    """Quarter-hour prices landed, imported with their bucket index, published, and read for price changes."""
    parts = ["series_id", "region", "resolution"]
    rows = P.market_grid(spark, sf, "quarterhour").select(
        F.lit(4169).alias("series_id"), "region", "resolution", F.col("unix_timestamp_ms").alias("ts"),
        F.expr(f"unix_timestamp_ms div {WEEK} * {WEEK}L").alias("bucket"),
        F.col("market_price_ger_lux").cast("double").alias("value"),
    )
    landed, index = _landing(spark, "prices"), _landing(spark, "price-index")
    points = F.sort_array(F.collect_list(F.array(F.col("ts").cast("double"), "value"))).alias("series")
    rows.groupBy(*parts, "bucket").agg(points).drop("bucket").write.partitionBy(*parts).json(landed)
    stamps = F.sort_array(F.collect_set("bucket")).alias("timestamps")
    rows.groupBy(*parts).agg(stamps).write.partitionBy(*parts).json(index)
    root = _landing(spark, "tables")
    ingest.ingest_market(spark, root, landed, index, lines=True)
    market = tables.scan(spark, root, "market")
    tables.publish(series.price_change(market), root, "price_changes", ["resolution", "region"])
    return plain(tables.scan(spark, root, "price_changes"))


def _arrays(time: str, variables: list[str]) -> Column:
    packed = F.sort_array(F.collect_list(F.struct(time, *[F.col(v).cast("double").alias(v) for v in variables])))
    return packed.alias("_p")


@query
def weather_documents(spark, sf):
    """A month of hours per nation, landed as parallel arrays with a regular step."""
    points = P.weather_points(spark, sf, P.IN_JANUARY).withColumn("wind_direction_10m", F.col("wind_direction_100m"))
    names = weather_docs.HISTORY_VARIABLES
    # Documents have no holes, so a document is a run of consecutive hours.
    numbered = points.withColumn("_i", F.expr(f"(date_ms - {JAN}L) div {HOUR}L"))
    run = F.expr("_i") - F.row_number().over(
        Window.partitionBy("s_nationkey").orderBy("_i")
    )
    docs = (
        numbered.withColumn("_run", run)
        .groupBy("s_nationkey", "_run", "lat", "lng")
        .agg(F.min("date_ms").alias("_lo"), F.max("date_ms").alias("_hi"), _arrays("_i", names))
        .select(
            F.col("lat").alias("latitude"), F.col("lng").alias("longitude"),
            F.col("s_nationkey").cast("double").alias("elevation"), F.lit(1).alias("model"),
            F.struct(
                F.expr("_lo div 1000").alias("start"), F.expr("_hi div 1000 + 3600").alias("end"),
                F.lit(3600).alias("interval"), *[F.col(f"_p.{v}").alias(v) for v in names],
            ).alias("hourly"),
        )
    )
    path = _landing(spark, "weather")
    docs.write.json(path)
    rows = weather_docs.read_weather_history(spark, path, lines=True)
    return plain(rows.select("date_ms", "lat", "elevation", *names).withColumn("elevation", F.col("elevation").cast("int")), 2)


def _live_docs(points: DataFrame) -> DataFrame:
    names = weather_docs.LIVE_VARIABLES
    return (
        points.withColumn("time", F.col("timestamp_s"))
        .groupBy("s_nationkey", "model", "lat", "lng", F.expr("timestamp_s div 31536000").alias("_year"))
        .agg(_arrays("time", names))
        .select(
            F.col("lat").alias("latitude"), F.col("lng").alias("longitude"),
            F.struct(*[F.col(f"_p.{v}").alias(v) for v in ["time", *names]]).alias("hourly"),
        )
    )


@query
def live_documents(spark, sf):
    path = _landing(spark, "live")
    _live_docs(P.forecast_points(spark, sf)).write.json(path)
    landed = weather_docs.read_live_forecast(spark, path, lines=True)
    typed = landed.withColumns({v: F.col(v).cast("decimal(11,2)") for v in weather_docs.LIVE_VARIABLES})
    return plain(weather.live_index(typed))


@query
def live_stream(spark, sf):
    """Three polls of which the second is the newest; the last to land is late. Every point
    is one by nation and model, told apart by its longitude."""
    names = weather_docs.LIVE_VARIABLES
    models = F.expr("locate(model, 'ANR')")
    points = P.forecast_points(spark, sf).withColumn("lng", (F.col("s_nationkey") * 4 + models).cast("double"))
    landing, root = _landing(spark, "polls"), _landing(spark, "live-tables")
    for polled, more in ((100, 3), (300, 0), (200, 5)):
        shifted = points.withColumns({n: F.col(n) + more for n in names})
        _live_docs(shifted).write.json(f"{landing}/polled_s={polled}")
        # The table is of past years, so no instant is final before the last.
        live.follow_live(spark, landing, root, f"{root}/state", lateness="20000 days", lines=True).awaitTermination()
    typed = tables.scan(spark, root, "live_points").withColumns({v: F.col(v).cast("decimal(11,2)") for v in names})
    return plain(weather.live_index(typed))


@query
def forecast_documents(spark, sf):
    """Runs of consecutive days per point and model, landed with all 44 variables as parallel arrays."""
    points = P.forecast_points(spark, sf)
    known = set(points.columns)
    names = weather_docs.FORECAST_VARIABLES
    filled = points.select(
        "s_nationkey", "model", "lat", "lng", F.expr("timestamp_s div 86400").alias("_i"),
        *[F.col(v) if v in known else F.lit(None).cast("double").alias(v) for v in names],
    )
    run = F.col("_i") - F.row_number().over(Window.partitionBy("s_nationkey", "model").orderBy("_i"))
    docs = (
        filled.withColumn("_run", run)
        .groupBy("s_nationkey", "model", "_run", "lat", "lng")
        .agg(F.min("_i").alias("_lo"), F.max("_i").alias("_hi"), _arrays("_i", names))
        .select(
            F.col("lat").alias("latitude"), F.col("lng").alias("longitude"), F.col("s_nationkey").cast("double").alias("elevation"),
            "model",
            F.struct(
                (F.col("_lo") * 86400).alias("start"), ((F.col("_hi") + 1) * 86400).alias("end"),
                F.lit(86400).alias("interval"), *[F.col(f"_p.{v}").alias(v) for v in names],
            ).alias("hourly"),
        )
    )
    path = _landing(spark, "forecast")
    docs.write.json(path)
    rows = weather_docs.read_weather_forecast(spark, path, lines=True)
    picked = ["wind_speed_80m", "wind_speed_180m_previous_day3", "direct_radiation_previous_day1", "wind_direction_80m"]
    return plain(rows.select("timestamp_s", "model", F.col("elevation").cast("int"), "temporal_resolution", *picked), 2)
