"""Derived series, reads and smoothing."""

import random
from decimal import Decimal

import pytest
from conftest import final_plan, rows
from pyspark.sql import functions as F

from lullspark.functions import clock, shares
from lullspark.operators import series
from lullspark.registry import KEYS, MARKET_SCHEMA, MEASURES, SENTINEL

HOUR, DAY = 3_600_000, 86_400_000


def prices(spark, values, resolution="hour"):
    return spark.createDataFrame([(t, "DE", resolution, v) for t, v in values], "unix_timestamp_ms long, region string, resolution string, p double").select(
        *KEYS, F.col("p").cast("decimal(11,2)").alias("market_price_ger_lux")
    )


def test_price_change(spark):
    df = prices(spark, [(0, 10.0), (HOUR, 15.0), (2 * HOUR, None), (3 * HOUR, 20.0)])
    out = series.price_change(df).collect()
    assert [(r.unix_timestamp_ms, r.last_time) for r in out] == [(HOUR, 0)]
    assert out[0].gerlux_price_change_abs_computed == Decimal("5.000")
    assert out[0].gerlux_price_change_rel_computed == Decimal("0.500")


def test_price_change_needs_the_exact_step(spark):
    assert series.price_change(prices(spark, [(0, 1.0), (23 * HOUR, 2.0)], "day")).count() == 0
    assert series.price_change(prices(spark, [(0, 1.0), (DAY, 2.0)], "day")).count() == 1
    assert series.price_change(prices(spark, [(0, 1.0), (30 * DAY, 2.0)], "month")).count() == 0
    assert series.price_change(prices(spark, [(0, 0.0), (HOUR, 2.0)])).count() == 0
    # A row in between makes it the predecessor.
    assert series.price_change(prices(spark, [(0, 1.0), (1, 3.0), (HOUR, 2.0)])).count() == 0


@pytest.mark.parametrize("chunk", [HOUR, 5 * HOUR, 1000 * HOUR])
def test_price_change_equals_plain_lag(spark, chunk):
    rng = random.Random(chunk)
    values = [(t * HOUR, rng.choice([None, 1.0, 2.5, -3.0, 0.0])) for t in range(200) if rng.random() < 0.8]
    out = series.price_change(prices(spark, values), chunk_ms=chunk)
    want = [
        (t, u)
        for (u, a), (t, b) in zip(values, values[1:])
        if a is not None and b is not None and a != 0 and t - u == HOUR
    ]
    assert sorted((r.unix_timestamp_ms, r.last_time) for r in out.collect()) == want


def test_price_change_is_one_shuffle(spark):
    plan = final_plan(series.price_change(prices(spark, [(t * HOUR, 1.0) for t in range(50)])))
    assert "Join" not in plan and "SinglePartition" not in plan and plan.count("Exchange hashpartitioning") == 1


def wide_row(spark, **given):
    values = {c: None for c in MARKET_SCHEMA.fieldNames()} | {
        "unix_timestamp_ms": 0, "is_bucket_timestamp": False, "region": "DE", "resolution": "hour"
    }
    values |= {c: Decimal("0") for c in MEASURES if c.startswith("electricity_")}
    values |= {k: v if isinstance(v, (str, int)) else (None if v is None else Decimal(str(v))) for k, v in given.items()}
    return spark.createDataFrame([tuple(values[c] for c in MARKET_SCHEMA.fieldNames())], MARKET_SCHEMA)


def test_shares(spark):
    given = dict(
        power_consumption_total=300.0, power_consumption_residual_load=200.0, electricity_production_hydropower=10.0,
        electricity_production_biomass=20.0, electricity_production_pumped_storage=5.0,
        electricity_consumption_pumped_storage=3.0, electricity_production_photovoltaics=40.0,
        electricity_production_wind_onshore=50.0, electricity_production_wind_offshore=10.0,
    )
    out = series.share_series(wide_row(spark, **given)).first()
    assert out.sum_of_photovoltaic_wind_onshore_offshore_computed == Decimal("100.00")
    assert out.share_of_photovoltaic_wind_onshore_offshore_computed == Decimal("0.33333")
    assert out.share_of_renewable_energies_computed == Decimal("0.44000")
    assert out.import_to_validate == Decimal("168.00")
    for broken in (
        {"power_consumption_total": 0.0}, {"power_consumption_residual_load": None},
        {"electricity_production_wind_offshore": SENTINEL}, {"electricity_production_photovoltaics": None},
    ):
        assert series.share_series(wide_row(spark, **{**given, **broken})).count() == 0


def test_share_overflow_is_an_error_or_null(spark):
    row = wide_row(spark, power_consumption_total=1.0, power_consumption_residual_load=50.0)
    with pytest.raises(Exception):
        series.share_series(row).collect()
    assert series.share_series(row, lenient=True).first().share_of_renewable_energies_computed is None


def test_wall_clock_repeats_an_hour_in_autumn(spark):
    df = spark.createDataFrame([(1729987200000,), (1729990800000,)], "ms long")
    out = {r[0] for r in df.select(clock.to_wall_clock(F.col("ms"))).collect()}
    assert out == {1729994400000}


def test_local_calendar_ignores_the_session_zone(spark):
    df = spark.createDataFrame([(1704063600000,)], "ms long")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = df.select(clock.local_label(F.col("ms")), clock.local_year(F.col("ms"), "UTC"), clock.local_year(F.col("ms"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == ("2024/01/01 00:00", 2023, 2024)


def test_durations(spark):
    df = spark.createDataFrame([(2, "quarterhour"), (3, "week")], "n long, r string")
    assert rows(df.select(clock.duration_ms(F.col("n"), F.col("r")))) == [(1_800_000,), (3 * 604_800_000,)]
    with pytest.raises(Exception):
        spark.createDataFrame([(2, "month")], "n long, r string").select(clock.duration_ms(F.col("n"), F.col("r"))).collect()
    parts = clock.duration_parts(F.lit(302_400_000))
    assert tuple(spark.range(1).select(*parts.values()).first()) == (84.0, 3.5, 0.5)


@pytest.mark.parametrize("block", [1, 2, 4, 1000])
def test_moving_average(spark, block):
    df = spark.createDataFrame([(t, "DE", "hour", float(t)) for t in range(1, 7)], "unix_timestamp_ms long, region string, resolution string, v double")
    out = series.moving_average(df, "v", 3, chunk_ms=2, block_rows=block).select("mean_time", "mean_value")
    assert rows(out) == [(2, 2.0), (3, 3.0), (4, 4.0), (5, 5.0)]
    compat = series.moving_average(df, "v", 3, compat=True, chunk_ms=2, block_rows=block).select("mean_time", "mean_value")
    assert rows(compat) == [(2, 2.0), (3, 3.0)]


@pytest.mark.parametrize("block", [3, 10, 10_000])
def test_moving_average_equals_brute_force(spark, block):
    rng = random.Random(block)
    values = {k: [(t, rng.choice([None, rng.random()])) for t in range(0, 300) if rng.random() < 0.7] for k in ("DE", "AT")}
    df = spark.createDataFrame(
        [(t, k, "hour", v) for k, vs in values.items() for t, v in vs], "unix_timestamp_ms long, region string, resolution string, v double"
    )
    period = 7
    got = {(r.region, r.mean_time, r.mean_value and round(r.mean_value, 9)) for r in series.moving_average(df, "v", period, chunk_ms=40, block_rows=block).collect()}
    want = set()
    for k, vs in values.items():
        for i in range(len(vs) - period + 1):
            run = vs[i : i + period]
            known = [v for _, v in run if v is not None]
            mean = round(sum(known) / len(known), 9) if known else None
            want.add((k, int(sum(t for t, _ in run) / period + 0.5), mean))
    assert got == want


def test_read_series_merges_and_masks(spark):
    raw = wide_row(spark, unix_timestamp_ms=HOUR, power_consumption_total=5.0, market_price_ger_lux=SENTINEL).unionByName(
        wide_row(spark, unix_timestamp_ms=2 * HOUR, market_price_ger_lux=SENTINEL)
    )
    share = spark.createDataFrame([(3 * HOUR, "DE", "hour", 0.25)], "unix_timestamp_ms long, region string, resolution string, share_of_renewable_energies_computed double")
    price = spark.createDataFrame([], "unix_timestamp_ms long, region string, resolution string, gerlux_price_change_abs_computed double")
    weather = spark.createDataFrame([(3 * HOUR, "hour", 7.0)], "date_ms long, resolution string, wind_speed_100_avg double")
    out = series.read_series(raw, share, price, weather, [410, 4169, 1, 10], "DE", "hour", 1, 10 * HOUR)
    got = [tuple(r) for r in out.collect()]
    # Winter time is one hour ahead; the row holding only a sentinel is gone.
    assert got == [(2 * HOUR, "DE", "hour", Decimal("5.00"), None, None, None), (4 * HOUR, "DE", "hour", None, None, 0.25, 7.0)]
    with pytest.raises(ValueError):
        series.read_series(raw, share, price, weather, [999], "DE", "hour", 1, 2)


def test_slice_pushes_filters_into_the_scan(spark, tmp_path):
    wide_row(spark, power_consumption_total=1.0).write.parquet(str(tmp_path / "m"))
    cut = series.slice_series(spark.read.parquet(str(tmp_path / "m")), "DE", "hour", 0, 5).select("power_consumption_total")
    plan = spark._jvm.PythonSQLUtils.explainString(cut._jdf.queryExecution(), "formatted")
    assert "EqualTo(region,DE)" in plan and "GreaterThanOrEqual(unix_timestamp_ms,0)" in plan
    assert "market_price_ger_lux" not in plan


def test_classify(spark):
    df = spark.createDataFrame([(0.3,), (0.31,), (None,)], "v double")
    assert [r[0] for r in df.select(shares.classify(F.col("v"), 0.3)).collect()] == ["LOW", "HIGH", "HIGH"]


def test_previous_value_over_any_gap(spark):
    day = 86_400_000
    times = [0, 1, 70 * day, 71 * day, 400 * day]
    df = spark.createDataFrame([("DE", "hour", t, i) for i, t in enumerate(times)], "region string, resolution string, unix_timestamp_ms long, v int")
    got = {r.unix_timestamp_ms: (r.last_time, r.last_value) for r in series.previous_value(df, "v").collect()}
    assert got == {t: (times[i - 1], i - 1) if i else (None, None) for i, t in enumerate(times)}


def test_previous_value_keeps_null_keys_and_times(spark):
    rows = [(None, 1, 10), (None, 100, 11), ("a", 2, 20), ("a", 90, 21), ("a", None, 22), ("a", None, 23), (None, None, 12)]
    df = spark.createDataFrame(rows, "k string, ts long, v long")
    got = {r.v: (r.last_time, r.last_value) for r in series.previous_value(df, "v", ["k"], "ts", chunk_ms=10).collect()}
    assert got == {
        10: (None, None), 11: (1, 10), 20: (None, None), 21: (2, 20),
        22: (None, None), 23: (None, None), 12: (None, None),
    }
