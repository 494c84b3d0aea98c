"""Interval aggregates, trend and enrichment against plain loops."""

import math
import random
import re

import pytest
from conftest import final_plan, rows
from pyspark.sql import functions as F

from lullspark.operators import enrich
from lullspark.operators.chunks import row_index, running_sum, with_time_chunk
from lullspark.operators.intervals import LEVELS, aggregate_intervals, dyadic_blocks, interval_pieces
from lullspark.operators.trend import trailing_event_trend

DAY = 86_400_000


@pytest.mark.parametrize("chunk", [1, 5, 64, 10_000])
def test_intervals_equal_brute_force(spark, chunk):
    rng = random.Random(3)
    data = [(k, t, rng.choice([None, rng.randint(-50, 50)])) for k in "ab" for t in range(-40, 160) if rng.random() < 0.8]
    spans = [(i, rng.choice("ab"), lo, lo + rng.choice([-3, 0, 1, 9, 40, 90])) for i in range(60) for lo in [rng.randint(-50, 170)]]
    series = spark.createDataFrame(data, "k string, t long, v long")
    intervals = spark.createDataFrame(spans, "id long, k string, lo long, hi long")
    v = F.col("v")
    measures = {"s": ("sum", v), "n": ("count", v), "lo_v": ("min", v), "hi_v": ("max", v)}
    got = aggregate_intervals(intervals, series, ["id"], ["k"], measures, ts="t", chunk_ms=chunk)
    want = []
    for i, k, lo, hi in spans:
        met = [x for (kk, t, x) in data if kk == k and lo <= t <= hi]
        inside = [x for x in met if x is not None]
        want.append((i, sum(inside) if inside else None, len(inside) if met else None,
                     min(inside, default=None), max(inside, default=None)))
    assert rows(got) == sorted(want, key=repr)


def test_no_nested_loop_join(spark):
    series = spark.createDataFrame([("a", t, t) for t in range(1000)], "k string, t long, v long")
    intervals = spark.createDataFrame([(i, "a", i * 10, i * 10 + 55) for i in range(50)], "id long, k string, lo long, hi long")
    got = aggregate_intervals(intervals, series, ["id"], ["k"], {"s": ("sum", F.col("v"))}, ts="t", chunk_ms=20)
    plan = final_plan(got)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_running_sum_and_index(spark, chunk):
    data = [("a", t, t * t) for t in range(0, 40, 2)] + [("b", t, 1) for t in range(5)]
    df = with_time_chunk(spark.createDataFrame(data, "k string, t long, v long"), "t", chunk)
    got = rows(running_sum(df, ["k"], ["t"], {"r": F.col("v")}).select("k", "t", "r"))
    want = [(k, t, sum(v for kk, u, v in data if kk == k and u <= t)) for k, t, _ in data]
    assert got == sorted(want, key=repr)
    numbered = rows(row_index(df, ["k"], ["t"], "i").select("k", "t", "i"))
    assert numbered == sorted([(k, t, sum(1 for kk, u, _ in data if kk == k and u <= t)) for k, t, _ in data], key=repr)


def trend_case(spark):
    days = spark.createDataFrame([("DE", d * DAY) for d in range(400)], "region string, unix_timestamp_ms long")
    events = spark.createDataFrame([("DE", 10 * DAY, 12 * DAY)], "region string, start_time long, end_time long")
    return days, events


@pytest.mark.parametrize("chunk", [DAY, 30 * DAY, 365 * DAY])
def test_trailing_trend_counts_whole_events(spark, chunk):
    days, events = trend_case(spark)
    got = rows(trailing_event_trend(days, events, skip=0, chunk_ms=chunk))
    assert got == sorted([("DE", d * DAY, 1, 2) for d in range(10, 377)], key=repr)


@pytest.mark.parametrize("chunk", [7 * DAY, 365 * DAY])
def test_trend_skips_result_rows(spark, chunk):
    days, events = trend_case(spark)
    got = rows(trailing_event_trend(days, events, skip=365, chunk_ms=chunk))
    assert got == [("DE", 375 * DAY, 1, 2), ("DE", 376 * DAY, 1, 2)]
    filled = trailing_event_trend(days, events, skip=365, fill=True, chunk_ms=chunk)
    assert filled.count() == 35
    assert filled.where("occurrences_in_last_rolling_year = 0").count() == 23


def test_trend_of_quarter_hours_gathers_no_series(spark):
    _, events = trend_case(spark)
    quarters = spark.range(40 * 96).select(F.lit("DE").alias("region"), (F.col("id") * 900_000).alias("unix_timestamp_ms"))
    trend = trailing_event_trend(quarters, events, skip=96, fill=True, chunk_ms=DAY)
    plan = final_plan(trend)
    # Only the offsets, one row per chunk, are ordered within a whole series.
    windows = [line for line in plan.splitlines() if re.search(r"[ -] ?Window ", line)]
    raw = [line for line in windows if "_t_" not in line]
    assert windows and raw and all("_chunk" in line for line in raw)
    assert trend.count() == 39 * 96


def market(spark, hours=24 * 30):
    data = []
    for q in range(hours * 4):
        data.append((q * 900_000, "DE", "quarterhour", 100 + q % 7, 60 + q % 5 if q % 11 else None, 20 + q % 13 if q % 17 else None))
    return spark.createDataFrame(
        data, "unix_timestamp_ms long, region string, resolution string, c int, r int, p int"
    ).selectExpr(
        "unix_timestamp_ms", "region", "resolution",
        "cast(c as decimal(11,2)) power_consumption_total",
        "cast(r as decimal(11,2)) power_consumption_residual_load",
        "cast(p as decimal(11,2)) market_price_ger_lux",
    )


@pytest.mark.parametrize("chunk", [900_000 * 3, DAY])
def test_event_statistics(spark, chunk):
    df = market(spark)
    start, end = 9 * DAY + 900_000, 11 * DAY
    events = spark.createDataFrame([(0.3, "DE", "quarterhour", start, end)], "threshold double, region string, resolution string, start_time long, end_time long")
    sums = enrich.market_sums(events, df, chunk_ms=chunk)
    out = enrich.cost(enrich.price_delta(enrich.extent(enrich.price_stats(enrich.load_stats(sums))))).first()
    priced = [tuple(x) for x in df.collect() if x["market_price_ger_lux"] is not None]

    def part(lo, hi):
        return [(float(c), None if r is None else float(r), float(p)) for t, _, _, c, r, p in priced if lo <= t <= hi]

    week = 7 * DAY
    during, half = part(start, end), part(start, end - 1)
    before, after = part(start - week, start), part(end, end + week)
    load = lambda rows: sum(r for _, r, _ in rows if r is not None)
    plain = lambda rows: round(sum(p for *_, p in rows) / len(rows) + 1e-9, 2)
    weighted = lambda rows: sum(c * p for c, _, p in rows) / sum(c for c, *_ in rows)
    base = round((load(before) + load(after)) / 336, 2)
    assert float(out.avg_res_load_power_during) == pytest.approx(round(load(half) / 47, 2))
    assert float(out.peak_res_load_power_during) == 4 * max(r for _, r, _ in during if r is not None)
    assert float(out.energy_consumption_during) == sum(c for c, *_ in during)
    assert float(out.avg_res_load_power_before_after) == pytest.approx(base)
    assert float(out.avg_price_during) == plain(during)
    assert float(out.avg_weighted_price_during) == pytest.approx(round(weighted(during), 2))
    assert float(out.avg_weighted_price_week_before) == pytest.approx(weighted(before), abs=1e-9)
    known = [(r, p) for _, r, p in during if r is not None]
    assert float(out.extent) == pytest.approx(sum(r - base / 4 for r, _ in known), abs=0.006)
    assert float(out.storage_made_electricity_value) == pytest.approx(sum((r - base / 4) * p for r, p in known), abs=0.006)
    increase = plain(during) - (plain(before) + plain(after)) / 2
    assert float(out.price_increase_during) == pytest.approx(increase)
    assert float(out.event_cost) == pytest.approx(float(out.energy_consumption_during) * increase, abs=0.006)


def test_event_without_prices_keeps_its_row(spark):
    far = 900 * DAY
    events = spark.createDataFrame([(0.3, "DE", "quarterhour", far, far + DAY)], "threshold double, region string, resolution string, start_time long, end_time long")
    out = enrich.price_delta(enrich.price_stats(enrich.load_stats(enrich.market_sums(events, market(spark, 24))))).first()
    assert out.start_time == far and out.avg_price_during is None and out.in_before_after_range is None


def test_calendar_of_midpoint(spark):
    # Middle of 2024-03-31 01:00 UTC is 03:00 local time, a Sunday.
    mid = 1_711_846_800_000
    events = spark.createDataFrame([(mid - DAY, mid + DAY)], "start_time long, end_time long")
    out = enrich.calendar(events).first()
    assert (out.day_of_week, out.day_of_month, out.month, out.year) == (7, 31, 3, 2024)
    assert float(out.duration_days) == 2.0


def test_weather_statistics_use_the_open_interval(spark):
    hour = 3_600_000
    weather = spark.createDataFrame(
        [(h * hour, "hour", float(h), float(h), float(h), float(h), float(h), float(h)) for h in range(10)]
        + [(0, "day", 99.0, 99.0, 99.0, 99.0, 99.0, 99.0)],
        "date_ms long, resolution string, repi_power1avg double, repi_power1avg2 double, repi_power_exp double,"
        " wind_speed_100_avg double, diffuse_radiation_avg double, direct_radiation_avg double",
    )
    events = spark.createDataFrame([(0.3, "DE", "quarterhour", 2 * hour, 6 * hour)], "threshold double, region string, resolution string, start_time long, end_time long")
    out = enrich.weather_stats(events, weather, chunk_ms=2 * hour).first()
    assert (out.repi_power1avg, out.repi_power_exp_max, out.repi_power_exp_min) == (4.0, 5.0, 3.0)


def test_dyadic_blocks_cover_the_chunks_once(spark):
    cases = [(a, a + n) for a in (-37, -1, 0, 5, 64, 1000) for n in (0, 1, 2, 3, 17, 64, 365, 3650, 20_000)]
    df = spark.createDataFrame(cases, "a long, b long").select("a", "b", dyadic_blocks(F.col("a"), F.col("b")).alias("blocks"))
    for a, b, blocks in df.collect():
        covered = sorted(c for k, n in blocks for c in range(n << k, (n + 1) << k))
        assert covered == list(range(a, b))
        if b - a <= 1 << LEVELS:
            assert len(blocks) <= max(1, 2 * math.log2(max(b - a, 1)) + 1)


def test_rows_that_an_interval_joins(spark):
    """One day, ten days, ten years: pieces instead of one row for each day."""
    spans = [(1, DAY * 5 + 7, DAY * 6 + 6), (2, 3, DAY * 10), (3, DAY // 2, 3650 * DAY)]
    intervals = spark.createDataFrame(spans, "id long, lo long, hi long")
    found = interval_pieces(intervals, ["id"], "lo", "hi", DAY).groupBy("id").count()
    counts = {r["id"]: r["count"] for r in found.collect()}
    assert counts[1] == 2 and counts[2] <= 2 + 2 * math.log2(10) and counts[3] <= 2 + 2 * math.log2(3650)
