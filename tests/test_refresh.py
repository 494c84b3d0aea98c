"""Incremental merge of imports and refresh of derived tables, against doing it all anew."""

import json

from conftest import rows
from pyspark.sql import functions as F

from lullspark.operators import upsert
from lullspark.plans import refresh
from lullspark.registry import KEYS, MARKET_SCHEMA, MEASURES
from lullspark.sources import tables
from lullspark.streaming.importer import current_table, import_indexes, import_points, merge_indexes, merge_points

HOUR, DAY, TS = 3_600_000, 86_400_000, "unix_timestamp_ms"
T0 = 1_704_067_200_000
OPTIONS = {"resolution": "hour", "after_ms": T0 + 5 * HOUR, "min_duration_ms": 6 * HOUR, "margin_ms": 3 * DAY}


def market(spark, days):
    """Hours with a low share for a day in four; prices and loads that differ by hour."""
    low = "(h div 24) % 4 = 1"
    values = {
        "power_consumption_total": "100",
        "power_consumption_residual_load": f"IF({low}, 90, 30)",
        "market_price_ger_lux": f"IF(h % 97 = 5, NULL, IF({low}, 80, 40) + h % 7)",
        "electricity_production_wind_onshore": f"IF({low}, 5, 70)",
        "electricity_production_lignite": "20 + h % 3",
    }
    return (
        spark.range(24 * days)
        .selectExpr("id AS h", f"{T0}L + id * {HOUR}L AS {TS}", "false AS is_bucket_timestamp", "'DE' AS region", "'hour' AS resolution")
        .selectExpr(
            *KEYS,
            "is_bucket_timestamp",
            *[f"cast({values.get(m, '0' if m.startswith('electricity_') else 'NULL')} AS decimal(11,2)) AS {m}" for m in MEASURES],
        )
        .select(*MARKET_SCHEMA.fieldNames())
    )


def weather(spark, days):
    return spark.range(24 * days * 3).selectExpr(
        f"{T0}L + (id div 3) * {HOUR}L AS date_ms", "element_at(array(48.0D, 51.5D, 54.0D), cast(id % 3 + 1 AS int)) AS lat", "1D AS lng",
        "1 AS model", "'hour' AS temporal_resolution", "3D AS temperature_2m", "5D AS wind_speed_10m", "cast(id % 9 AS double) AS wind_speed_100m",
        "20D AS wind_direction_100m", "30D AS direct_radiation", "cast(id % 5 AS double) AS diffuse_radiation",
    )


def forecast(spark, hours):
    leads = ["", "_previous_day1", "_previous_day2", "_previous_day3"]
    names = ["direct_radiation", "diffuse_radiation", "temperature_2m", "wind_speed_80m", "wind_speed_120m", "wind_speed_180m"]
    return spark.range(hours).selectExpr(
        f"{T0 // 1000}L + id * 3600 AS timestamp_s", "'gfs_global' AS model", "'hour' AS temporal_resolution", "51.5D AS lat", "7D AS lng",
        *[f"cast(id % 7 AS double) AS {n}{lead}" for n in names for lead in leads],
    )


def land_base(spark, root, days):
    tables.publish(market(spark, days), root, "market", ["resolution", "region"], ts=TS)
    tables.publish(weather(spark, days), root, "weather_points", ts="date_ms", check_key=False)
    tables.publish(forecast(spark, 30), root, "forecast_points", ts="timestamp_s", width=tables.SPAN_MS // 1000, check_key=False)


NAMES = ["shares", "price_changes", "forecasts", "weather", "level_sets", "level_sets_upper", "events"]


def contents(spark, root):
    """Rows of every derived table; arrays as they are."""
    return {n: rows(tables.scan(spark, root, n)) for n in NAMES}


def test_refresh_of_one_hour(spark, tmp_path):
    root, anew, days = str(tmp_path / "kept"), str(tmp_path / "anew"), 150
    land_base(spark, root, days)
    assert set(refresh.refresh_tables(spark, root, **OPTIONS).values()) == {None}
    before = {n: tables.version(spark, root, n) for n in NAMES}
    assert tables.scan(spark, root, "events").count() > 30
    # Nothing new: nothing is written.
    assert all(not cells for cells in refresh.refresh_tables(spark, root, **OPTIONS).values())
    assert {n: tables.version(spark, root, n).name for n in NAMES} == {n: v.name for n, v in before.items()}
    # The last hour of a span within a low day becomes windy, so an event is cut in two;
    # the price after it, in the next span, changes too.
    width = tables.SPAN_MS
    hour = (T0 // width + 3) * width - HOUR
    row = tables.scan(spark, root, "market").where(F.col(TS) == hour)
    windy = row.withColumns({"electricity_production_wind_onshore": F.lit(500).cast("decimal(11,2)"), "market_price_ger_lux": F.lit(9).cast("decimal(11,2)")})
    tables.replace_stored_range(windy, root, "market", TS, hour, hour + 1, {"region": "DE", "resolution": "hour"})
    done = refresh.refresh_tables(spark, root, **OPTIONS)
    span, series = hour // width, ("hour", "DE")
    assert done["shares"] == done["level_sets"] == {(series, span)}
    assert done["price_changes"] == {(series, span), (series, span + 1)}
    assert done["weather"] == done["forecasts"] == set()
    after = {n: tables.version(spark, root, n) for n in NAMES}
    for name in ("shares", "price_changes", "level_sets", "events"):
        cells = {(c[1] if isinstance(c, tuple) else c) for c in done[name]}
        same = set(before[name].folders) & set(after[name].folders)
        assert same == {f for f in before[name].folders if tables.span_of(f) not in cells}
        assert same
    # Equal to a build of everything.
    tables.publish(tables.scan(spark, root, "market"), anew, "market", ["resolution", "region"], ts=TS)
    for name in ("weather_points", "forecast_points"):
        at = tables.version(spark, root, name)
        tables.publish(tables.scan(spark, root, name), anew, name, ts=at.ts, width=at.width, check_key=False)
    refresh.refresh_tables(spark, anew, **OPTIONS)
    got, want = contents(spark, root), contents(spark, anew)
    for name in NAMES:
        assert got[name] == want[name], name


def land(root, series, name, key, value):
    folder = root / f"series_id={series}" / "region=DE" / "resolution=hour"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps({key: value}))


def test_merging_import_touches_its_spans_and_equals_the_deltas(spark, tmp_path):
    points, index, root = tmp_path / "points", tmp_path / "index", str(tmp_path / "tables")

    def run():
        # One after the other: a table has one writer at a time.
        merge_points(spark, str(points), root, "m", f"{root}/state").awaitTermination()
        merge_indexes(spark, str(index), root, "m", f"{root}/state").awaitTermination()
        import_points(spark, str(points), f"{root}/deltas", f"{root}/other").awaitTermination()
        import_indexes(spark, str(index), f"{root}/deltas", f"{root}/other").awaitTermination()
        got = rows(tables.scan(spark, root, "m").select(*MARKET_SCHEMA.fieldNames()))
        assert got == rows(current_table(spark, f"{root}/deltas").select(*MARKET_SCHEMA.fieldNames()))
        return tables.version(spark, root, "m")

    land(points, 4169, "a.json", "series", [[T0 + h * HOUR, float(h)] for h in range(24 * 90)])
    land(index, 4169, "a.json", "timestamps", [T0])
    first = run()
    assert len(first.folders) == 4
    # A day of another series and a bucket start that comes after its values.
    land(points, 410, "b.json", "series", [[T0 + h * HOUR, 7.0] for h in range(240, 264)])
    land(index, 4169, "b.json", "timestamps", [T0 + 240 * HOUR])
    second = run()
    assert len(tables.changed_folders(first, second)) == 1
    flagged = tables.scan(spark, root, "m").where("is_bucket_timestamp").orderBy(TS).collect()
    assert [(r[TS], r["market_price_ger_lux"]) for r in flagged] == [(T0, 0), (T0 + 240 * HOUR, 240)]
    # A batch that is retried changes nothing.
    delta = tables.scan(spark, root, "m").limit(1)
    assert not tables.merge_stored(delta, root, "m", "points-1")
    assert tables.version(spark, root, "m").name == second.name


def test_flags_and_sentinels(spark):
    kinds = "unix_timestamp_ms long, region string, resolution string, is_bucket_timestamp boolean, a double"
    row = lambda t, flag, a: (t, "DE", "hour", flag, a)
    base = spark.createDataFrame([row(1, False, 5.0), row(2, True, None), row(3, None, 1.0)], kinds)
    index = spark.createDataFrame([row(1, True, -1e8), row(2, True, -1e8), row(4, True, -1e8)], kinds)
    got = upsert.upsert_sparse(base, index, measures=["a"], keep_known=True).select(TS, "is_bucket_timestamp", "a")
    assert rows(got) == [(1, True, 5.0), (2, True, -1e8), (3, None, 1.0), (4, True, -1e8)]
