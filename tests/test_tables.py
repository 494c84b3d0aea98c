"""Widening, upserts, range replacement, keys, market documents, the build."""

import json
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lullspark.operators import analyses, upsert
from lullspark.plans import build
from lullspark.registry import MARKET_SCHEMA, MEASURES, RAW_SERIES, SENTINEL, registry_frame, series_columns
from lullspark.sources import market, tables

WIDE = "unix_timestamp_ms long, region string, resolution string, is_bucket_timestamp boolean, a double, b double"


def wide(spark, *values):
    return spark.createDataFrame([(t, "DE", "hour", flag, a, b) for t, flag, a, b in values], WIDE)


def test_registry_is_one_to_one(spark):
    reg = registry_frame(spark).collect()
    assert len(reg) == 51 and len(MEASURES) == 37 == len(RAW_SERIES)
    for field in ("series_id", "label", "column_name"):
        assert len({r[field] for r in reg}) == 51
    assert series_columns() == (["power_consumption_residual_load", "power_consumption_total"], [])
    assert series_columns([410, 1]) == (["power_consumption_total"], ["share_of_renewable_energies_computed"])
    with pytest.raises(ValueError):
        series_columns([3])


def test_upsert_keeps_old_where_new_is_null(spark):
    base = wide(spark, (1, True, 1.0, None), (2, False, 5.0, 6.0))
    delta = wide(spark, (1, False, None, 2.0), (3, True, None, 9.0))
    got = upsert.upsert_sparse(base, delta, measures=["a", "b"]).select("unix_timestamp_ms", "is_bucket_timestamp", "a", "b")
    assert rows(got) == [(1, True, 1.0, 2.0), (2, False, 5.0, 6.0), (3, True, None, 9.0)]


def test_sentinel_life(spark):
    long = spark.createDataFrame(
        [(0, SENTINEL, True, 0, "a"), (0, 61.24, False, 1, "a"), (1, SENTINEL, True, 2, "a"), (1, None, False, 3, "a")],
        "unix_timestamp_ms long, value double, is_bucket_timestamp boolean, seq long, series string",
    ).select("*", F.lit("DE").alias("region"), F.lit("hour").alias("resolution"))
    out = upsert.widen(long, names=["a"])
    assert rows(out.select("unix_timestamp_ms", "is_bucket_timestamp", "a")) == [
        (0, True, Decimal("61.24")), (1, True, Decimal("-100000000.00"))
    ]
    assert rows(upsert.bucket_starts(out, "a")) == [(1, "DE", "hour")]
    assert rows(upsert.clear_sentinel(out, ["a"]).select("a")) == [(Decimal("61.24"),), (None,)]


def test_replace_range_is_half_open_and_keyed(spark):
    old = spark.createDataFrame([(t, m, 0) for t in (1, 2, 3) for m in ("x", "y")] + [(None, "x", 0)], "t long, m string, v int")
    new = spark.createDataFrame([(1, "x", 9)], "t long, m string, v int")
    got = rows(upsert.replace_range(old, new, "t", 1, 3, {"m": "x"}))
    assert got == sorted([(1, "x", 9), (3, "x", 0), (1, "y", 0), (2, "y", 0), (3, "y", 0), (None, "x", 0)], key=repr)


def test_unique_keys(spark):
    assert upsert.unique_key(["start_time", "end_time", "v"]) == ["start_time", "end_time"]
    assert upsert.unique_key(["v"]) is None
    df = spark.createDataFrame([(1, 2), (1, 2)], "start_time long, end_time long")
    with pytest.raises(ValueError):
        upsert.assert_unique(df)
    assert rows(upsert.key_violations(df)) == [(1, 2, 2)]
    assert upsert.assert_unique(df.distinct()) == ["start_time", "end_time"]


def land(root, series, region, resolution, name, doc):
    folder = root / f"series_id={series}" / f"region={region}" / f"resolution={resolution}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps(doc, indent=1))


def test_market_documents(spark, tmp_path):
    points, index = tmp_path / "points", tmp_path / "index"
    land(points, 4169, "DE-AT-LU", "day", "1514761200000.json",
         {"meta_data": {"version": 1}, "series": [[1514761200000, None], [1538344800000, 61.24], [1538431200000, 42.34]]})
    land(index, 4169, "DE-AT-LU", "day", "index.json", {"timestamps": [1514761200000]})
    buckets = market.read_market_index(spark, str(index))
    values = market.read_market_json(spark, str(points), drop_null_points=True)
    assert market.read_market_json(spark, str(points)).count() == 3
    feed = upsert.union_feeds(buckets, values)
    first = analyses.earliest_k(feed, 3, ["series_id", "region", "resolution"])
    got = sorted((r.unix_timestamp_ms, r.is_bucket_timestamp, r.value) for r in first.collect())
    assert got == [(1514761200000, True, SENTINEL), (1538344800000, False, 61.24), (1538431200000, False, 42.34)]
    present = analyses.availability_matrix(feed, registry_frame(spark), "series_id", {"region": ["DE-AT-LU", "AT"]})
    assert rows(present.where("available")) == [(4169, "DE-AT-LU", True, 3)]
    assert present.count() == 102
    assert rows(analyses.value_profile(values, ["series_id"])) == [(4169, 61.24, 2)]
    assert analyses.duplicate_instants(feed, ["unix_timestamp_ms"]).count() == 0


def test_stored_range_is_replaced_whole(spark, tmp_path):
    root, kinds = str(tmp_path), "ts long, part string, v int"
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (2, "b", 1), (3, "c", 1)], kinds)
    tables.publish(df, root, "t", ["part"], check_key=False)
    tables.replace_stored_range(spark.createDataFrame([(2, "a", 7)], kinds), root, "t", "ts", 2, 4, check_key=False)
    assert rows(tables.scan(spark, root, "t").select("ts", "part", "v")) == [(1, "a", 1), (2, "a", 7)]
    tables.replace_stored_range(df.limit(0), root, "t", "ts", 1, 9, {"part": "a"}, check_key=False)
    assert tables.scan(spark, root, "t").count() == 0


def test_failed_publish_keeps_the_last_version(spark, tmp_path):
    root, kinds, key = str(tmp_path), "id int, v int", [["id"]]
    tables.publish(spark.createDataFrame([(1, 1)], kinds), root, "t", candidates=key)
    with pytest.raises(ValueError, match="not unique"):
        tables.publish(spark.createDataFrame([(1, 1), (1, 2)], kinds), root, "t", candidates=key)
    assert rows(tables.scan(spark, root, "t")) == [(1, 1)]


def test_build_publishes_every_table(spark, tmp_path):
    root, hour = str(tmp_path), 3_600_000
    t0 = 1_704_067_200_000
    data = []
    for q in range(96 * 20):
        low = (q // 96) % 5 in (2, 3)
        values = {c: None for c in MARKET_SCHEMA.fieldNames()} | {c: Decimal(1) for c in MEASURES if c.startswith("electricity_")}
        values |= {
            "unix_timestamp_ms": t0 + q * 900_000, "is_bucket_timestamp": False, "region": "DE", "resolution": "quarterhour",
            "power_consumption_total": Decimal(100), "power_consumption_residual_load": Decimal(90 if low else 30),
            "market_price_ger_lux": Decimal(80 if low else 40) + q % 3,
        }
        data.append(tuple(values[c] for c in MARKET_SCHEMA.fieldNames()))
    empty = {c: None for c in MARKET_SCHEMA.fieldNames()} | {
        "unix_timestamp_ms": t0 - 900_000, "is_bucket_timestamp": True, "region": "DE", "resolution": "quarterhour",
        "market_price_ger_lux": Decimal(-100_000_000),
    }
    data.append(tuple(empty[c] for c in MARKET_SCHEMA.fieldNames()))
    spark.createDataFrame(data, MARKET_SCHEMA).write.parquet(f"{root}/market")
    spots = [(t0 + h * hour, lat, 1.0, 3.0, 5.0, 10.0, 20.0, 30.0) for h in range(480) for lat in (48.0, 51.5, 54.0)]
    spark.createDataFrame(
        spots, "date_ms long, lat double, temperature_2m double, wind_speed_10m double, wind_speed_100m double,"
        " wind_direction_100m double, direct_radiation double, diffuse_radiation double",
    ).write.parquet(f"{root}/weather_points")
    leads = ["", "_previous_day1", "_previous_day2", "_previous_day3"]
    names = ["direct_radiation", "diffuse_radiation", "temperature_2m", "wind_speed_80m", "wind_speed_120m", "wind_speed_180m"]
    forecast = spark.range(4).selectExpr(
        "id * 3600 AS timestamp_s", "'gfs_global' AS model", "'hour' AS temporal_resolution", "51.5D AS lat", "7D AS lng",
        *[f"cast(5 AS double) AS {n}{lead}" for n in names for lead in leads],
    )
    forecast.write.parquet(f"{root}/forecast_points")
    assert build.build_tables(spark, root) == ["shares", "price_changes", "forecasts", "weather", "events"]
    events = tables.scan(spark, root, "events")
    found = events.where("threshold_percent = 30").orderBy("start_time").collect()
    assert [(r.start_time - t0) // 86_400_000 for r in found] == [2, 7, 12, 17]
    assert {str(r.duration_days) for r in found} == {"2.00"}
    assert found[0].in_before_after_range is False and found[0].repi_power1avg == Decimal("175.00")
    assert events.select("threshold_percent").distinct().count() >= 1
    # Running it again refreshes the tables in place.
    before = events.count()
    build.build_tables(spark, root)
    assert tables.scan(spark, root, "events").count() == before


def test_value_profile_counts_all_digits(spark):
    data = [("a", 0.123456789012), ("a", 12.5), ("b", 1.5e-7), ("c", 3e20), ("d", 0.0), ("e", None)]
    got = analyses.value_profile(spark.createDataFrame(data, "k string, value double"), ["k"])
    assert {r.k: r.max_fraction_digits for r in got.collect()} == {"a": 12, "b": 8, "c": 0, "d": 0, "e": None}


def hourly(spark, days, regions=("DE", "AT"), t0=1_704_067_200_000):
    return spark.range(24 * days * len(regions)).selectExpr(
        f"{t0}L + (id div {len(regions)}) * 3600000L AS unix_timestamp_ms",
        f"element_at(array({', '.join(map(repr, regions))}), cast(id % {len(regions)} + 1 AS int)) AS region",
        "'hour' AS resolution",
        "cast(id AS int) AS v",
    )


def scanned(df):
    """Files and rows that a read's scan has opened and given out."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    metrics = plan.collectLeaves().head().metrics()
    return [metrics.apply(m).value() for m in ("numFiles", "numOutputRows")]


def test_a_day_of_a_stored_table_reads_little(spark, tmp_path):
    root, day = str(tmp_path), 86_400_000
    rows_of, ts = hourly(spark, 3650).repartition(5), "unix_timestamp_ms"
    at = 1_704_067_200_000 + 1000 * day
    tables.publish(rows_of, root, "t", ["resolution", "region"], ts=ts)
    read = tables.scan_range(spark, root, "t", ts, at, at + day - 1, {"region": "DE"})
    # One file: the four weeks of the day, of one region.
    assert scanned(read) == [1, 672] and read.count() == 24
    assert tables.scan(spark, root, "t").count() == 2 * 24 * 3650
    # In a file of ten years only few of the row groups, which lie in order of time, are read.
    tables.publish(rows_of, root, "long", ["resolution", "region"], ts=ts, width=5000 * day, row_group=65536)
    files, found = scanned(tables.scan_range(spark, root, "long", ts, at, at + day - 1, {"region": "DE"}))
    assert files <= 2 and 24 <= found < 0.15 * 24 * 3650
    # A hot span is split over files, each with its own stretch of time.
    tables.publish(hourly(spark, 28, ["DE"]).repartition(4), root, "hot", ["region"], ts="unix_timestamp_ms", check_key=False)
    assert tables.scan(spark, root, "hot").count() == 28 * 24


def test_replacing_a_day_rewrites_its_span(spark, tmp_path):
    root, day, ts = str(tmp_path), 86_400_000, "unix_timestamp_ms"
    tables.publish(hourly(spark, 400), root, "t", ["resolution", "region"], ts=ts)
    before = tables.version(spark, root, "t")
    reader = tables.scan(spark, root, "t")
    lo = 1_704_067_200_000 + 200 * day
    fresh = hourly(spark, 400).where((F.col(ts) >= lo) & (F.col(ts) < lo + 12 * 3_600_000) & (F.col("region") == "DE"))
    fresh = fresh.withColumn("v", F.lit(-1))
    tables.replace_stored_range(fresh, root, "t", ts, lo, lo + day, {"region": "DE"})
    after = tables.version(spark, root, "t")
    changed = tables.changed_folders(before, after)
    assert len(changed) == 1 and changed[0]["region"] == "DE"
    assert len(set(after.folders) - set(before.folders)) == 1
    now = tables.scan(spark, root, "t")
    assert now.count() == 2 * 9600 - 12 and now.where("v = -1").count() == 12
    # Readers of the version before still see it.
    assert reader.where("v = -1").count() == 0 and reader.count() == 2 * 9600
    # Rows of another span than the range go to theirs and lose nothing there.
    tables.replace_stored_range(hourly(spark, 401).where(f"{ts} >= {lo + 200 * day}"), root, "t", ts, lo, lo + day, {"region": "AT"})
    assert tables.scan(spark, root, "t").count() == 2 * 9600 - 12 - 24 + 48
    with pytest.raises(ValueError, match="not unique"):
        tables.replace_stored_range(fresh.unionByName(fresh), root, "t", ts, lo, lo + day, {"region": "DE"})
    assert tables.scan(spark, root, "t").count() == 2 * 9600 - 12 - 24 + 48
    gone = tables.vacuum(spark, root, "t", keep=1)
    assert gone == [] or tables.scan(spark, root, "t").count() == 2 * 9600 - 12 - 24 + 48


def test_unusual_and_null_partitions(spark, tmp_path):
    root, kinds = str(tmp_path), "ts long, region string, v int"
    data = [(t, r, 0) for t in (1, 101) for r in ("a/b", "ä c", None, "x=y")] + [(None, "a/b", 0)]
    tables.publish(spark.createDataFrame(data, kinds), root, "t", ["region"], ts="ts", width=100, check_key=False)
    assert rows(tables.scan(spark, root, "t")) == sorted([tuple(d) for d in data], key=repr)
    for region in ("a/b", "ä c", "x=y"):
        assert tables.scan_range(spark, root, "t", "ts", 0, 99, {"region": region}).count() == 1
    new = spark.createDataFrame([(2, None, 9), (3, "a/b", 9)], kinds)
    tables.replace_stored_range(new, root, "t", "ts", 101, 102, {"region": "ä c"}, check_key=False)
    want = [d for d in data if d[:2] != (101, "ä c")] + [(2, None, 9), (3, "a/b", 9)]
    assert rows(tables.scan(spark, root, "t")) == sorted(want, key=repr)
    tables.publish(spark.createDataFrame([], kinds), root, "none", ["region"], ts="ts", check_key=False)
    assert tables.scan(spark, root, "none").collect() == []
