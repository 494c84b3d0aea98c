"""The incremental import: repeated runs, late values, nulls."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from lullspark.plans import ingest
from lullspark.registry import RAW_SERIES
from lullspark.sources import tables
from lullspark.sources.weather import FORECAST_VARIABLES, HISTORY_VARIABLES
from lullspark.streaming.importer import current_table, import_indexes, import_points


def land(root, name, key, value):
    folder = root / "series_id=4169" / "region=DE" / "resolution=hour"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps({key: value}))


def test_import_is_incremental_and_repeatable(spark, tmp_path):
    points, index, table, state = (tmp_path / n for n in ("points", "index", "table", "state"))
    run = lambda: [
        q.awaitTermination()
        for q in (
            import_indexes(spark, str(index), str(table), str(state)),
            import_points(spark, str(points), str(table), str(state)),
        )
    ]

    def now():
        rows = current_table(spark, str(table)).orderBy("unix_timestamp_ms")
        return [(r.unix_timestamp_ms, r.is_bucket_timestamp, r.market_price_ger_lux) for r in rows.collect()]

    flag = Decimal("-100000000.00")
    land(index, "a.json", "timestamps", [0])
    land(points, "a.json", "series", [[0, None], [3600000, 5.5], [7200000, 7.25]])
    run()
    assert now() == [(0, True, flag), (3600000, False, Decimal("5.50")), (7200000, False, Decimal("7.25"))]
    # Nothing new: nothing changes.
    run()
    assert len(now()) == 3
    # A later document corrects one value and loses none.
    land(points, "b.json", "series", [[0, 4.0], [3600000, None], [7200000, 8.0]])
    land(index, "b.json", "timestamps", [7200000])
    run()
    assert now() == [(0, True, Decimal("4.00")), (3600000, False, Decimal("5.50")), (7200000, True, Decimal("8.00"))]
    assert current_table(spark, str(table)).where(F.col("region") != "DE").count() == 0


def land_grid(folder, names, time, values, model):
    """One document per grid point; every value array has one entry per hour."""
    folder.mkdir(exist_ok=True)
    for lat in (48.0, 51.5, 54.0):
        doc = {"latitude": lat, "longitude": 7.0, "elevation": 10.0, "model": model, "hourly": {**time, **{n: values for n in names}}}
        (folder / f"{lat}-{time['start']}.json").write_text(json.dumps(doc))


def test_landed_documents_become_every_table(spark, tmp_path):
    root, hour, t0 = str(tmp_path / "tables"), 3_600_000, 1_704_067_200_000
    points, index, history, leads = (tmp_path / n for n in ("points", "index", "history", "leads"))
    hours = range(24 * 8)
    low = [48 <= h < 96 for h in hours]
    series = {410: [100.0 for _ in hours], 4359: [90.0 if x else 30.0 for x in low], 4169: [80.0 if x else 40.0 + h % 3 for h, x in enumerate(low)]}
    series |= {i: [2.0 if x else 14.0 for x in low] for i in (4068, 4067)}
    series |= {i: [1.0 for _ in hours] for i, _, name in RAW_SERIES if name.startswith("electricity_") and i not in series}
    for i, values in series.items():
        folder = points / f"series_id={i}" / "region=DE" / "resolution=hour"
        folder.mkdir(parents=True)
        (folder / "a.json").write_text(json.dumps({"series": [[t0 + h * hour, v] for h, v in enumerate(values)]}))
    land(index, "a.json", "timestamps", [t0 - hour, t0])
    land_grid(history, HISTORY_VARIABLES, {"start": t0 // 1000, "end": t0 // 1000 + 8 * 86400, "interval": 3600}, [5.0] * 24 * 8, 1)
    land_grid(leads, FORECAST_VARIABLES, {"start": t0 // 1000, "end": t0 // 1000 + 3 * 3600, "interval": 3600}, [4.0, 5.0, 6.0], "m")

    def run():
        return ingest.ingest_and_build(
            spark, root, str(points), str(history), str(leads), str(index), resolution="hour", after_ms=0, min_duration_ms=24 * hour
        )

    names = ["market", "weather_points", "forecast_points", "shares", "price_changes", "forecasts", "weather", "events"]
    assert run() == names
    market = tables.scan(spark, root, "market")
    # The hour before has a sentinel only, which is no price.
    assert market.where("unix_timestamp_ms < 1704067200000").select("market_price_ger_lux", "is_bucket_timestamp").collect() == [(None, True)]
    changes = tables.scan(spark, root, "price_changes")
    assert changes.count() == 24 * 8 - 1 and changes.where("abs(last_price) > 100").count() == 0
    forecasts = tables.scan(spark, root, "forecasts").orderBy("timestamp_s").collect()
    assert [float(r.direct_radiation_avg) for r in forecasts] == [4.0, 5.0, 6.0]
    assert tables.scan(spark, root, "weather").where("resolution = 'hour'").count() == 24 * 8
    events = tables.scan(spark, root, "events")
    found = events.where("threshold_percent = 30").collect()
    assert [((r.start_time - t0) // hour, (r.end_time - t0) // hour) for r in found] == [(48, 96)]
    # Later documents of one hour replace that hour, at every point.
    for old in leads.iterdir():
        old.write_text("")
    land_grid(leads, FORECAST_VARIABLES, {"start": t0 // 1000 + 3600, "end": t0 // 1000 + 7200, "interval": 3600}, [9.0], "m")
    assert run() == names
    forecasts = tables.scan(spark, root, "forecasts").orderBy("timestamp_s").collect()
    assert [float(r.direct_radiation_avg) for r in forecasts] == [4.0, 9.0, 6.0]
    assert tables.scan(spark, root, "weather_points").count() == 3 * 24 * 8
