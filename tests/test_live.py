"""The live forecast as a stream: repeated polls, late documents, restarts."""

import json
import shutil

from conftest import rows
from pyspark.sql import functions as F

from lullspark.operators import weather
from lullspark.sources import tables
from lullspark.sources.weather import LIVE_VARIABLES, live_rows, live_schema
from lullspark.streaming import live

HOUR, T0 = 3600, 1_704_067_200


def poll(landing, polled, first, hours, value, points=(48.0, 51.5, 54.0)):
    folder = landing / f"polled_s={polled}"
    folder.mkdir(parents=True, exist_ok=True)
    time = [T0 + (first + h) * HOUR for h in range(hours)]
    hourly = {v: [None if value is None else value + h + i for h in range(hours)] for i, v in enumerate(LIVE_VARIABLES)}
    for lat in points:
        doc = {"latitude": lat, "longitude": 7.0, "hourly": {"time": time, **hourly}}
        (folder / f"{lat}-{first}.json").write_text(json.dumps(doc))


def batch_index(spark, landing):
    """The same from all documents at once."""
    documents = spark.read.schema(f"{live_schema()}, polled_s long").option("multiLine", True).json(str(landing))
    latest = live.latest_points(live_rows(documents, ["polled_s"]))
    return rows(weather.live_index(latest))


def test_polls_and_late_documents_give_the_batch_result(spark, tmp_path):
    landing, root = tmp_path / "polls", str(tmp_path / "tables")
    follow = lambda: live.follow_live(spark, str(landing), root, f"{root}/state").awaitTermination()
    poll(landing, 1000, 0, 48, 3.0)
    follow()
    assert rows(live.live_index(spark, root)) == batch_index(spark, landing)
    first = tables.version(spark, root, "live_points")
    # Nothing landed: nothing changes, as after any restart from the checkpoint.
    follow()
    assert tables.version(spark, root, "live_points").name == first.name
    # A newer poll, then one from between that arrives late, and one with nothing but nulls.
    poll(landing, 3000, 24, 48, 6.0)
    follow()
    poll(landing, 2000, 12, 48, 1.0)
    poll(landing, 4000, 30, 4, None)
    follow()
    got = rows(live.live_index(spark, root))
    assert got == batch_index(spark, landing) and len(got) == 72
    at = {r["timestamp_s"]: r["wind_speed_80m"] for r in tables.scan(spark, root, "live_points").where("lat = 48").collect()}
    assert (at[T0 + 11 * HOUR], at[T0 + 23 * HOUR], at[T0 + 30 * HOUR]) == (14.0, 12.0, 12.0)


def test_a_batch_that_runs_twice_is_merged_once(spark, tmp_path):
    """The last batch was merged, but its commit was lost with the driver."""
    landing, root = tmp_path / "polls", str(tmp_path / "tables")
    follow = lambda: live.follow_live(spark, str(landing), root, f"{root}/state").awaitTermination()
    poll(landing, 1000, 0, 10, 3.0)
    follow()
    poll(landing, 2000, 5, 10, 4.0)
    follow()
    done = tables.version(spark, root, "live_points")
    commits = tmp_path / "tables" / "state" / "live_points" / "commits"
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    shutil.move(last, tmp_path / "lost")
    shutil.move(last.with_name(f".{last.name}.crc"), tmp_path / "lost-too")
    follow()
    assert tables.version(spark, root, "live_points").name == done.name
    assert rows(live.live_index(spark, root)) == batch_index(spark, landing)
    assert tables.scan(spark, root, "live_points").groupBy(*live.POINT).count().where(F.col("count") > 1).count() == 0


def test_instants_beyond_the_watermark_are_final(spark, tmp_path):
    landing, root = tmp_path / "polls", str(tmp_path / "tables")
    follow = lambda: live.follow_live(spark, str(landing), root, f"{root}/state", lateness="2 days").awaitTermination()
    poll(landing, 1000, 0, 2, 3.0)
    follow()
    poll(landing, 2000, 24 * 30, 2, 3.0)
    follow()
    before = rows(tables.scan(spark, root, "live_points").where(F.col("timestamp_s") < T0 + 2 * HOUR))
    poll(landing, 3000, 0, 2, 9.0)
    follow()
    now = tables.scan(spark, root, "live_points")
    assert rows(now.where(F.col("timestamp_s") < T0 + 2 * HOUR)) == before and now.count() == 12
