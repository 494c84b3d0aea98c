"""The live forecast, polled again and again, as a stream of documents.

Polls land in folders ``polled_s=<unix seconds>``; later ones repeat most instants of
earlier ones with newer values, and a document may arrive after its successors. The stream
keeps the latest value of every grid point and instant as state, by time of poll and not by
arrival. A watermark on the forecast instants drops the state of instants that no poll can
still change. What a micro-batch changed is merged into a stored table under the batch's
name, so a batch that runs twice after a restart is merged once.
"""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lullspark.operators import weather
from lullspark.session import materialise
from lullspark.sources.tables import SPAN_MS, merge_stored, publish, scan, version
from lullspark.sources.weather import LIVE_VARIABLES, live_rows, live_schema

POINT = ["timestamp_s", "lat", "lng"]
POINT_KEY = [POINT]
# A poll reaches a week ahead; two days more for late documents.
LATENESS = "9 days"


def latest_points(rows: DataFrame, by: Sequence[str] = POINT) -> DataFrame:
    """``*by`` with the value of the latest poll that has one, for every variable.

    Polls at the same second that differ count by value, so repeats agree.
    """
    newest = [
        F.max_by(v, F.when(F.col(v).isNotNull(), F.struct("polled_s", v))).alias(v) for v in LIVE_VARIABLES
    ]
    return rows.groupBy(*by).agg(*newest)


def follow_live(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    name: str = "live_points",
    lateness: str = LATENESS,
    lines: bool = False,
) -> StreamingQuery:
    """Take in all documents that have landed since the last run, into a stored table.

    Instants older than the newest one by more than ``lateness`` are final: documents that
    still change them are too late and have no effect.
    """
    documents = spark.readStream.schema(f"{live_schema()}, polled_s long").option("multiLine", not lines).json(landing)
    polled = live_rows(documents, ["polled_s"])
    timed = polled.withColumn("instant", F.timestamp_seconds("timestamp_s")).withWatermark("instant", lateness)
    latest = latest_points(timed, ["instant", *POINT]).drop("instant")

    def write(batch: DataFrame, batch_id: int) -> None:
        delta, label = materialise(batch), f"live-{batch_id}"
        if delta.isEmpty():
            return
        if version(spark, root, name) is None:
            publish(delta, root, name, candidates=POINT_KEY, ts="timestamp_s", width=SPAN_MS // 1000, batch=label)
        else:
            merge_stored(delta, root, name, label, POINT, LIVE_VARIABLES, candidates=POINT_KEY)

    return (
        latest.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", posixpath.join(checkpoint, name))
        .trigger(availableNow=True)
        .start()
    )


def live_index(spark: SparkSession, root: str, name: str = "live_points") -> DataFrame:
    """The index per instant from the latest values of all points."""
    return weather.live_index(scan(spark, root, name))
