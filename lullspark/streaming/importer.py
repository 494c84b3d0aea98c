"""Incremental import of landed market documents.

The import is an upsert that may be repeated at any time: new documents arrive,
later non-null values win, nulls never erase. As a stream, every micro-batch turns
its new documents into one wide, sparse delta and writes it under its own batch id.
Nothing is read and rewritten in place: a batch that is retried overwrites only its
own folder, so a lost executor or driver never leaves half an update behind. The
current table is the last non-null value per key and column over all deltas.

``merge_indexes`` and ``merge_points`` keep a stored table instead, cut into spans of time:
a batch reads and writes only the series and spans that it has rows of. The table notes the
batches that it holds, so a retried one changes nothing. Both ways give the same table.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lullspark.operators.upsert import BUCKET, widen
from lullspark.registry import COLUMN_BY_ID, KEYS, MEASURES
from lullspark.session import materialise
from lullspark.sources.market import BUCKET_SCHEMA, INDEX_SCHEMA, index_rows, point_rows
from lullspark.sources.tables import merge_stored, publish, version

BATCH = "batch_id"
PARTS = ["resolution", "region"]


def _delta(rows: DataFrame) -> DataFrame:
    """Wide rows of one batch; within it point values come after bucket starts."""
    columns = F.create_map(*[F.lit(v) for pair in COLUMN_BY_ID.items() for v in pair])
    named = rows.select(
        *KEYS,
        F.element_at(columns, F.col("series_id")).alias("series"),
        F.col("value").cast("decimal(11,2)").alias("value"),
        BUCKET,
        F.when(F.col(BUCKET), F.lit(0)).otherwise(F.lit(1)).alias("seq"),
    )
    return widen(named, names=MEASURES)


def _import(
    spark: SparkSession, landing: str, schema: str, to_rows, table: str, kind: str, checkpoint: str, lines: bool
) -> StreamingQuery:
    documents = spark.readStream.schema(schema).option("multiLine", not lines).json(landing)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Indexes sort before points, whichever arrives first.
        name = f"{batch_id:019d}-{kind}"
        _delta(to_rows(batch)).write.mode("overwrite").parquet(posixpath.join(table, f"{BATCH}={name}"))

    return (
        documents.writeStream.foreachBatch(write)
        .option("checkpointLocation", posixpath.join(checkpoint, kind))
        .trigger(availableNow=True)
        .start()
    )


def import_indexes(
    spark: SparkSession, landing: str, table: str, checkpoint: str, lines: bool = False
) -> StreamingQuery:
    """First pass: bucket-start rows carrying the sentinel."""
    return _import(spark, landing, INDEX_SCHEMA, index_rows, table, "index", checkpoint, lines)


def import_points(
    spark: SparkSession, landing: str, table: str, checkpoint: str, lines: bool = False
) -> StreamingQuery:
    """Second pass: the values of every landed bucket document."""
    return _import(spark, landing, BUCKET_SCHEMA, point_rows, table, "points", checkpoint, lines)


def _merge(
    spark: SparkSession, landing: str, schema: str, to_rows, root: str, name: str, kind: str, checkpoint: str, lines: bool
) -> StreamingQuery:
    documents = spark.readStream.schema(schema).option("multiLine", not lines).json(landing)

    def write(batch: DataFrame, batch_id: int) -> None:
        # The wide rows are read for their spans and for the merge.
        delta = materialise(_delta(to_rows(batch)))
        label = f"{kind}-{batch_id}"
        if version(spark, root, name) is None:
            publish(delta, root, name, PARTS, ts="unix_timestamp_ms", batch=label)
        else:
            merge_stored(delta, root, name, label, keep_known=kind == "index")

    return (
        documents.writeStream.foreachBatch(write)
        .option("checkpointLocation", posixpath.join(checkpoint, kind))
        .trigger(availableNow=True)
        .start()
    )


def merge_indexes(
    spark: SparkSession, landing: str, root: str, name: str, checkpoint: str, lines: bool = False
) -> StreamingQuery:
    """Bucket starts into a stored table: flags and, where no value is known, sentinels."""
    return _merge(spark, landing, INDEX_SCHEMA, index_rows, root, name, "index", checkpoint, lines)


def merge_points(
    spark: SparkSession, landing: str, root: str, name: str, checkpoint: str, lines: bool = False
) -> StreamingQuery:
    """Values into a stored table; the later document wins, nulls never erase."""
    return _merge(spark, landing, BUCKET_SCHEMA, point_rows, root, name, "points", checkpoint, lines)


def current_table(spark: SparkSession, table: str) -> DataFrame:
    """All deltas merged: one grouped pass that combines before its shuffle.

    A sentinel from an index never replaces a value already known.
    """
    deltas = spark.read.parquet(table)
    rank = F.concat(F.split(F.col(BATCH), "-")[1], F.lit("/"), F.split(F.col(BATCH), "-")[0])
    ranked = deltas.withColumn("_rank", rank)
    merged = [F.max_by(m, F.when(F.col(m).isNotNull(), F.col("_rank"))).alias(m) for m in MEASURES]
    return ranked.groupBy(*KEYS).agg(F.max(BUCKET).alias(BUCKET), *merged)
