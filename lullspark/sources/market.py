"""Landed market documents.

Layout: ``<root>/series_id=<id>/region=<region>/resolution=<resolution>/*.json``.
Spark reads the key columns from the folder names and skips the folders a query
does not ask for. As landed, a file holds one document; ``lines`` reads files
compacted to one document per line, which split and scale far better.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullspark.registry import SENTINEL

PARTS = "series_id int, region string, resolution string"
INDEX_SCHEMA = f"timestamps array<bigint>, {PARTS}"
BUCKET_SCHEMA = f"series array<array<double>>, {PARTS}"


def _documents(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    return spark.read.schema(schema).options(multiLine=not lines, ignoreMissingFiles="true").json(path)


def read_market_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Bucket-start rows carrying the sentinel; absent indexes give no rows."""
    return index_rows(_documents(spark, path, INDEX_SCHEMA, lines))


def index_rows(documents: DataFrame) -> DataFrame:
    return documents.select(
        "series_id",
        "region",
        "resolution",
        F.explode("timestamps").alias("unix_timestamp_ms"),
        F.lit(SENTINEL).alias("value"),
        F.lit(True).alias("is_bucket_timestamp"),
    )


def read_market_json(
    spark: SparkSession, path: str, drop_null_points: bool = False, lines: bool = False
) -> DataFrame:
    """Point rows of bucket documents; the first pass drops points without a value."""
    return point_rows(_documents(spark, path, BUCKET_SCHEMA, lines), drop_null_points)


def point_rows(documents: DataFrame, drop_null_points: bool = False) -> DataFrame:
    rows = documents.select("series_id", "region", "resolution", F.explode("series").alias("_p")).select(
        "series_id",
        "region",
        "resolution",
        # Epoch ms stay below 2**53, so the double is exact.
        F.get("_p", F.lit(0)).cast("long").alias("unix_timestamp_ms"),
        F.get("_p", F.lit(1)).alias("value"),
        F.lit(False).alias("is_bucket_timestamp"),
    )
    return rows.where(F.col("value").isNotNull()) if drop_null_points else rows
