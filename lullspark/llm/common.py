"""What several operators of this subpackage share."""

from __future__ import annotations

import string
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lullspark.session import give_up_shuffles, shared_checkpoint_dir  # noqa: F401

# Everything but blank, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder that all executors share."""
    return f"{shared_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Written once to the shared folder and read back, so later steps agree and
    a lost executor costs a reread only."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Only A-Z lower-cased; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def row_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def as_rows(docs: DataFrame) -> DataFrame:
    """The whole rows as one column ``row``, so that a stage's own columns never meet names
    of the table; ``select("row.*")`` gives them back. Names may hold any character."""
    names = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    return docs.select(F.struct(*names).alias("row"))


def numbered(df: DataFrame, groups: Sequence[str], chunk: str, order: Sequence[str], name: str) -> DataFrame:
    """Gapless numbers from 0 within each group, although a group may be of any size.

    Rows are ranked within ``(group, chunk)``; a small table with one row per
    chunk says where each chunk begins. ``chunk`` must follow from the row's content.
    """
    keys = [*groups, chunk]
    before = Window.partitionBy(*groups).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    ranked = df.withColumn("_rank", rank)
    return ranked.join(starts, keys).withColumn(name, F.col("_start") + F.col("_rank")).drop("_start", "_rank")
