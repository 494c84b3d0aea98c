"""Exact duplicates by a sort of the contents.

Sampled splitters range-partition the rows by text, an external sort within each
partition puts equal texts next to each other, and each text is compared in full with
its neighbour. A group of equal texts may span partitions, however many rows it has:
the splitters include the identifier, and groups are stitched over the borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lullspark.llm.common import row_text, stored

# Characters of the text in a splitter. The digest follows, then the whole text in the
# sort; so splitters, which the driver samples, stay small with texts of any length.
SPLITTER_CHARS = 48


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours; the partition's first and last row carry their text."""
    part, row, run, last_text, held = TaskContext.get().partitionId(), 0, -1, None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if held is not None:
            yield held
        text = batch.column("text")
        previous = pa.concat_arrays([pa.array([last_text], text.type), text.slice(0, n - 1)])
        first = pc.fill_null(pc.not_equal(text, previous), True)
        runs = pc.add(pc.cumulative_sum(first.cast(pa.int64())), run)
        border = [text[0].as_py() if row == 0 else None] + [None] * (n - 1)
        marked = pa.RecordBatch.from_arrays(
            [
                pa.array([part] * n, pa.int64()),
                pa.array(range(row, row + n), pa.int64()),
                runs,
                first,
                batch.column("doc_id"),
                batch.column("sha"),
                pa.array(border, pa.string()),
            ],
            names=["part", "row", "run", "first", "doc_id", "sha", "border"],
        )
        yield marked.slice(0, n - 1)
        row, run, last_text, held = row + n, runs[-1].as_py(), text[-1].as_py(), marked.slice(n - 1)
    if held is not None:
        at = held.schema.get_field_index("border")
        yield held.set_column(at, "border", pa.array([last_text], pa.string()))


def _stitched(runs: DataFrame, marked: DataFrame) -> DataFrame:
    """``part, run, keep_id, group_size, whole`` of the runs at borders; ``whole`` is
    false for a run that goes on one begun in an earlier partition.

    Whether neighbouring partitions join is a full comparison of texts in an equi join;
    the windows without a key see at most two narrow rows of each partition.
    """
    parts = marked.where("border is not null").groupBy("part").agg(
        F.min_by("border", "row").alias("head"),
        F.max_by("border", "row").alias("tail"),
        F.max("run").alias("last"),
    )
    places = parts.select("part", "last", F.row_number().over(Window.orderBy("part")).alias("place"))
    texts = parts.select("part", "head", "tail").join(places, "part")
    here = texts.select("part", "last", F.col("head").alias("text"), "place")
    earlier = texts.select(F.col("tail").alias("earlier"), (F.col("place") + 1).alias("place"))
    joined = here.join(earlier, "place", "left").select(
        "part", "last", F.coalesce(F.col("text") == F.col("earlier"), F.lit(False)).alias("joined")
    )
    ends = joined.select(
        "part",
        F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), "last"))).alias("run"),
        "joined",
    ).withColumn("joined", F.col("joined") & (F.col("run") == 0))
    ordered = Window.orderBy("part", "run")
    chain = F.sum((~F.col("joined")).cast("long")).over(ordered)
    group = Window.partitionBy("chain")
    return (
        ends.withColumn("chain", chain)
        .join(runs, ["part", "run"])
        .select(
            "part",
            "run",
            F.min_by("keep_id", F.struct("part", "run")).over(group).alias("chain_keep"),
            F.sum("group_size").over(group).alias("chain_size"),
            (~F.col("joined")).alias("whole"),
        )
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Of equal texts the row with the largest ``doc_id`` stays (a null id only where there
    is no other); of rows equal in both, one stays. A null text equals an empty one. An
    empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select("doc_id", row_text().alias("text")).withColumn("sha", F.sha2("text", 256))
    order = [F.substring("text", 1, SPLITTER_CHARS), F.col("sha")]
    sorted_rows = rows.repartitionByRange(*order, F.desc("doc_id")).sortWithinPartitions(
        *order, "text", F.desc("doc_id")
    )
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"part long, row long, run long, first boolean, doc_id {kind}, sha string, border string"
    marked = stored(sorted_rows.select("doc_id", "sha", "text").mapInArrow(_mark_runs, schema), "dedup")
    runs = marked.groupBy("part", "run").agg(
        F.min_by("doc_id", "row").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    groups = runs.join(_stitched(runs, marked), ["part", "run"], "left").select(
        "part",
        "run",
        F.when(F.col("whole").isNull(), F.col("keep_id")).otherwise(F.col("chain_keep")).alias("keep_id"),
        F.coalesce("chain_size", "group_size").alias("group_size"),
        F.coalesce("whole", F.lit(True)).alias("whole"),
    )
    return marked.select("part", "run", "first", "doc_id", "sha").join(groups, ["part", "run"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("first") & F.col("whole")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
