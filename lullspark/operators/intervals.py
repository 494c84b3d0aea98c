"""Aggregates of a series over many time intervals.

A plain ``ts BETWEEN lo AND hi`` join is a nested loop. Here both sides are cut at
chunk borders. The chunks that lie wholly inside an interval are covered by dyadic
blocks, of 1, 2, 4, ... chunks, each with one pre-aggregated row; only the two border
chunks contribute raw rows. The join is an equi join on ``(keys, level, block)``, so it
hashes, and an interval of n chunks takes at most 2 log2(n) rows and two borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullspark.operators.chunks import CHUNK, time_chunk, with_time_chunk

DAY_MS = 86_400_000
MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


# Blocks of up to 2^12 chunks; longer stretches take several of the largest.
LEVELS = 12


def dyadic_blocks(first: Column, end: Column, levels: int = LEVELS) -> Column:
    """Array of ``(level, block)`` that cover the chunks from ``first`` to before ``end``.

    Block ``b`` of level ``k`` has the chunks from ``b * 2^k`` on. Of each level at most one
    block at either end is taken, where its number is odd at the left or, exclusive, right.
    """

    def block(level: Column | int, number: Column) -> Column:
        return F.struct(F.lit(level).cast("int").alias("level"), number.cast("long").alias("block"))

    nothing = F.array().cast("array<struct<level:int,block:bigint>>")
    found = [nothing]
    for k in range(levels):
        left, right = -F.shiftright(-first, k), F.shiftright(end, k)
        going = left < right
        found.append(F.when(going & (left.bitwiseAND(F.lit(1)) == 1), F.array(block(k, left))).otherwise(nothing))
        found.append(F.when(going & (right.bitwiseAND(F.lit(1)) == 1), F.array(block(k, right - 1))).otherwise(nothing))
    left, right = -F.shiftright(-first, levels), F.shiftright(end, levels)
    top = F.transform(F.sequence(left, F.greatest(right - 1, left)), lambda b: block(levels, b))
    found.append(F.when(left < right, top).otherwise(nothing))
    return F.concat(*found)


def interval_pieces(intervals: DataFrame, columns: Sequence[str], lo: str, hi: str, chunk_ms: int) -> DataFrame:
    """``*columns, _lo, _hi, _level, _block``: the blocks of each interval, and at level -1
    the chunks at its borders that lie only partly inside."""
    first, last = time_chunk(lo, chunk_ms), time_chunk(hi, chunk_ms)
    cut = intervals.where(F.col(lo) <= F.col(hi)).select(
        *columns,
        F.col(lo).alias("_lo"),
        F.col(hi).alias("_hi"),
        first.alias("_first"),
        last.alias("_last"),
        (first * chunk_ms < F.col(lo)).alias("_cut_first"),
        ((last + 1) * chunk_ms - 1 > F.col(hi)).alias("_cut_last"),
    )
    start = F.col("_first") + F.col("_cut_first").cast("long")
    end = F.col("_last") + 1 - F.col("_cut_last").cast("long")
    border = lambda chunk, here: F.when(
        here, F.array(F.struct(F.lit(-1).alias("level"), F.col(chunk).alias("block")))
    ).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))
    twice = F.col("_cut_first") & (F.col("_first") == F.col("_last"))
    pieces = F.concat(border("_first", F.col("_cut_first")), border("_last", F.col("_cut_last") & ~twice), dyadic_blocks(start, end))
    return cut.select(*columns, "_lo", "_hi", F.inline(pieces)).withColumnsRenamed({"level": "_level", "block": "_block"})


def aggregate_intervals(
    intervals: DataFrame,
    series: DataFrame,
    ids: Sequence[str],
    keys: Sequence[str],
    measures: dict[str, tuple[str, Column]],
    wanted: dict[str, Sequence[str]] | None = None,
    ts: str = "unix_timestamp_ms",
    lo: str = "lo",
    hi: str = "hi",
    chunk_ms: int = DAY_MS,
) -> DataFrame:
    """One row per ``ids`` with aggregates over the closed ``[lo, hi]``.

    ``measures`` maps an output name to ``(kind, column)`` with kind sum, count,
    min or max; they are null where an interval has no row. ``keys`` name the
    series of an interval. With ``wanted`` an id has several intervals told apart
    by a ``role`` column, and each role's measures come out as ``role_measure``.
    """
    ids, keys = list(ids), list(keys)
    states = [
        (F.when(col.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long") if kind == "count" else col).alias(out)
        for out, (kind, col) in measures.items()
    ]
    merged = [MERGE[kind](out).alias(out) for out, (kind, _) in measures.items()]
    tags = ["role"] if wanted else []

    rows = with_time_chunk(series.select(*keys, ts, *states), ts, chunk_ms)
    chunks = rows.groupBy(*keys, CHUNK).agg(*merged)
    levels = F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS)),
        lambda k: F.struct(k.alias("_level"), F.call_function("shiftright", F.col(CHUNK), k).alias("_block")),
    )
    blocks = chunks.select(*keys, *measures, F.inline(levels)).groupBy(*keys, "_level", "_block").agg(*merged)
    both = rows.select(
        *keys, F.lit(-1).alias("_level"), F.col(CHUNK).alias("_block"), F.col(ts).alias("_ts"), *measures
    ).unionByName(blocks.withColumn("_ts", F.lit(None).cast("long")))
    pieces = interval_pieces(intervals, list(dict.fromkeys([*ids, *keys, *tags])), lo, hi, chunk_ms)
    hit = (F.col("_level") >= 0) | F.col("_ts").between(F.col("_lo"), F.col("_hi"))
    met = both.join(pieces, [*keys, "_level", "_block"]).where(hit).select(*ids, *tags, *measures)
    # One empty row per id keeps those no series row meets, without a join back.
    state_types = dict(both.dtypes)
    blank = intervals.select(
        *ids, *[F.lit(None).cast("string").alias(t) for t in tags], *[F.lit(None).cast(state_types[m]).alias(m) for m in measures]
    )
    every = met.unionByName(blank)
    if not wanted:
        return every.groupBy(*ids).agg(*merged)
    return every.groupBy(*ids).agg(
        *[
            MERGE[measures[out][0]](F.when(F.col("role") == role, F.col(out))).alias(f"{role}_{out}")
            for role, outs in wanted.items()
            for out in outs
        ]
    )
