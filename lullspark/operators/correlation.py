"""Pairwise-complete correlation matrices: Pearson, Spearman, Kendall tau-b."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lullspark.operators.chunks import range_chunks, row_index
from lullspark.operators.rank_blocks import rank_correlations
from lullspark.registry import KEYS

PAIR = ["column_x", "column_y"]
BLOCK_ROWS = 1 << 20
# Distinct values of a column whose ranks every task gets: about 800 KB for 12 columns.
FEW_VALUES = 1 << 12


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_matrix(df: DataFrame, key: str = "unix_timestamp_ms") -> DataFrame:
    """Numeric columns only, without the last of several columns named ``key``."""
    fields = df.schema.fields
    copies = [i for i, f in enumerate(fields) if f.name == key]
    dropped = copies[-1] if len(copies) > 1 else None
    unique = df.toDF(*[f"_{i}" for i in range(len(fields))])
    keep = [i for i, f in enumerate(fields) if i != dropped and isinstance(f.dataType, T.NumericType)]
    return unique.select(*[F.col(f"_{i}").alias(fields[i].name) for i in keep])


def history_input(market: DataFrame, weather: DataFrame, share_rows: DataFrame) -> DataFrame:
    """Hourly market, weather of the same instant and shares of the same key."""
    hourly = weather.where(F.col("resolution") == "hour").drop("resolution").withColumnRenamed(
        "date_ms", "unix_timestamp_ms"
    )
    return (
        market.where(F.col("resolution") == "hour")
        .join(share_rows, KEYS)
        .join(hourly, "unix_timestamp_ms")
    )


def forecast_input(market: DataFrame, forecast: DataFrame, share_rows: DataFrame) -> DataFrame:
    """As ``history_input`` with forecasts; every model at once, one row per model."""
    hourly = forecast.where(F.col("temporal_resolution") == "hour").drop("temporal_resolution")
    keyed = hourly.withColumn("unix_timestamp_ms", F.col("timestamp_s") * F.lit(1000))
    return (
        market.where(F.col("resolution") == "hour")
        .join(share_rows, KEYS)
        .join(keyed, "unix_timestamp_ms")
    )


def _value(name: str) -> Column:
    """As double; NaN counts as missing."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def _corr(x: str, y: str) -> Column:
    """Pearson correlation; null where a column has one value only, which ``corr`` divides by."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _packed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.array(*[_value(c) for c in columns]).alias("v"))


def _pair_rows(packed: DataFrame, width: int, diagonal: bool = False) -> DataFrame:
    """One row per column pair and complete observation; columns by position.

    Two explodes of one array keep the plan small however many pairs there are.
    """
    gap = 0 if diagonal else 1
    left = packed.select("v", F.posexplode("v").alias("column_x", "x")).where(F.col("x").isNotNull())
    rest = F.slice("v", F.col("column_x") + gap + 1, F.lit(width))
    both = left.select("column_x", "x", F.posexplode(rest).alias("_p", "y")).where(F.col("y").isNotNull())
    return both.select("column_x", (F.col("column_x") + F.col("_p") + gap).alias("column_y"), "x", "y")


def _mirror(found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Named, in both orders of every pair; the diagonal once.

    Every pair of columns has its cells: null where no row has both values.
    """
    n = len(columns)
    x_of, y_of = F.expr(f"cast(id div {n} as int)"), (F.col("id") % n).cast("int")
    every = found.sparkSession.range(n * n).select(x_of.alias("column_x"), y_of.alias("column_y"))
    upper = every.where("column_x <= column_y").join(found, PAIR, "left")
    names = F.array(*[F.lit(c) for c in columns])
    x, y = (F.get(names, F.col(c)) for c in PAIR)
    r = F.col("correlation")
    both = F.array(
        F.struct(x.alias("column_x"), y.alias("column_y"), r.alias("correlation")),
        F.struct(y.alias("column_x"), x.alias("column_y"), r.alias("correlation")),
    )
    same = F.col("column_x") == F.col("column_y")
    return upper.select(F.inline(F.when(same, F.slice(both, 1, 1)).otherwise(both)))


def _per_column(df: DataFrame, cells: Sequence[Column]) -> DataFrame:
    """One aggregate row as diagonal rows of the matrix."""
    row = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    return row.select(F.posexplode(F.array(*[f"c{i}" for i in range(len(cells))])).alias("column_x", "correlation")).select(
        "column_x", F.col("column_x").alias("column_y"), "correlation"
    )


def corr_pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_x, column_y, correlation``, every ordered pair, in one pass.

    Partial aggregates combine before the shuffle, so only a few rows per task move; the
    plan is the same for any number of columns.
    """
    columns = list(columns)
    rows = _pair_rows(_packed(df, columns), len(columns), diagonal=True)
    return _mirror(rows.groupBy(*PAIR).agg(_corr("x", "y").alias("correlation")), columns)


def _spearman_sparse(rows: DataFrame, width: int, few: Sequence[int] | None = None, few_values: int = FEW_VALUES) -> DataFrame:
    """``column_x <= column_y`` by place; ranks count only the rows that have both values.

    Ranks of the columns ``few``, or else of those of ``few_values`` values at most, are looked
    up where a row is stored. Values of the others are moved to their ranks and on to those of
    one other column at a time.
    """
    return rows.sparkSession.createDataFrame(rank_correlations(rows, width, few, few_values))


def corr_spearman(df: DataFrame, columns: Sequence[str], few_values: int = FEW_VALUES) -> DataFrame:
    """Pearson correlation of average ranks over the complete rows of each pair.

    Rows are stored once, in packed blocks, and read once for each pair of columns of more
    than ``few_values`` distinct values; that number decides only the way. The disk holds the
    blocks and what one such pair moves. A hot value is spread over all tasks.
    """
    columns = list(columns)
    return _mirror(_spearman_sparse(_packed(df, columns), len(columns), few_values=few_values), columns)


def weighted_inversions(ranks: np.ndarray, weights: np.ndarray) -> int:
    """Sum of ``w_i * w_j`` over ``i < j`` with ``ranks_i > ranks_j`` (distinct ranks).

    Two ranks differ first in one bit. Going down the bits, rows that agree above
    it stand together in their original order; a row with 0 meets the weight of the
    rows with 1 before it.
    """
    n = len(ranks)
    if n < 2:
        return 0
    w = weights.astype(np.int64)
    if float(w.sum()) ** 2 > 2.0**62:
        w = weights.astype(object)
    r = np.empty(n, dtype=np.int64)
    r[np.argsort(ranks, kind="stable")] = np.arange(n)
    total = 0
    for bit in range(int(n - 1).bit_length() - 1, -1, -1):
        one = (r >> bit) & 1
        ones = np.cumsum(w * one)
        group = r >> (bit + 1)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[first, n])
        before_group = np.repeat(ones[first] - (w * one)[first], sizes)
        total += int(np.sum((w * (1 - one)) * (ones - before_group)))
        order = np.argsort(r >> bit, kind="stable")
        r, w = r[order], w[order]
    return total


def _block_inversions(rows: DataFrame) -> DataFrame:
    """Discordant weight inside x blocks and, between x blocks, inside y blocks.

    A block holds a bounded number of rows. In a y block, rows of one x block stand
    in y order, so only rows of different x blocks can be inverted.
    """
    blocks = F.array(
        F.struct(F.lit("x").alias("axis"), F.col("xb").alias("block"), F.col("xp").alias("first"), F.lit(0).cast("long").alias("second")),
        F.struct(F.lit("y").alias("axis"), F.col("yb").alias("block"), F.col("xb").alias("first"), F.col("yp").alias("second")),
    )

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = pdf["first"].to_numpy(), pdf["second"].to_numpy()
        found = 0
        if first.min() != first.max():
            order = np.lexsort((second, first))
            found = weighted_inversions(pdf["yp"].to_numpy()[order], pdf["w"].to_numpy()[order])
        return pd.DataFrame({"column_x": [key[0]], "column_y": [key[1]], "d": [str(found)]})

    spread = rows.select(*PAIR, "yp", "w", F.inline(blocks))
    return spread.groupBy(*PAIR, "axis", "block").applyInPandas(count, "column_x int, column_y int, d string")


def block_cells(rows: DataFrame) -> DataFrame:
    """``*PAIR, level, parent, yb, low, high``: what the occupied cells of x and y blocks
    hold, for every level of the bits of the x block's number.

    Two x blocks differ first in one bit. At the level of that bit they share the bits above
    it, their parent, and one is on the low side, the other on the high one. A cell occurs
    once at each level, so there are as many rows as occupied cells times levels, at most.
    """
    cells = rows.groupBy(*PAIR, "xb", "yb").agg(F.sum("w").cast("decimal(38,0)").alias("n"))
    top = cells.groupBy(*PAIR).agg(F.max("xb").alias("_top"))
    levels = F.explode(F.sequence(F.lit(0), F.length(F.bin("_top")) - 1)).alias("level")
    spread = cells.join(top, PAIR).where("_top > 0").select(*PAIR, "xb", "yb", "n", levels)
    side = F.expr("shiftright(xb, level) & 1")
    return spread.groupBy(*PAIR, "level", F.expr("shiftright(xb, level + 1)").alias("parent"), "yb").agg(
        F.sum(F.when(side == 0, F.col("n"))).alias("low"), F.sum(F.when(side == 1, F.col("n"))).alias("high")
    )


def _cell_inversions(rows: DataFrame) -> DataFrame:
    """Discordant weight between different x blocks and different y blocks: at each level
    the low side of a parent meets what the high side has in smaller y blocks. The work is
    spread by pair, level and parent."""
    before = Window.partitionBy(*PAIR, "level", "parent").orderBy("yb").rowsBetween(Window.unboundedPreceding, -1)
    met = block_cells(rows).withColumn("_met", F.sum("high").over(before)).where("low is not null and _met is not null")
    product = F.col("low").cast("decimal(19,0)") * F.col("_met").cast("decimal(19,0)")
    return met.select(*PAIR, product.cast("string").alias("d"))


def _tie_pairs(weighted: DataFrame) -> DataFrame:
    """Pairs of rows in all (n0), equal in x (n1), in y (n2) and in both (n3)."""

    def pairs(n: str) -> Column:
        return F.col(n).cast("double") * (F.col(n).cast("double") - 1) / 2

    one_axis = (
        weighted.groupingSets([[*PAIR, "x"], [*PAIR, "y"]], *PAIR, "x", "y")
        .agg(F.sum("w").alias("_w"), F.grouping("y").alias("_by_x"))
        .select(*PAIR, F.when(F.col("_by_x") == 1, "n1").otherwise("n2").alias("part"), pairs("_w").alias("v"))
    )
    whole = weighted.groupBy(*PAIR).agg(F.sum("w").alias("_w"), F.sum(pairs("w")).alias("_both"))
    rest = F.array(
        F.struct(F.lit("n0").alias("part"), pairs("_w").alias("v")),
        F.struct(F.lit("n3").alias("part"), F.col("_both").alias("v")),
    )
    return one_axis.unionByName(whole.select(*PAIR, F.inline(rest)))


def corr_kendall(df: DataFrame, columns: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Tau-b of every ordered pair, exact, without pairing rows with rows.

    Equal observations collapse to one weighted row. Rows are numbered in (x, y)
    order and, separately, in y order; a discordant pair is an inversion between
    the two numberings. Both are cut into blocks of ``block_rows``: inversions
    inside an x block or a y block are counted block by block, the rest from the
    totals of the occupied cells of blocks.
    """
    columns = list(columns)
    diagonal = _per_column(df, [F.when(F.count(_value(c)) > 0, 1.0) for c in columns])
    if len(columns) == 1:
        return _mirror(diagonal, columns)
    rows = _pair_rows(_packed(df, columns), len(columns))
    weighted = rows.groupBy(*PAIR, "x", "y").agg(F.count(F.lit(1)).alias("w"))
    by_x = row_index(range_chunks(weighted, [*PAIR, "x", "y"]), PAIR, ["x", "y"], "xp").drop("_chunk")
    by_y = row_index(range_chunks(by_x, [*PAIR, "y", "xp"]), PAIR, ["y", "xp"], "yp")
    placed = by_y.withColumns(
        {"xb": F.expr(f"(xp - 1) div {block_rows}L"), "yb": F.expr(f"(yp - 1) div {block_rows}L")}
    )
    discordant = (
        _block_inversions(placed)
        .unionByName(_cell_inversions(placed))
        .select(*PAIR, F.lit("d").alias("part"), F.col("d").cast("double").alias("v"))
    )
    counts = (
        _tie_pairs(by_y.select(*PAIR, "x", "y", "w"))
        .unionByName(discordant)
        .groupBy(*PAIR)
        .agg(*[F.sum(F.when(F.col("part") == part, F.col("v"))).alias(part) for part in ("n0", "n1", "n2", "n3", "d")])
    )
    score = F.col("n0") - F.col("n1") - F.col("n2") + F.col("n3") - 2 * F.col("d")
    scale = F.sqrt(F.col("n0") - F.col("n1")) * F.sqrt(F.col("n0") - F.col("n2"))
    upper = counts.select(*PAIR, F.try_divide(score, scale).alias("correlation"))
    return _mirror(upper.unionByName(diagonal), columns)


def correlate(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    names = list(columns) if columns else numeric_columns(df)
    methods = {"pearson": corr_pearson, "spearman": corr_spearman, "kendall": corr_kendall}
    if method not in methods:
        raise ValueError(f"unknown method: {method!r}")
    return methods[method](df, names)
