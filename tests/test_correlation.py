"""Correlation matrices against pandas and plain loops."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import final_plan, rows
from pyspark.sql import functions as F

from lullspark.operators import correlation as C


def matrix(df):
    return {(r.column_x, r.column_y): r.correlation for r in df.collect()}


def brute_tau(x, y):
    pairs = [(a, b) for a, b in zip(x, y) if a is not None and b is not None]
    s = nx = ny = 0
    for i in range(len(pairs)):
        for j in range(i):
            dx, dy = pairs[i][0] - pairs[j][0], pairs[i][1] - pairs[j][1]
            s += (dx > 0) * (dy > 0) + (dx < 0) * (dy < 0) - (dx > 0) * (dy < 0) - (dx < 0) * (dy > 0)
            nx += dx != 0
            ny += dy != 0
    return s / math.sqrt(nx * ny)


def test_seven_point_example(spark):
    df = spark.createDataFrame(list(zip(range(1, 8), [2, 1, 7, 6, 5, 4, 3])), "x int, y int")
    assert matrix(C.correlate(df, ["x", "y"], "spearman"))["x", "y"] == pytest.approx(0.25)
    tau = matrix(C.correlate(df, ["x", "y"], "kendall"))
    assert tau["x", "y"] == tau["y", "x"] == pytest.approx(-1 / 21) and tau["x", "x"] == 1.0
    with pytest.raises(ValueError):
        C.correlate(df, ["x", "y"], "cosine")


def test_monotone_curves_have_tau_one(spark):
    data = [(float(x), 100.0 * x, float(x * x), math.exp(x / 11)) for x in range(101)]
    got = matrix(C.corr_kendall(spark.createDataFrame(data, "x double, a double, b double, c double"), ["x", "a", "b", "c"], block_rows=7))
    assert all(v == pytest.approx(1.0) for v in got.values()) and len(got) == 16


@pytest.mark.parametrize("block", [1, 4, 17, 1 << 20])
def test_kendall_with_ties_and_nulls(spark, block):
    rng = random.Random(block)
    data = [tuple(rng.choice([None, 0.0, 0.0, 0.0, *range(k)]) for k in (4, 40, 9)) for _ in range(160)]
    data = [tuple(None if v is None else float(v) for v in row) for row in data]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = matrix(C.corr_kendall(df, ["a", "b", "c"], block_rows=block))
    for i, x in enumerate("abc"):
        for j, y in enumerate("abc"):
            want = 1.0 if i == j else brute_tau([r[i] for r in data], [r[j] for r in data])
            assert got[x, y] == pytest.approx(want), (x, y)


def test_pearson_and_spearman_equal_pandas(spark):
    rng = random.Random(5)
    data = [tuple(rng.choice([None, 0.0, 0.0, rng.random(), float(rng.randint(0, 5))]) for _ in range(3)) for _ in range(120)]
    df, pdf = spark.createDataFrame(data, "a double, b double, c double"), pd.DataFrame(data, columns=list("abc"), dtype=float)
    pearson = matrix(C.corr_pearson(df, list("abc")))
    spearman = matrix(C.corr_spearman(df, list("abc")))
    for x in "abc":
        for y in "abc":
            both = pdf[[x, y]].dropna() if x != y else pdf[[x]].dropna()
            assert pearson[x, y] == pytest.approx(both[x].corr(both[y]))
            assert spearman[x, y] == pytest.approx(both[x].rank().corr(both[y].rank()))


def test_weighted_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64):
        ranks, w = rng.permutation(n), rng.integers(1, 5, n)
        want = sum(int(w[i] * w[j]) for j in range(n) for i in range(j) if ranks[i] > ranks[j])
        assert C.weighted_inversions(ranks, w) == want
    huge = np.array([1 << 40, 1 << 40])
    assert C.weighted_inversions(np.array([1, 0]), huge) == 1 << 80


def test_numeric_matrix_drops_the_last_key_copy(spark):
    df = spark.createDataFrame([(1, "x", 2.0, 1, True)], "t long, s string, v double, u long, f boolean").toDF("t", "s", "v", "t", "f")
    out = C.numeric_matrix(df, "t")
    assert out.columns == ["t", "v"] and rows(out) == [(1, 2.0)]


def test_inputs_join_on_the_instant(spark):
    key = "unix_timestamp_ms long, region string, resolution string"
    market = spark.createDataFrame([(3_600_000, "DE", "hour", 1.0), (7_200_000, "DE", "day", 2.0)], f"{key}, m double")
    share = spark.createDataFrame([(3_600_000, "DE", "hour", 0.5)], f"{key}, s double")
    weather = spark.createDataFrame([(3_600_000, "hour", 9.0), (3_600_000, "day", 8.0)], "date_ms long, resolution string, w double")
    assert rows(C.history_input(market, weather, share).select("m", "s", "w")) == [(1.0, 0.5, 9.0)]
    forecast = spark.createDataFrame([(3600, "a", "hour", 4.0), (3600, "b", "hour", 5.0)], "timestamp_s long, model string, temporal_resolution string, r double")
    assert rows(C.forecast_input(market, forecast, share).select("model", "m", "s", "r")) == [("a", 1.0, 0.5, 4.0), ("b", 1.0, 0.5, 5.0)]


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_every_pair_has_its_cells(spark, method):
    data = [(1.0, None, 3.0, None), (2.0, None, 1.0, None), (None, 5.0, None, None), (None, 7.0, None, None)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    got = matrix(C.correlate(df, ["a", "b", "c", "d"], method))
    assert len(got) == 16
    assert got["a", "b"] is None and got["d", "d"] is None and got["b", "b"] == pytest.approx(1)
    assert got["a", "c"] == got["c", "a"] == pytest.approx(-1)


def test_blocks_on_a_diagonal_make_few_cells(spark):
    """64 occupied cells of 64 x 64: as many rows as cells times levels, and the exact count."""
    rng = random.Random(4)
    data = [(0, 1, b, b, rng.randint(1, 9)) for b in range(64)]
    data += [(0, 2, a, b, rng.randint(1, 9)) for a, b in rng.sample([(a, b) for a in range(64) for b in range(64)], 200)]
    df = spark.createDataFrame(data, "column_x int, column_y int, xb long, yb long, w long")
    cells = C.block_cells(df).groupBy("column_y").count().collect()
    counts = {r["column_y"]: r["count"] for r in cells}
    assert counts[1] <= 64 * 6 and counts[2] <= 200 * 6
    got = {}
    for r in C._cell_inversions(df).collect():
        got[r["column_y"]] = got.get(r["column_y"], 0) + int(r["d"])
    mine = [d[2:] for d in data if d[1] == 2]
    want = sum(n * m for a, b, n in mine for c, d, m in mine if a < c and b > d)
    assert got.get(1, 0) == 0 and got[2] == want


def test_spearman_of_scattered_nulls(spark):
    """Twelve columns with many patterns of nulls, one column without any, one with one value."""
    rng = random.Random(12)
    names = [f"c{i}" for i in range(12)]
    data = [
        tuple(
            1.5 if i == 11 else None if i and rng.random() < 0.15 * (i % 4) else float(rng.randint(0, 3 + 7 * i))
            for i in range(12)
        )
        for _ in range(300)
    ]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names))
    got, pdf = matrix(C.corr_spearman(df, names)), pd.DataFrame(data, columns=names, dtype=float)
    assert len(got) == 144
    for x in names:
        for y in names:
            both = pdf[[x, y]].dropna() if x != y else pdf[[x]].dropna()
            if "c11" in (x, y):
                assert got[x, y] is None or math.isnan(got[x, y])
            else:
                assert got[x, y] == pytest.approx(both[x].rank().corr(both[y].rank())), (x, y)


def test_spearman_moves_only_columns_of_many_values(spark):
    """The same matrix whether ranks are looked up, moved, or some of each; looked-up
    columns are not among the rows that are grouped."""
    rng = random.Random(21)
    names = list("abcde")
    data = [
        (float(rng.randint(0, 3)), rng.choice([None, 1.0, 2.0, 5.0]), rng.choice([None, rng.random()]), rng.random(), rng.choice([None, float(rng.randint(0, 40))]))
        for _ in range(400)
    ] + [(None, None, None, 0.5, None), (float("nan"), 1.0, None, 0.25, 3.0)]
    df, pdf = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names)), pd.DataFrame(data, columns=names, dtype=float)
    for few in (0, 10, 60, 10_000):
        got = matrix(C.corr_spearman(df, names, few_values=few))
        for x in names:
            for y in names:
                both = pdf[[x, y]].dropna() if x != y else pdf[[x]].dropna()
                want = both[x].rank().corr(both[y].rank()) if x != y else 1.0
                assert got[x, y] == pytest.approx(want), (few, x, y)
    ids = C._packed(df, names).withColumn("_row", F.monotonically_increasing_id())
    assert "collect_list" not in final_plan(C._spearman_sparse(ids, 5, range(5)))
