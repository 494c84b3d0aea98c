"""Packed blocks of rows and the ranks that are computed from them."""

import math
import os
import random

import numpy as np
import pandas as pd
import pytest

from lullspark.operators import correlation as C
from lullspark.operators import rank_blocks as R


def matrix(df):
    return {(r.column_x, r.column_y): r.correlation for r in df.collect()}


def assert_ranks(got, pdf, names):
    assert len(got) == len(names) ** 2
    for x in names:
        for y in names:
            both = pdf[[x, y]].dropna() if x != y else pdf[[x]].dropna()
            want = 1.0 if x == y else both[x].rank().corr(both[y].rank())
            if both.nunique().min() < 2:
                assert got[x, y] is None, (x, y)
            else:
                assert got[x, y] == pytest.approx(want, abs=1e-9), (x, y)


def test_arrays_come_back_as_they_were():
    rng = np.random.default_rng(3)
    floats = [
        [], [0.0], [1.0, 2.0, 2.0, 900.0], [7.25, -3.1, 0.07], [-math.inf, -1e300, 5e-324, math.inf], [1e308, -1e308, 0.1],
        np.sort(rng.random(50)), rng.random(50) - 0.5, np.round(rng.random(50) * 1e5, 2), [2.0**60, 3.0],
    ]
    whole = [[], [5], [-(1 << 62), 1 << 62], [3, 1, 2], [-9, -9, 4], [0, 1 << 40]]
    arrays = [np.array(f, float) for f in floats] + [np.array(w, np.int64) for w in whole] + [np.arange(300, dtype=np.uint16), np.packbits([True, False, True])]
    found = R.unpack(R.pack(*arrays))
    assert len(found) == len(arrays)
    for a, b in zip(arrays, found):
        assert a.tolist() == b.tolist() and (a.dtype.kind == "f") == (b.dtype.kind == "f")


def test_cuts_and_the_ranges_between_them():
    assert R.place(np.array([1.0, 3.0]), np.array([0.0, 1.0, 2.0, 3.0, 4.0])).tolist() == [0, 1, 2, 3, 4]
    assert R.place(np.empty(0), np.array([5.0])).tolist() == [0]
    counts = np.array([[2], [3], [1], [0], [4]])
    # Ranks 1, 2 | 3 to 5, mean 4 | 6 | none | 7 to 10; doubled and from the mean 11.
    assert R.begins(counts)[:, 0].tolist() == [-10, -3, 0, 2, 2]
    assert R.doubled_ranks(np.array([1, 2, 3]), np.array([1, 1, 1]), R.begins(counts)[:, 0]).tolist() == [-3, 1, 2]


@pytest.mark.parametrize("few", [(), (0, 4), (0, 1, 2, 3, 4, 5)])
def test_small_blocks_and_ranges_give_the_same_ranks(spark, monkeypatch, few):
    """Many blocks, ranges and batches; hot values, infinities, -0.0, a column without values."""
    for name, size in {"BLOCK_ROWS": 130, "LEAST_BINS": 7, "SORTED_ROWS": 300, "CUT_ROWS": 16, "CODES": 8}.items():
        monkeypatch.setattr(R, name, size)
    rng = random.Random(len(few))
    names = list("abcdef")
    data = [
        (
            float(rng.randint(0, 4)),
            0.0 if i % 3 else rng.choice([None, -0.0, rng.random()]),
            float(i),
            rng.choice([None, math.inf, -math.inf, round(rng.random(), 2)]),
            rng.choice([None, i % 10 + rng.random()]),
            None,
        )
        for i in range(2000)
    ]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names)).repartition(3)
    found = R.rank_correlations(C._packed(df, names), 6, few, 0, bin_rows=100).to_pylist()
    got = {(names[r[k]], names[r[m]]): r["correlation"] for r in found for k, m in (("column_x", "column_y"), ("column_y", "column_x"))}
    assert_ranks(got, pd.DataFrame(data, columns=names, dtype=float), names)


def test_columns_may_be_empty_or_alone(spark):
    assert matrix(C.corr_spearman(spark.createDataFrame([], "a double, b int"), ["a", "b"])) == dict.fromkeys([("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")])
    df = spark.createDataFrame([(1.0,), (None,), (2.0,)], "a double")
    assert matrix(C.corr_spearman(df, ["a"])) == matrix(C.corr_spearman(df, ["a"], few_values=0)) == {("a", "a"): 1.0}


def kept_bytes(spark):
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


def test_spearman_keeps_little_on_disk(spark):
    """What is stored for twelve columns, four of them of many values, is a fraction of their
    96 bytes a row."""
    rng, n = np.random.default_rng(8), 20_000
    names = [f"c{i}" for i in range(12)]
    pdf = pd.DataFrame({c: np.round(rng.random(n) * 1e5, 2) if i < 4 else rng.integers(0, 3 + i, n) for i, c in enumerate(names)}, dtype=float)
    for i, c in enumerate(names):
        pdf.loc[rng.random(n) < 0.1 * (i % 3), c] = None
    df = spark.createDataFrame(pdf)
    C.corr_spearman(df.limit(2), names).collect()  # names the folder
    before = kept_bytes(spark)
    got = matrix(C.corr_spearman(df, names, few_values=100))
    assert kept_bytes(spark) - before < 32 * n
    assert_ranks(got, pdf, names)
