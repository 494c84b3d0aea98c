"""Event search: hand cases, and chunked search against a plain scan."""

import random

import pytest
from conftest import final_plan, rows

from lullspark.operators.events import find_events, low_runs, transitions
from lullspark.plans import requests

SCHEMA = "unix_timestamp_ms long, region string, resolution string, share double"


def series(spark, values, region="DE"):
    return spark.createDataFrame([(t, region, "hour", v) for t, v in values], SCHEMA)


def events(df, threshold=0.3, minimum=1, **kw):
    found = find_events(df, "share", threshold, minimum, **kw).select("start_time", "end_time")
    return sorted((r[0], r[1]) for r in found.collect())


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_run_detection(spark, chunk):
    df = series(spark, [(0, 0.5), (1, 0.2), (2, 0.2), (3, 0.6), (4, 0.1)])
    assert events(df, chunk_ms=chunk) == [(1, 3)]
    assert events(df, minimum=0, chunk_ms=chunk) == [(1, 3), (4, 4)]


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_null_share_is_high(spark, chunk):
    df = series(spark, [(0, 0.2), (1, None), (2, 0.2)])
    assert events(df, chunk_ms=chunk) == [(0, 1)]
    assert events(df, minimum=0, chunk_ms=chunk) == [(0, 1), (2, 2)]


def test_equality_is_low(spark):
    assert events(series(spark, [(0, 0.3), (1, 0.31)])) == [(0, 1)]


@pytest.mark.parametrize("chunk", [1, 4, 100])
def test_gap_is_invisible(spark, chunk):
    assert events(series(spark, [(0, 0.2), (10, 0.2), (11, 0.9)]), chunk_ms=chunk) == [(0, 11)]


def test_negative_instants(spark):
    df = series(spark, [(-5, 0.1), (-4, 0.9), (-1, 0.2), (0, 0.2), (1, 0.8)])
    assert events(df, chunk_ms=3) == [(-5, -4), (-1, 1)]


def brute(values, threshold):
    runs, start = [], None
    for t, v in sorted(values):
        low = v is not None and v <= threshold
        if low and start is None:
            start = t
        if not low and start is not None:
            runs.append((threshold, start, t))
            start = None
    if start is not None:
        runs.append((threshold, start, None))
    return runs


@pytest.mark.parametrize("chunk", [1, 7, 50, 10_000])
def test_chunked_search_equals_scan(spark, chunk):
    rng = random.Random(chunk)
    data, expected = [], []
    cuts = [0.1, 0.3, 0.5, 0.9]
    for region in ("DE", "AT", "LU"):
        values, level = [], 0.5
        for t in range(0, 400):
            if rng.random() < 0.2:
                continue
            if rng.random() < 0.4:
                level = rng.choice([None, 0.05, 0.1, 0.2, 0.3, 0.4, 0.7, 1.0])
            values.append((t, level))
        data += [(t, region, "hour", v) for t, v in values]
        expected += [(region, "hour", *run) for c in cuts for run in brute(values, c)]
    df = spark.createDataFrame(data, SCHEMA)
    found = low_runs(df, "share", cuts, chunk_ms=chunk)
    assert rows(found) == sorted(expected, key=repr)


def test_transitions_of_open_run(spark):
    df = series(spark, [(0, 0.5), (1, 0.2), (2, 0.6), (4, 0.1)])
    found = transitions(df, "share", [0.3], chunk_ms=2).select("unix_timestamp_ms", "event_bucket")
    assert rows(found) == [(1, "START"), (2, "END"), (4, "START")]


def test_rows_are_shuffled_once_without_a_join(spark):
    df = series(spark, [(t, (t % 7) / 7) for t in range(500)])
    plan = final_plan(find_events(df, "share", [0.2, 0.3, 0.4], 1, chunk_ms=50))
    assert "Join" not in plan
    assert "SinglePartition" not in plan
    assert plan.count("_level") and plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 2


def test_search_request_checks_arguments(spark):
    df = series(spark, [(0, 0.2), (86_400_000, 0.9)])
    for bad in ({"region": "XX"}, {"resolution": "minute"}, {"max_share": 1.5}, {"min_duration_ms": -1}, {"start_ms": 5, "end_ms": 1}):
        with pytest.raises(ValueError):
            requests.search_events(df, value="share", **bad)
    found = requests.search_events(df, "DE", "hour", 0.3, 86_400_000, 0, 10**12, "share")
    assert rows(found) == [(0, "DE", "hour", 86_400_000)]
