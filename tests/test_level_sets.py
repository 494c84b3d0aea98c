"""The level-set tree against the event search, for any threshold, duration and range."""

import random

import pytest
from conftest import rows

from lullspark.operators import level_sets as L
from lullspark.operators.events import find_events
from lullspark.plans import build, requests
from lullspark.sources import tables

HOUR = 3_600_000
SCHEMA = "unix_timestamp_ms long, region string, resolution string, share double"


def noisy(spark, seed, n=300):
    """Two series with gaps, ties, nulls and long monotone stretches."""
    rng, data = random.Random(seed), []
    for region in ("DE", "AT"):
        for i in range(n):
            if rng.random() < 0.1:
                continue
            v = i / n if 100 < i < 160 else 1 - i / n if 160 <= i < 220 else round(rng.random(), rng.choice([1, 3]))
            data.append((i * HOUR, region, "hour", None if rng.random() < 0.04 else v))
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("chunk_ms", [HOUR, 5 * HOUR, 64 * HOUR, 1000 * HOUR])
def test_sets_answer_any_threshold(spark, monkeypatch, chunk_ms):
    monkeypatch.setattr(L, "FAN_IN", 3)
    df = noisy(spark, chunk_ms).cache()
    sets = L.level_sets(df, "share", chunk_ms=chunk_ms).cache()
    rng = random.Random(9)
    cuts = [*[round(rng.random(), 3) for _ in range(18)], 0.5, 1.0]
    for shortest in (0, HOUR, 6 * HOUR):
        assert rows(L.events_of(sets, cuts, shortest)) == rows(find_events(df, "share", cuts, shortest))
    # Every run is there once, and no more runs than rows.
    assert sets.count() == sets.distinct().count() <= df.count()
    df.unpersist(), sets.unpersist()


def test_no_rows_and_no_low_rows(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert L.level_sets(nothing, "share").collect() == []
    high = spark.createDataFrame([(1, "DE", "hour", None), (2, "DE", "hour", float("nan"))], SCHEMA)
    assert L.level_sets(high, "share").collect() == []


def test_a_stored_tree_is_searched_in_any_range(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for module in (L, requests):
        monkeypatch.setattr(module, "CHUNK_MS", 28 * 24 * HOUR)
    name = "share_of_renewable_energies_computed"
    df = noisy(spark, 1, 1500).withColumnRenamed("share", name)
    tables.publish(df, root, "shares", ["resolution", "region"], ts="unix_timestamp_ms")
    build.publish_level_sets(spark, root)
    for lo, hi in ((0, 1500), (3, 700), (650, 690), (671, 673), (1400, 9000), (5000, 9000)):
        for cut, shortest in ((0.35, 2), (0.9, 0), (0.62, 5)):
            options = ("DE", "hour", cut, shortest * HOUR, lo * HOUR, hi * HOUR)
            got = rows(requests.search_stored_events(spark, root, *options))
            assert got == rows(requests.search_events(df, *options))
