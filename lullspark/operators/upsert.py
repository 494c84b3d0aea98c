"""Wide sparse tables: widening, merging and replacing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lullspark.registry import KEYS, MEASURES, SENTINEL

BUCKET = "is_bucket_timestamp"


def union_feeds(buckets: DataFrame, points: DataFrame) -> DataFrame:
    """Bucket-start rows before point rows, as one feed."""
    return buckets.unionByName(points)


def widen(
    long: DataFrame,
    series: str = "series",
    names: Sequence[str] = MEASURES,
    value: str = "value",
    seq: str = "seq",
    keys: Sequence[str] = KEYS,
    kind: str = "decimal(11,2)",
) -> DataFrame:
    """One row per key with a column per series; the last non-null value wins.

    Conditional aggregates over a known list need one grouped pass and combine
    before the shuffle. The bucket flag is the one of the first row of the key.
    """
    measures = [
        F.max_by(F.when(F.col(series) == name, F.col(value)), F.when((F.col(series) == name) & F.col(value).isNotNull(), F.col(seq)))
        .cast(kind)
        .alias(name)
        for name in names
    ]
    flag = [F.min_by(BUCKET, seq).alias(BUCKET)] if BUCKET in long.columns else []
    return long.groupBy(*keys).agg(*flag, *measures)


def upsert_sparse(
    base: DataFrame,
    delta: DataFrame,
    keys: Sequence[str] = KEYS,
    measures: Sequence[str] = MEASURES,
    keep_known: bool = False,
) -> DataFrame:
    """Insert or update: a new non-null value wins. With ``keep_known`` it only fills nulls,
    as the sentinels of an index do, which never replace a value.

    An instant is a bucket start if either side says so, whichever came first.
    """
    keys = list(keys)
    flags = [BUCKET] if BUCKET in base.columns else []
    new = delta.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in [*flags, *measures]])
    joined = base.join(new, keys, "full")

    def merged(c: str) -> list[str]:
        return [c, f"_n_{c}"] if keep_known else [f"_n_{c}", c]

    return joined.select(
        *keys,
        *[F.greatest(c, f"_n_{c}").alias(c) for c in flags],
        *[F.coalesce(*merged(c)).alias(c) for c in measures],
    )


def bucket_starts(df: DataFrame, series: str) -> DataFrame:
    """Keys of bucket rows of a series that still hold the sentinel."""
    return df.where((F.col(series) == F.lit(SENTINEL)) & F.col(BUCKET)).select(*KEYS)


def clear_sentinel(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) != F.lit(SENTINEL), F.col(c)) for c in columns})


def outside_range(df: DataFrame, ts: str, lo: int, hi: int, extra: dict[str, object] | None = None) -> DataFrame:
    """Rows not in ``[lo, hi)`` of the given extra key values."""
    inside = (F.col(ts) >= lo) & (F.col(ts) < hi)
    for name, value in (extra or {}).items():
        inside = inside & (F.col(name) == F.lit(value))
    return df.where(~F.coalesce(inside, F.lit(False)))


def replace_range(
    target: DataFrame, delta: DataFrame, ts: str, lo: int, hi: int, extra: dict[str, object] | None = None
) -> DataFrame:
    """Clear ``[lo, hi)`` once, then add the whole batch."""
    return outside_range(target, ts, lo, hi, extra).unionByName(delta)


# Fixed values. The first candidate whose columns all exist is the key of a table.
KEY_CANDIDATES = [
    ["unix_timestamp_ms", "region", "resolution"],
    ["start_time", "end_time"],
    ["timestamp_s", "model", "temporal_resolution"],
    ["date", "resolution"],
]


def unique_key(columns: Sequence[str], candidates: Sequence[Sequence[str]] = KEY_CANDIDATES) -> list[str] | None:
    return next((list(c) for c in candidates if set(c) <= set(columns)), None)


def key_violations(df: DataFrame, candidates: Sequence[Sequence[str]] = KEY_CANDIDATES) -> DataFrame:
    """Key values occurring more than once under the first candidate that applies."""
    key = unique_key(df.columns, candidates)
    if key is None:
        raise ValueError("no candidate key matches the columns")
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assert_unique(df: DataFrame, candidates: Sequence[Sequence[str]] = KEY_CANDIDATES) -> list[str] | None:
    """The key in use; an error if it is not unique, None if no candidate applies."""
    key = unique_key(df.columns, candidates)
    if key is not None:
        twice = key_violations(df, candidates).take(1)
        if twice:
            raise ValueError(f"key {key} is not unique, e.g. {twice[0].asDict()}")
    return key
