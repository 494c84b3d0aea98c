"""Refresh of derived tables: only what changed, and what it reaches, is computed again.

Every version of a table names a folder for each span of time and notes the versions of the
tables that it was made from. Folders that differ between those and the newest versions are
the dirty spans. Widened by the reach of an operator they say which spans of its result are
made anew, and, widened the other way, which spans of its input that takes. All other
folders stay as they are. The result equals a full build.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lullspark.operators import enrich, level_sets, series, weather
from lullspark.operators.chunks import time_chunk
from lullspark.operators.upsert import KEY_CANDIDATES, clear_sentinel
from lullspark.plans.build import (
    DAY_MS,
    EVENT_KEY,
    SERIES_PARTS,
    WEATHER_KEY,
    publish_upper_sets,
    stored_chunks,
)
from lullspark.plans.requests import SHARE, stored_sets
from lullspark.registry import MEASURES, STEP_MS, THRESHOLDS
from lullspark.session import materialise
from lullspark.sources import tables
from lullspark.sources.tables import SPAN, SPAN_MS, Version

TS = "unix_timestamp_ms"
Reach = Callable[[dict[str, str]], int]
Cell = tuple[tuple[str, ...], int]


def _source(versions: dict[str, Version]) -> str:
    return json.dumps({name: at.name for name, at in sorted(versions.items())})


def _made_from(spark: SparkSession, root: str, made: Version | None, name: str) -> Version | None:
    """The version of the table ``name`` that a version was made from, if it is known."""
    noted = json.loads(made.source).get(name) if made and made.source else None
    return tables.version(spark, root, name, noted) if noted else None


def dirty_cells(old: Version | None, new: Version, parts: Sequence[str]) -> set[Cell]:
    """Values of ``parts`` and spans of the folders that differ."""
    changed = tables.changed_folders(old, new)
    return {(tuple(c[p] for p in parts if p in c), int(c[SPAN])) for c in changed if c[SPAN].lstrip("-").isdigit()}


def widened(cells: set[Cell], parts: Sequence[str], width: int, back: Reach, ahead: Reach) -> set[Cell]:
    """The spans that rows of the cells reach, ``back`` and ``ahead`` in units of time."""
    out = set()
    for values, span in cells:
        known = dict(zip(parts, values))
        lo, hi = span * width - back(known), (span + 1) * width - 1 + ahead(known)
        out |= {(values, s) for s in range(lo // width, hi // width + 1)}
    return out


def _in_cells(at: Version, parts: Sequence[str], cells: set[Cell]) -> list[str]:
    return [
        f
        for f in at.folders
        if (tuple(tables.labels(f)[p] for p in parts if p in tables.labels(f)), tables.span_of(f)) in cells
    ]


def _of_cells(df: DataFrame, parts: Sequence[str], ts: str, width: int, cells: set[Cell]) -> DataFrame:
    """Rows of the cells; these are few, as many as folders that changed."""
    names = [f"_{p}" for p in parts]
    schema = ", ".join([*(f"{n} string" for n in names), f"{SPAN} long"])
    wanted = F.broadcast(df.sparkSession.createDataFrame([(*v, s) for v, s in cells], schema))
    here = df.withColumns({**{f"_{p}": F.col(p).cast("string") for p in parts}, SPAN: time_chunk(ts, width)})
    return here.join(wanted, [*names, SPAN], "left_semi").drop(*names, SPAN)


def refresh_table(
    spark: SparkSession,
    root: str,
    name: str,
    source: str,
    compute: Callable[[DataFrame], DataFrame],
    parts: Sequence[str],
    ts: str,
    shared: Sequence[str] = (),
    width: int = SPAN_MS,
    back: Reach = lambda _: 0,
    ahead: Reach = lambda _: 0,
    candidates: Sequence[Sequence[str]] = KEY_CANDIDATES,
    check_key: bool = True,
) -> set[Cell] | None:
    """Bring a table made of one other table up to date; the cells written, None for all.

    ``shared`` are partition columns of both tables that ``compute`` keeps. A row of the
    source reaches results up to ``back`` before and ``ahead`` after it.
    """
    new, made = tables.version(spark, root, source), tables.version(spark, root, name)
    old = _made_from(spark, root, made, source)
    noted = _source({source: new})
    if old is None:
        rows = compute(tables.read_folders(spark, new, new.folders))
        tables.publish(rows, root, name, parts, candidates, check_key, ts, width, source=noted)
        return None
    dirty = dirty_cells(old, new, shared)
    if not dirty:
        return set()
    out = widened(dirty, shared, width, back, ahead)
    inputs = _in_cells(new, shared, widened(out, shared, width, ahead, back))

    def make(_: DataFrame) -> DataFrame:
        return _of_cells(compute(tables.read_folders(spark, new, inputs)), shared, ts, width, out)

    which = _in_cells(made, shared, out)
    tables.rewrite_parts(spark, root, name, which, make, candidates, check_key, source=noted)
    return out


def _ranges(cells: set[Cell], width: int) -> list[tuple[int, int]]:
    """Spans as ranges of time, neighbours joined."""
    joined: list[list[int]] = []
    for span in sorted({s for _, s in cells}):
        if joined and joined[-1][1] == span * width:
            joined[-1][1] = (span + 1) * width
        else:
            joined.append([span * width, (span + 1) * width])
    return [(lo, hi) for lo, hi in joined]


def _meets(lo: Column, hi: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    known = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ranges])
    return F.exists(known, lambda r: (lo < r["hi"]) & (hi >= r["lo"]))


def refresh_events(
    spark: SparkSession,
    root: str,
    market: str = "market",
    thresholds: Sequence[float] = THRESHOLDS,
    region: str = "DE",
    resolution: str = "quarterhour",
    after_ms: int = enrich.PRICES_SINCE_MS,
    min_duration_ms: int = DAY_MS,
    margin_ms: int = enrich.WEEK_MS,
) -> set[Cell] | None:
    """The enriched events from the stored level sets; the cells written, None for all.

    Events come from the level sets by a filter. Statistics are taken again of events
    whose range, margins included, meets a dirty span, and of their neighbours in the same
    folder; an event that is gone met one too, as its range ends at its bound.
    """
    names = {n: tables.version(spark, root, n) for n in (market, "shares", "weather")}
    made, noted = tables.version(spark, root, "events"), _source(names)
    sets, first = stored_sets(spark, root, region, resolution, after_ms + 1, None)
    found = level_sets.events_of(sets, list(thresholds), min_duration_ms, first=first)
    events = materialise(found.withColumn("threshold_percent", F.round(F.col("threshold") * 100).cast("int")))

    def enriched(chosen: DataFrame) -> DataFrame:
        lo, hi = chosen.agg(F.min("start_time"), F.max("end_time")).first()
        lo, hi = (lo or 0) - margin_ms - DAY_MS, (hi or 0) + margin_ms + DAY_MS
        own = {"region": region, "resolution": resolution}
        rows = tables.scan_range(spark, root, market, TS, lo, hi, own)
        rows = clear_sentinel(rows, [c for c in MEASURES if c in rows.columns])
        near = tables.scan_range(spark, root, "weather", "date_ms", lo, hi)
        percent = F.round(F.col("threshold") * 100).cast("int")
        return enrich.enrich_events(chosen.drop("threshold_percent"), rows, near, margin_ms).withColumn("threshold_percent", percent)

    olds = {n: _made_from(spark, root, made, n) for n in names}
    if None in olds.values():
        options = {"check_key": True, "ts": "start_time", "source": noted}
        tables.publish(enriched(events), root, "events", ["threshold_percent"], EVENT_KEY, **options)
        return None
    dirty = set().union(*[{((), s) for _, s in dirty_cells(olds[n], at, [])} for n, at in names.items()])
    if not dirty:
        return set()
    ranges = _ranges(dirty, SPAN_MS)
    before = tables.read_folders(spark, made, made.folders).select("threshold_percent", "start_time", "end_time")
    both = before.unionByName(events.select("threshold_percent", "start_time", "end_time"))
    hit = both.where(_meets(F.col("start_time") - margin_ms, F.col("end_time") + margin_ms, ranges))
    rows = hit.select(F.col("threshold_percent").cast("string").alias("p"), time_chunk("start_time", SPAN_MS).alias("s"))
    cells = {((r["p"],), r["s"]) for r in rows.distinct().collect()}
    parts = ["threshold_percent"]

    def make(_: DataFrame) -> DataFrame:
        return enriched(_of_cells(events, parts, "start_time", SPAN_MS, cells))

    which = _in_cells(made, parts, cells)
    tables.rewrite_parts(spark, root, "events", which, make, EVENT_KEY, source=noted)
    return cells


def refresh_tables(
    spark: SparkSession,
    root: str,
    market: str = "market",
    weather_points: str = "weather_points",
    forecast_points: str = "forecast_points",
    **event_options,
) -> dict[str, set[Cell] | None]:
    """Bring every derived table up to date; what was written of each, None for all of it.

    The base tables must be cut by time, as the ingest publishes them.
    """
    step = lambda cell: STEP_MS.get(cell["resolution"], 0)

    def cleared(rows: DataFrame) -> DataFrame:
        return clear_sentinel(rows, [c for c in MEASURES if c in rows.columns])

    of_series = {"parts": SERIES_PARTS, "ts": TS, "shared": SERIES_PARTS}
    done = {
        "shares": refresh_table(spark, root, "shares", market, lambda m: series.share_series(cleared(m)), **of_series),
        "price_changes": refresh_table(
            spark, root, "price_changes", market, lambda m: series.price_change(cleared(m)), ahead=step, **of_series
        ),
        "forecasts": refresh_table(
            spark, root, "forecasts", forecast_points, weather.aggregate_forecast, ["model"], "timestamp_s", width=SPAN_MS // 1000
        ),
        # The day of an hour begins up to a day earlier.
        "weather": refresh_table(
            spark, root, "weather", weather_points, weather.weather_history, ["resolution"], "date_ms",
            back=lambda _: DAY_MS, candidates=WEATHER_KEY,
        ),
        "level_sets": refresh_table(
            spark, root, "level_sets", "shares", lambda s: stored_chunks(s, SHARE),
            SERIES_PARTS, "chunk_start", SERIES_PARTS, check_key=False,
        ),
    }
    if done["level_sets"] != set():
        publish_upper_sets(spark, root)
    done["events"] = refresh_events(spark, root, market, **event_options)
    return done
