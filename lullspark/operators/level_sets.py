"""The level-set tree of a series: every low run of every threshold, found once.

A run at or below a threshold is bounded by the nearest higher values at either side. It
exists for all thresholds from its highest value (``birth``) to below the lower of the two
bounds (``death``), and with rising thresholds runs merge, so they nest. A series of n
rows has at most n such runs. Stored, they answer any threshold and any minimum duration
by a filter, without the series.

Runs that lie inside a chunk of time are final there. Of the rest a chunk keeps a summary:
the records from its left and from its right, values that exceed all before them. Summaries
of neighbouring chunks merge into one; by the same rule a merge gives out the runs that
have both bounds within it. Chunks are merged in groups of a fixed number, level by level,
so no task sees a whole series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lullspark.operators.chunks import CHUNK, with_time_chunk
from lullspark.operators.events import CHUNK_MS, SERIES
from lullspark.session import materialise

# Chunks that one merge takes.
FAN_IN = 64
RUN = "birth double, death double, start_time long, end_time long"
RECORD = "array<struct<at:bigint,value:double,after:bigint>>"
SUMMARY = f"opens long, head {RECORD}, tail {RECORD}"
COLUMNS = ["birth", "death", "start_time", "end_time", "opens", "head", "tail"]

Record = tuple[int, float, "int | None"]


def settle(rows: Sequence[Record]) -> tuple[list[tuple], list[Record], list[Record]]:
    """Runs with both bounds among ``rows``, and the records from the left and the right.

    A row is its instant, its value and the next row's instant. Equal values with nothing
    higher between them share a run: as a right bound the first one counts, as a left
    bound the last one. The tail begins with the highest value, which the head leaves out.
    """
    runs: list[tuple] = []
    head: list[Record] = []
    tail: list[Record] = []
    for at, value, after in rows:
        while tail and tail[-1][1] < value:
            low = tail.pop()
            if tail:
                runs.append((low[1], min(tail[-1][1], value), tail[-1][2], at))
            else:
                head.append(low)
        if tail and tail[-1][1] == value:
            tail[-1] = (*tail[-1][:2], after)
        else:
            tail.append((at, value, after))
    return runs, head, tail


def settle_border(opens: int, head: Sequence[Record], tail: Sequence[Record]) -> list[tuple]:
    """The runs of a whole series that reach its first row or are open at its last."""
    runs, bounds = [], [*head, *tail[:1]]
    for low, high in zip(bounds, bounds[1:]):
        runs.append((low[1], high[1], opens, high[0]))
    for i, low in enumerate(tail):
        higher = tail[i - 1] if i else None
        runs.append((low[1], higher[1] if higher else math.inf, higher[2] if higher else opens, None))
    return runs


def _result(key: dict, runs: list[tuple], summary: tuple | None) -> pd.DataFrame:
    """Runs and, as a row of its own, the summary of a chunk or a group of chunks."""
    rows = [(*r, None, None, None) for r in runs if r[0] < math.inf]
    if summary is not None:
        opens, head, tail = summary
        named = lambda records: [{"at": a, "value": v, "after": n} for a, v, n in records]
        rows.append((None, None, None, None, opens, named(head), named(tail)))
    found = pd.DataFrame(rows, columns=COLUMNS, dtype=object)
    for name, value in key.items():
        found.insert(0, name, value)
    return found


def chunk_sets(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = SERIES,
    ts: str = "unix_timestamp_ms",
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """``*keys, _chunk, birth, death, start_time, end_time, opens, head, tail``: for each
    chunk its runs, and one row with its summary (``opens`` is the first instant).

    Null and NaN values are higher than all. A run's end is the instant of its right bound.
    A chunk's rows depend on that chunk only, so a stored table of them is kept up to date
    by replacing the chunks that changed.
    """
    keys = list(keys)
    level = F.col(value).cast("double")
    known = F.when(level.isNull() | F.isnan(level), F.lit(math.inf)).otherwise(level)
    rows = with_time_chunk(df.select(*keys, F.col(ts).alias("at"), known.alias("value")), "at", chunk_ms)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {CHUNK} long, {RUN}, {SUMMARY}"

    def summarise(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("at")
        at = chunk["at"].tolist()
        runs, head, tail = settle(list(zip(at, chunk["value"].tolist(), [*at[1:], None], strict=True)))
        key = {k: chunk[k].iloc[0] for k in reversed([*keys, CHUNK])}
        return _result(key, runs, (at[0], head, tail))[[*keys, CHUNK, *COLUMNS]]

    return rows.groupBy(*keys, CHUNK).applyInPandas(summarise, schema)


def _records(column: Iterator) -> list[Record]:
    return [(r["at"], r["value"], r["after"]) for r in column]


def _joined(parts: pd.DataFrame) -> tuple[int, list[Record]]:
    """The first instant of neighbouring summaries, and their records as rows."""
    parts = parts.sort_values(CHUNK)
    opens = [int(o) for o in parts["opens"]]
    rows: list[Record] = []
    for i, (head, tail) in enumerate(zip(parts["head"], parts["tail"], strict=True)):
        if i:
            # What follows the last row of the chunk before is this chunk's first.
            at, high, _ = rows[-1]
            rows[-1] = (at, high, opens[i])
        rows += [*_records(head), *_records(tail)]
    return opens[0], rows


def upper_sets(summaries: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """``*keys, birth, death, start_time, end_time``: the runs that no chunk holds whole.

    ``summaries`` are the summary rows of ``chunk_sets``. A merge takes ``FAN_IN`` of them;
    a summary has as many records as the chunk has rising or falling record values.
    """
    keys = list(keys)
    kinds = dict(summaries.dtypes)
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)
    base = summaries.select(*keys, CHUNK, "opens", "head", "tail")
    width = base.agg((F.max(CHUNK) - F.min(CHUNK) + 1).alias("n"), F.min(CHUNK).alias("lo")).first()
    found, parts, left = [], base.withColumn(CHUNK, F.col(CHUNK) - (width["lo"] or 0)), width["n"] or 0

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        opens, rows = _joined(group)
        runs, head, tail = settle(rows)
        key = {k: group[k].iloc[0] for k in reversed(keys)} | {CHUNK: int(group[CHUNK].iloc[0]) // FAN_IN}
        return _result(key, runs, (opens, head, tail))[[*keys, CHUNK, *COLUMNS]]

    while left > 1:
        merged = materialise(
            parts.groupBy(*keys, F.expr(f"{CHUNK} div {FAN_IN}").alias("_group")).applyInPandas(
                merge, f"{named}, {CHUNK} long, {RUN}, {SUMMARY}"
            )
        )
        found.append(merged.where("opens is null").select(*keys, *COLUMNS[:4]))
        parts, left = merged.where("opens is not null").select(*keys, CHUNK, "opens", "head", "tail"), -(-left // FAN_IN)

    def border(whole: pd.DataFrame) -> pd.DataFrame:
        row = whole.iloc[0]
        runs = settle_border(int(row["opens"]), _records(row["head"]), _records(row["tail"]))
        return _result({k: row[k] for k in reversed(keys)}, runs, None)[[*keys, *COLUMNS[:4]]]

    out = parts.groupBy(*keys).applyInPandas(border, f"{named}, {RUN}")
    for part in found:
        out = out.unionByName(part)
    return out


def level_sets(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = SERIES,
    ts: str = "unix_timestamp_ms",
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """``*keys, birth, death, start_time, end_time``: all runs of all thresholds, one row
    each; the end is null where the run is open at the last row. An instant occurs once in
    a series. The per-chunk part is checkpointed, as it is read twice."""
    chunks = materialise(chunk_sets(df, value, keys, ts, chunk_ms))
    inner = chunks.where("opens is null").select(*keys, *COLUMNS[:4])
    return inner.unionByName(upper_sets(chunks.where("opens is not null"), keys))


def events_of(
    sets: DataFrame,
    thresholds: float | Sequence[float],
    min_duration_ms: int,
    keys: Sequence[str] = SERIES,
    first: int | None = None,
    last: int | None = None,
) -> DataFrame:
    """``start_time, *keys, end_time, threshold``: the events that ``find_events`` finds in
    the series that the sets are of, or in its rows from the instant ``first``, which must
    have a row, to ``last``. A filter; it reaches the scan of stored sets."""
    cuts = [thresholds] if isinstance(thresholds, (int, float)) else sorted(set(thresholds))
    end = F.coalesce("end_time", "start_time")
    kept = sets.where((end - F.col("start_time") >= min_duration_ms) & (F.col("birth") <= max(cuts)))
    spread = kept.withColumn("threshold", F.explode(F.array(*[F.lit(float(c)) for c in cuts])))
    alive = spread.where((F.col("birth") <= F.col("threshold")) & (F.col("threshold") < F.col("death")))
    if first is not None:
        over = F.col("end_time").isNull() | (F.col("end_time") > first)
        alive = alive.where(over).withColumn("start_time", F.greatest("start_time", F.lit(first).cast("long")))
    if last is not None:
        open_there = F.when(F.col("end_time") <= last, F.col("end_time"))
        alive = alive.where(F.col("start_time") <= last).withColumn("end_time", open_there)
    return alive.where(end - F.col("start_time") >= min_duration_ms).select(
        "start_time", *keys, end.alias("end_time"), "threshold"
    )
