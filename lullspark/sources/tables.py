"""Named Parquet tables: scan, publish, replace or merge a range, tidy up.

A table is a folder of generations, which are never changed, and of versions. A version
names a folder for each partition; a publish writes all partitions as a new generation, a
replacement or merge only the ones it touches, and the other partitions keep the folders
they have. Readers take the newest version, so a failed write or check leaves the last good
one; a table has one writer at a time. A folder without versions is read as a plain
Parquet table.

With a time column a table is also cut into spans of time, and rows lie in order of time,
in files, row groups and pages: a read of one day opens the files of that day and skips
what is outside in them. Rows are range-partitioned for that, so that the rows of a hot
series are split over many files.
"""

from __future__ import annotations

import json
import posixpath
import re
import time
import uuid
from collections.abc import Callable, Collection, Sequence
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lullspark.operators.chunks import time_chunk
from lullspark.operators.upsert import KEY_CANDIDATES, assert_unique, replace_range, upsert_sparse
from lullspark.registry import KEYS, MEASURES

VERSIONS, FOLDERS = "_versions", "_folders"
GENERATION, SPAN = "_generation", "_span"
VERSION_ROW = (
    "published long, version string, schema string, parts array<string>, ts string, width long, batch string, source string"
)
# Spans of a table in ms: four weeks, as the chunks of the event search.
SPAN_MS = 28 * 86_400_000


class Version(NamedTuple):
    """One version: its schema, how it is cut, what made it, and its folders."""

    path: str
    name: str | None
    schema: StructType
    parts: list[str]
    ts: str | None
    width: int | None
    batch: str | None
    source: str | None
    folders: list[str]


def table_path(root: str, name: str) -> str:
    return posixpath.join(root, name)


def labels(folder: str) -> dict[str, str]:
    """Partition columns and their values, as they are spelt in a folder's path."""
    return dict(step.split("=", 1) for step in folder.split("/") if "=" in step)


def span_of(folder: str) -> int | None:
    span = labels(folder).get(SPAN)
    return int(span) if span is not None and span.lstrip("-").isdigit() else None


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(VERSION_ROW).parquet(posixpath.join(path, VERSIONS))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def version(spark: SparkSession, root: str, name: str, at: str | None = None) -> Version | None:
    """The newest version of a table, or the one named ``at``; None if it has none."""
    path = table_path(root, name)
    known = _versions(spark, path)
    if known is None:
        return None
    newest = known.where(F.col("version") == at if at else F.lit(True)).orderBy(F.desc("published")).first()
    if newest is None:
        return None
    held = spark.read.schema("folder string").parquet(posixpath.join(path, FOLDERS, newest["version"]))
    folders = sorted(row["folder"] for row in held.collect())
    schema = StructType.fromJson(json.loads(newest["schema"]))
    options = (newest[c] for c in ("ts", "width", "batch", "source"))
    return Version(path, newest["version"], schema, list(newest["parts"]), *options, folders)


def read_folders(spark: SparkSession, at: Version, folders: Sequence[str]) -> DataFrame:
    """The rows of some folders of a version, with its columns."""
    if not folders:
        return spark.createDataFrame([], at.schema)
    whole = StructType([*at.schema.fields]).add(GENERATION, "string")
    if at.ts:
        whole = whole.add(SPAN, "long")
    reader = spark.read.schema(whole).option("basePath", at.path)
    return reader.parquet(*[posixpath.join(at.path, f) for f in folders]).select(*[f"`{n}`" for n in at.schema.names])


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows of the newest version."""
    at = version(spark, root, name)
    return read_folders(spark, at, at.folders) if at else spark.read.parquet(table_path(root, name))


def scan_range(
    spark: SparkSession, root: str, name: str, ts: str, lo: int, hi: int, extra: dict[str, object] | None = None
) -> DataFrame:
    """Rows with ``lo <= ts <= hi`` of the given key values.

    Only folders of these spans and values are opened; in them the filters skip files, row
    groups and pages, which lie in order of time.
    """
    at = version(spark, root, name)
    inside = F.col(ts).between(lo, hi)
    for column, value in (extra or {}).items():
        inside = inside & (F.col(column) == F.lit(value))
    if at is None:
        return scan(spark, root, name).where(inside)
    return read_folders(spark, at, touched(at, ts, lo, hi + 1, extra)).where(inside)


def has_table(spark: SparkSession, root: str, name: str) -> bool:
    """Whether any version of the table can be read."""
    try:
        scan(spark, root, name)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


# What Spark writes as it is in the name of a partition's folder, and how it spells null.
PLAIN = re.compile(r"[\w .,+-]+")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def spelt(value: object) -> str | None:
    """A partition value as folders spell it; None where Spark escapes characters."""
    if value is None or value == "":
        return NO_VALUE
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return text if PLAIN.fullmatch(text) else None


def _fits(folder: str, wanted: dict[str, object]) -> bool:
    """Whether a folder may have rows with these values; other columns are not judged."""
    own = labels(folder)
    return all(c not in own or spelt(v) in (None, own[c]) for c, v in wanted.items())


def touched(at: Version, ts: str, lo: int, hi: int, extra: dict[str, object] | None = None) -> list[str]:
    """Folders that may hold rows with ``lo <= ts < hi`` of the given key values."""

    def in_time(span: int | None) -> bool:
        return at.ts != ts or (span is not None and lo // at.width <= span <= (hi - 1) // at.width)

    return [f for f in at.folders if in_time(span_of(f)) and _fits(f, extra or {})]


def _write(df: DataFrame, path: str, parts: Sequence[str], ts: str | None, width: int | None, row_group: int | None) -> list[str]:
    """Write a generation and return its folders, relative to ``path``."""
    generation = f"{GENERATION}=g-{uuid.uuid4().hex}"
    target, cut, kinds = posixpath.join(path, generation), list(parts), dict(df.dtypes)
    if ts:
        order = [*parts, SPAN, ts]
        cut.append(SPAN)
        # The writer sorts once more, by partition only, where a text column may be null or
        # empty or is a constant; the nothing that is taken from the time rules that out.
        nothing = F.coalesce(F.substring(F.col(ts).cast("string"), 1, 0), F.lit(""))
        known = {
            p: F.concat(F.coalesce(F.nullif(F.col(p), F.lit("")), F.lit(NO_VALUE)), nothing)
            for p in parts
            if kinds[p] == "string"
        }
        cells = df.withColumns({**known, SPAN: time_chunk(ts, width)})
        df = cells.repartitionByRange(*order).sortWithinPartitions(*order)
    elif parts:
        # Rebalanced rows make even files: small partitions merge, hot ones are split.
        df = df.hint("rebalance", *parts)
    writer = df.write.partitionBy(*cut) if cut else df.write
    if row_group:
        writer = writer.option("parquet.block.size", row_group)
    writer.parquet(target)
    files = df.sparkSession.read.schema(df.schema).parquet(target).inputFiles()
    folders = {unquote(posixpath.dirname(f)).partition(generation)[2].strip("/") for f in files}
    return sorted(posixpath.join(generation, f) if f else generation for f in folders)


def _switch(spark: SparkSession, at: Version) -> None:
    """Make a version the newest one."""
    name = f"v-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(f,) for f in at.folders], "folder string")
    rows.coalesce(1).write.parquet(posixpath.join(at.path, FOLDERS, name))
    row = (time.time_ns(), name, at.schema.json(), at.parts, at.ts, at.width, at.batch, at.source)
    spark.createDataFrame([row], VERSION_ROW).coalesce(1).write.mode("append").parquet(posixpath.join(at.path, VERSIONS))


def publish(
    df: DataFrame,
    root: str,
    name: str,
    partition_by: Sequence[str] = (),
    candidates: Sequence[Sequence[str]] = KEY_CANDIDATES,
    check_key: bool = True,
    ts: str | None = None,
    width: int = SPAN_MS,
    batch: str | None = None,
    source: str | None = None,
    row_group: int | None = None,
) -> list[str] | None:
    """Create or refresh a named table and report the key it is unique on.

    The new version is written beside the old one and its key is checked there; only then
    does the table switch to it. ``df`` may read the table itself. With ``ts`` the table is
    cut into spans of ``width`` and ordered by time. ``batch`` and ``source`` note what the
    version was made from; ``row_group`` is the size in bytes of a row group.
    """
    spark, path = df.sparkSession, table_path(root, name)
    folders = _write(df, path, partition_by, ts, width, row_group)
    at = Version(path, None, df.schema, list(partition_by), ts, width if ts else None, batch, source, folders)
    key = assert_unique(read_folders(spark, at, folders), candidates) if check_key else None
    _switch(spark, at)
    return key


def rewrite_parts(
    spark: SparkSession,
    root: str,
    name: str,
    which: Collection[str],
    make: Callable[[DataFrame], DataFrame],
    candidates: Sequence[Sequence[str]] = KEY_CANDIDATES,
    check_key: bool = True,
    batch: str | None = None,
    source: str | None = None,
    row_group: int | None = None,
) -> list[str] | None:
    """A new version in which ``make`` of the rows of the folders ``which`` replaces them.

    ``make`` must not return rows of other partitions than those that it was given, except
    of partitions that have no folder. All other folders stay as they are, and only spans
    that were written are checked for repeated keys.
    """
    old = version(spark, root, name)
    rows = make(read_folders(spark, old, sorted(which))).select(*[f"`{n}`" for n in old.schema.names])
    fresh = _write(rows, old.path, old.parts, old.ts, old.width, row_group)
    kept = [f for f in old.folders if f not in set(which)]
    at = old._replace(folders=sorted([*kept, *fresh]), batch=batch, source=source or old.source)
    key, spans = None, {span_of(f) for f in fresh}
    if check_key:
        key = assert_unique(read_folders(spark, at, [f for f in at.folders if span_of(f) in spans]), candidates)
    _switch(spark, at)
    return key


def folders_of_rows(df: DataFrame, at: Version) -> list[str]:
    """Folders of a version that belong to the partitions of some rows."""
    cells = df.select(*at.parts, time_chunk(at.ts, at.width).alias(SPAN)).distinct().collect()
    by_span: dict[int | None, list[dict]] = {}
    for cell in cells:
        by_span.setdefault(cell[SPAN], []).append({p: cell[p] for p in at.parts})
    return [f for f in at.folders if any(_fits(f, cell) for cell in by_span.get(span_of(f), []))]


def replace_stored_range(
    delta: DataFrame,
    root: str,
    name: str,
    ts: str,
    lo: int,
    hi: int,
    extra: dict[str, object] | None = None,
    partition_by: Sequence[str] = (),
    **options,
) -> list[str] | None:
    """Publish the table with ``[lo, hi)`` of the given key values replaced by ``delta``.

    The whole range goes, also where ``delta`` has no row. A table that is cut by ``ts`` has
    only the spans and partitions touched written anew, any other one the whole table.
    """
    spark = delta.sparkSession
    at = version(spark, root, name)
    if at is None or at.ts != ts:
        old = scan(spark, root, name)
        return publish(replace_range(old, delta.select(*old.columns), ts, lo, hi, extra), root, name, partition_by, **options)
    which = {*touched(at, ts, lo, hi, extra), *folders_of_rows(delta, at)}
    return rewrite_parts(
        spark, root, name, which, lambda old: replace_range(old, delta.select(*old.columns), ts, lo, hi, extra), **options
    )


def merge_stored(
    delta: DataFrame,
    root: str,
    name: str,
    batch: str,
    keys: Sequence[str] = KEYS,
    measures: Sequence[str] = MEASURES,
    keep_known: bool = False,
    **options,
) -> bool:
    """Merge a batch into a table cut by time: only the partitions and spans that it touches
    are read and written. A batch that has been merged before is skipped; returns whether
    it was merged now.

    Rows meet by ``keys`` and follow ``upsert_sparse``. Keys must be unique in the batch.
    """
    spark = delta.sparkSession
    at = version(spark, root, name)
    seen = _versions(spark, at.path).where(F.col("batch") == batch)
    if seen.take(1):
        return False
    rows = delta.select(*at.schema.names)
    which = folders_of_rows(rows, at)

    def merged(old: DataFrame) -> DataFrame:
        return upsert_sparse(old, rows, keys, measures, keep_known)

    rewrite_parts(spark, root, name, which, merged, batch=batch, **options)
    return True


def changed_folders(old: Version | None, new: Version) -> list[dict[str, str]]:
    """Labels of the partitions that differ between two versions of a table."""

    def own(folder: str) -> tuple:
        return tuple((k, v) for k, v in labels(folder).items() if k != GENERATION)

    before = {own(f): f for f in old.folders} if old else {}
    after = {own(f): f for f in new.folders}
    return [dict(k) for k in sorted({*before, *after}) if before.get(k) != after.get(k)]


def vacuum(spark: SparkSession, root: str, name: str, keep: int = 2) -> list[str]:
    """Remove generations that none of the newest ``keep`` versions names; returns them.

    A reader of an older version then fails, so keep as many as readers may still use.
    """
    if keep < 1:
        raise ValueError(f"keep at least one version: {keep}")
    path = table_path(root, name)
    known = [r["version"] for r in _versions(spark, path).orderBy(F.desc("published")).select("version").collect()]
    held = {labels(f)[GENERATION] for v in known[:keep] for f in version(spark, root, name, v).folders}
    older = {labels(f)[GENERATION] for v in known[keep:] for f in version(spark, root, name, v).folders}
    jvm = spark.sparkContext._jvm
    gone = sorted(older - held)
    for generation in gone:
        folder = jvm.org.apache.hadoop.fs.Path(posixpath.join(path, f"{GENERATION}={generation}"))
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return gone
