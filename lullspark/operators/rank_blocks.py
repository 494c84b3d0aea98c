"""Spearman's sums from packed blocks of rows.

Rows are stored once, as blocks of compressed columns, and every pass reads only the
columns that it needs. Each column has cut values: all its values if they are few, else
quantiles of a sample. One pass counts the rows at and between the cuts, so the rank of a
value that is a cut, and where the ranks between two cuts begin, are known everywhere.
Only values between cuts meet others of their column, and only for one pair or two of
columns at a time; their place and nothing else depends on the sample.

Ranks are doubled and taken from their mean, ``2 * rank - (n + 1)`` among the n rows that
have both values, and so are integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lullspark.session import give_up_shuffles, materialise

BLOCK_ROWS = (1 << 16) - 1
# Rows of a column between two cuts, about, and the fewest such ranges.
BIN_ROWS = 1 << 19
LEAST_BINS = 32
# Rows that a task sorts before it sends them, and rows at cuts that it sends together.
SORTED_ROWS = 1 << 20
CUT_ROWS = 1 << 12
# Columns of many values that a pass pairs with another such column.
PAIRED = 1
# Codes of a column whose counts are added up in one place.
CODES = 1 << 10


def _integers(values: np.ndarray) -> tuple[int, np.ndarray]:
    """Floats as whole numbers or hundredths if that is exact (scale 1 or 100), else their bits."""
    with np.errstate(over="ignore", invalid="ignore"):
        for scale in (1, 100):
            scaled = np.rint(values * scale)
            if np.array_equal(scaled / scale, values) and (np.abs(scaled) < 2.0**52).all():
                return scale, scaled.astype(np.int64)
    return 0, values.view(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Floats and integers as compressed byte planes; ascending ones by their gaps."""
    heads, planes = [len(arrays)], []
    for values in arrays:
        scale, base, ascending = -1, 0, False
        if values.dtype.kind == "f":
            scale, values = _integers(values)
        if values.dtype.kind == "i" and len(values):
            ascending = bool((values[1:] >= values[:-1]).all())
            base = int(values[0] if ascending else values.min())
            moved = np.diff(values, prepend=values[:1]) if ascending else values - base
            moved = moved.view(np.uint64)
            values = moved.astype(np.min_scalar_type(moved.max()))
        width = values.dtype.itemsize
        heads += [scale, len(values), ascending, base, width]
        planes.append(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), width).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(heads, np.int64).tobytes() + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    """What ``pack`` got: floats, or integers of the least or the full width."""
    plain = zstandard.ZstdDecompressor().decompress(data)
    heads = np.frombuffer(plain, np.int64, 1 + 5 * int(np.frombuffer(plain, np.int64, 1)[0]))
    at, out = heads.nbytes, []
    for scale, n, ascending, base, width in heads[1:].reshape(-1, 5).tolist():
        raw = np.frombuffer(plain, np.uint8, n * width, at).reshape(width, n)
        values = np.ascontiguousarray(raw.T).view(f"u{width}").ravel()
        at += n * width
        if ascending:
            values = np.cumsum(values, dtype=np.int64) + base
        elif base or scale >= 0:
            values = values.astype(np.uint64).view(np.int64) + base
        if scale >= 0:
            values = values / scale if scale else values.view(np.float64)
        out.append(values)
    return out


def packed_rows(rows: DataFrame, width: int) -> DataFrame:
    """``c``: for each column of a block its distinct values and every row's place among
    them; a missing value has the place behind the last."""

    def block(values: np.ndarray) -> pa.RecordBatch:
        columns = []
        for x in values.T:
            has = ~np.isnan(x)
            distinct, at = np.unique(x[has] + 0.0, return_inverse=True)
            places = np.full(len(x), len(distinct), np.min_scalar_type(len(distinct)))
            places[has] = at
            columns.append(pack(distinct, places))
        return pa.RecordBatch.from_arrays([pa.array([columns], pa.list_(pa.binary()))], names=["c"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, width))
        for batch in batches:
            new = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            held = np.concatenate((held, new)) if len(held) else new
            while len(held) >= BLOCK_ROWS:
                yield block(held[:BLOCK_ROWS])
                held = held[BLOCK_ROWS:]
        if len(held):
            yield block(held)

    return rows.select("v").mapInArrow(fold, "c array<binary>")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Block by block, ``distinct, places`` of the columns that were selected."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [tuple(unpack(c[i].as_buffer())) for c in batch.columns]


def _columns(blocks: DataFrame, wanted: Iterable[int]) -> DataFrame:
    return blocks.select(*[F.col("c")[j].alias(f"c{j}") for j in wanted])


def place(cuts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``2 * k + 1`` at the k-th cut, ``2 * k`` between the one before and it."""
    k = np.searchsorted(cuts, x)
    return 2 * k + (np.append(cuts, np.nan)[k] == x)


class Column(NamedTuple):
    """Whether all values are cuts, whether there are two, and the cuts."""

    few: bool
    varied: bool
    cuts: np.ndarray


def survey(blocks: DataFrame, width: int, limits: Sequence[int], bin_rows: int) -> list[Column]:
    """The cuts of every column; all its values if there are ``limits`` of them at most."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(TaskContext.get().partitionId())
        count, over = [0] * width, [False] * width
        distinct, ends = [np.empty(0)] * width, [np.empty(0)] * width
        samples = [[np.empty(0)] for _ in range(width)]
        for block in _read(batches):
            for j, (values, places) in enumerate(block):
                at = places[places < len(values)]
                if not len(at):
                    continue
                count[j] += len(at)
                ends[j] = np.union1d(ends[j], values[[0, -1]])[[0, -1]]
                drawn = max(min(len(at), 16), len(at) >> 8)
                samples[j].append(values[at[((np.arange(drawn) + draw.random(drawn)) * (len(at) / drawn)).astype(np.int64)]])
                if not over[j]:
                    distinct[j] = np.union1d(distinct[j], values)
                    over[j] = len(distinct[j]) > limits[j]
        found = [pack(np.empty(0) if over[j] else distinct[j], ends[j], np.concatenate(samples[j])) for j in range(width)]
        columns = [pa.array(range(width), pa.int32()), pa.array(count, pa.int64()), pa.array(over), pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "n", "over", "found"])

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        j, found = key[0].as_py(), [unpack(f.as_buffer()) for f in table["found"]]
        distinct, ends = (np.unique(np.concatenate([f[k] for f in found])) for k in (0, 1))
        few = not any(table["over"].to_pylist()) and len(distinct) <= limits[j]
        cuts = distinct
        if not few:
            sample, bins = np.sort(np.concatenate([f[2] for f in found])), max(LEAST_BINS, sum(table["n"].to_pylist()) // bin_rows)
            cuts = np.unique(sample[np.arange(1, bins) * len(sample) // bins])
        columns = [pa.array([j], pa.int32()), pa.array([few]), pa.array([len(ends) > 1]), pa.array([pack(cuts)], pa.binary())]
        return pa.table(columns, names=["at", "few", "varied", "cuts"])

    seen = _columns(blocks, range(width)).mapInArrow(look, "at int, n long, over boolean, found binary")
    settled = seen.groupBy("at").applyInArrow(settle, "at int, few boolean, varied boolean, cuts binary").collect()
    by_place = {r["at"]: Column(r["few"], r["varied"], unpack(r["cuts"])[0]) for r in settled}
    return [by_place.get(j, Column(True, False, np.empty(0))) for j in range(width)]


def tally(blocks: DataFrame, columns: Sequence[Column]) -> list[np.ndarray]:
    """For every column the rows at each code of ``place`` that have a value in each column."""
    width, cuts = len(columns), [c.cuts for c in columns]
    sizes = [2 * len(c) + 1 for c in cuts]
    names, kinds = ["at", "first", "n"], (pa.int32(), pa.int32(), pa.binary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((size, width), np.int64) for size in sizes]
        for block in _read(batches):
            has = [places < len(values) for values, places in block]
            for i, (values, places) in enumerate(block):
                codes = np.append(place(cuts[i], values), sizes[i])[places]
                for j in range(width):
                    totals[i][:, j] += np.bincount(codes, has[j], sizes[i] + 1)[:-1].astype(np.int64)
        for i, total in enumerate(totals):
            first = range(0, sizes[i], CODES)
            parts = [i] * len(first), first, [pack(total[f : f + CODES].ravel()) for f in first]
            yield pa.RecordBatch.from_arrays([pa.array(p, kind) for p, kind in zip(parts, kinds, strict=True)], names=names)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(unpack(n.as_buffer())[0].astype(np.int64) for n in table["n"])
        parts = key[0].as_py(), key[1].as_py(), pack(total)
        return pa.table([pa.array([p], kind) for p, kind in zip(parts, kinds, strict=True)], names=names)

    schema = "at int, first int, n binary"
    counted = _columns(blocks, range(width)).mapInArrow(count, schema).groupBy("at", "first").applyInArrow(add, schema).collect()
    out = [np.zeros((size, width), np.int64) for size in sizes]
    for r in counted:
        out[r["at"]][r["first"] : r["first"] + CODES] = unpack(r["n"])[0].reshape(-1, width)
    return out


def begins(counts: np.ndarray) -> np.ndarray:
    """The doubled rank at each cut; between cuts, what those there are counted from."""
    start = 2 * (np.cumsum(counts, 0) - counts) - counts.sum(0)
    start[1::2] += counts[1::2]
    return start


def doubled_ranks(codes: np.ndarray, counts: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of ascending distinct values, of which only one range between cuts is among them, whole."""
    between = codes % 2 == 0
    inside = counts * between
    return start[codes] + (2 * (np.cumsum(inside) - inside) + inside) * between


def _squares(counts: np.ndarray, ranks: np.ndarray) -> float:
    return float(np.dot(counts, ranks.astype(np.float64) ** 2))


def few_products(blocks: DataFrame, few: Sequence[int], columns: Sequence[Column], start: Sequence[np.ndarray]) -> np.ndarray:
    """Sums of the products of the ranks of every two columns of few values."""
    cuts = [columns[i].cuts for i in few]
    # A missing value has rank 0, the mean, so that its rows add nothing.
    ranks = [np.vstack((start[i][1::2], start[i][:1] * 0)).astype(np.float64)[:, few] for i in few]
    n = len(few)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for block in _read(batches):
            of = [np.append(np.searchsorted(c, values), len(c))[places] for c, (values, places) in zip(cuts, block, strict=True)]
            for i in range(n):
                for j in range(i + 1, n):
                    total[i, j] += np.dot(ranks[i][:, j][of[i]], ranks[j][:, i][of[j]])
        x, y = np.triu_indices(n, 1)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(total[x, y], pa.float64())], names=["x", "y", "xy"])

    out = np.zeros((len(start), len(start)))
    found = _columns(blocks, few).mapInArrow(multiply, "x int, y int, xy double").groupBy("x", "y").agg(F.sum("xy").alias("xy"))
    for r in found.collect():
        out[few[r["x"]], few[r["y"]]] = r["xy"]
    return out


SUMS = "at int, to int, block binary, xy double, xx double, yy double"


def _sums(rows: Sequence[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64())
    names = [part.split()[0] for part in SUMS.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _bounds(cuts: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the rows between cuts, range by range."""
    left, right = np.searchsorted(ordered, cuts), np.searchsorted(ordered, cuts, "right")
    return np.append(0, right), np.append(left, len(ordered))


def _moved(blocks: DataFrame, i: int, few: Sequence[int], later: Sequence[int], columns: Sequence[Column]) -> DataFrame:
    """``to, block``: rows with a value of column ``i``, by the range that it falls in; for the
    columns ``few`` the number of the cut, for those ``later`` the value. Rows at cuts may go anywhere."""
    cuts, bins = columns[i].cuts, len(columns[i].cuts) + 1
    known = [columns[j].cuts for j in few]

    def send(held: list[list[np.ndarray]], turn: int) -> pa.RecordBatch:
        x, *others = (np.concatenate(parts) for parts in zip(*held, strict=True))
        order = np.argsort(x)
        first, last = _bounds(cuts, x[order])
        runs = [(k, order[f:e]) for k, (f, e) in enumerate(zip(first, last, strict=True)) if f < e]
        between = np.ones(len(x), bool)
        for f, e in zip(last[:-1], first[1:], strict=True):
            between[f:e] = False
        at_cuts = order[~between]
        for f in range(0, len(at_cuts), CUT_ROWS):
            runs.append((turn % bins, at_cuts[f : f + CUT_ROWS]))
            turn += 1
        packed = []
        for _, rows in runs:
            parts = [x[rows], *(k[rows] for k in others[: len(few)])]
            for y in others[len(few) :]:
                has = ~np.isnan(y[rows])
                parts += [np.packbits(has), y[rows][has]]
            packed.append(pack(*parts))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in runs], pa.int32()), pa.array(packed, pa.binary())], names=["to", "block"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, TaskContext.get().partitionId() * 7919
        for (values, places), *others in _read(batches):
            rows = np.flatnonzero(places < len(values))
            parts = [values[places[rows]]]
            for c, (v, p) in zip(known, others[: len(few)], strict=True):
                parts.append(np.append(np.searchsorted(c, v), len(c)).astype(np.min_scalar_type(len(c)))[p[rows]])
            parts += [np.append(v, np.nan)[p[rows]] for v, p in others[len(few) :]]
            held.append(parts)
            size += len(rows)
            if size >= SORTED_ROWS:
                yield send(held, turn)
                held, size, turn = [], 0, turn + SORTED_ROWS // CUT_ROWS
        if size:
            yield send(held, turn)

    return _columns(blocks, [i, *few, *later]).mapInArrow(move, "to int, block binary")


def many_products(
    blocks: DataFrame, i: int, few: Sequence[int], later: Sequence[int], columns: Sequence[Column], start: Sequence[np.ndarray]
) -> dict[int, tuple[float, float, float]]:
    """For each column of ``few`` and ``later`` the sums of the products of its ranks and those of
    column ``i``, and of the squares of both as far as their values are between cuts.

    Rows meet in the range of column ``i``, which gives their ranks there. Values ``later`` between
    cuts go on with that rank to their own range.
    """
    cuts, own = columns[i].cuts, start[i]
    known = {j: np.append(start[j][1::2, i], 0).astype(np.float64) for j in few}
    other_cuts, other_start = {j: columns[j].cuts for j in later}, {j: np.ascontiguousarray(start[j][:, i]) for j in later}

    def rank(key: tuple, table: pa.Table) -> pa.Table:
        parts = [[] for _ in range(1 + len(few) + 2 * len(later))]
        for data in table["block"]:
            for held, values in zip(parts, unpack(data.as_buffer()), strict=True):
                held.append(values)
        sizes = [len(x) for x in parts[0]]
        distinct, of = np.unique(np.concatenate(parts[0]), return_inverse=True)
        codes, out = place(cuts, distinct), []

        def ranks(has: np.ndarray, j: int) -> tuple[np.ndarray, float]:
            counts = np.bincount(of[has], minlength=len(distinct))
            found = doubled_ranks(codes, counts, own[:, j])
            return found.astype(np.float64), _squares(np.where(codes % 2 == 0, counts, 0), found)

        for j, held in zip(few, parts[1:], strict=False):
            k = np.concatenate(held)
            has = k < len(known[j]) - 1
            rx, xx = ranks(has, j)
            out.append((j, -1, None, float(np.dot(rx[of[has]], known[j][k[has]])), xx, 0.0))
        for p, j in enumerate(later):
            bits, values = parts[1 + len(few) + 2 * p :][:2]
            has = np.concatenate([np.unpackbits(b, count=n).astype(bool) for b, n in zip(bits, sizes, strict=True)])
            y, (rx, xx) = np.concatenate(values), ranks(has, j)
            order = np.argsort(y)
            y, r = y[order], rx[of[has]][order]
            first, last = _bounds(other_cuts[j], y)
            at_cut = np.repeat(other_start[j][1::2], first[1:] - last[:-1])
            there = np.concatenate([np.arange(f, e) for f, e in zip(last[:-1], first[1:], strict=True)] or [np.arange(0)])
            out.append((j, -1, None, float(np.dot(r[there], at_cut.astype(np.float64))), xx, 0.0))
            out += [(j, k, pack(y[f:e], r[f:e].astype(np.int64)), 0.0, 0.0, 0.0) for k, (f, e) in enumerate(zip(first, last, strict=True)) if f < e]
        return _sums(out)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        j, to = (k.as_py() for k in key)
        if to < 0:
            return table
        y, r = (np.concatenate(x) for x in zip(*(unpack(data.as_buffer()) for data in table["block"]), strict=True))
        distinct, of, counts = np.unique(y, return_inverse=True, return_counts=True)
        ry = doubled_ranks(np.full(len(distinct), 2 * to), counts, other_start[j])
        xy = float(np.dot(r.astype(np.float64), ry.astype(np.float64)[of]))
        return _sums([(j, -1, None, xy, 0.0, _squares(counts, ry))])

    met = _moved(blocks, i, few, later, columns).groupBy("to").applyInArrow(rank, SUMS)
    if later:
        met = met.groupBy("at", "to").applyInArrow(meet, SUMS)
    found = met.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy")]).collect()
    return {r["at"]: (r["xy"], r["xx"], r["yy"]) for r in found}


def rank_correlations(
    rows: DataFrame, width: int, few: Sequence[int] | None, few_values: int, bin_rows: int = BIN_ROWS
) -> pa.Table:
    """``column_x, column_y, correlation`` of ``v`` for all places x <= y; null where no row has both
    values or a column only one. The columns ``few``, or those of ``few_values`` values, have all of
    them as cuts."""
    spark = rows.sparkSession
    blocks = materialise(packed_rows(rows, width))
    limits = [few_values if few is None else BLOCK_ROWS**2 * (j in few) for j in range(width)]
    columns = survey(blocks, width, limits, bin_rows)
    counts = tally(blocks, columns)
    start = [begins(n) for n in counts]
    squares = np.array([[_squares(n[1::2, j], s[1::2, j]) for j in range(width)] for n, s in zip(counts, start, strict=True)])
    looked_up, many = ([j for j in range(width) if columns[j].few is kind] for kind in (True, False))
    products = few_products(blocks, looked_up, columns, start) if len(looked_up) > 1 else np.zeros((width, width))
    for k, i in enumerate(many):
        later = many[k + 1 :]
        for first in range(0, max(1, len(later)), PAIRED):
            with_few, others = looked_up if first == 0 else [], later[first : first + PAIRED]
            if not with_few and not others:
                continue
            for j, (xy, xx, yy) in many_products(blocks, i, with_few, others, columns, start).items():
                products[min(i, j), max(i, j)] += xy
                squares[i, j] += xx
                squares[j, i] += yy
            give_up_shuffles(spark)
    out = [(j, j, 1.0 if c.varied else None) for j, c in enumerate(columns)]
    for i in range(width):
        for j in range(i + 1, width):
            scale = float(np.sqrt(squares[i, j]) * np.sqrt(squares[j, i]))
            out.append((i, j, float(products[i, j]) / scale if scale else None))
    kinds = {"column_x": pa.int32(), "column_y": pa.int32(), "correlation": pa.float64()}
    return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=[*kinds])
