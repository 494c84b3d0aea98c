"""Approximate nearest neighbours by inner product over a tiny projected index.

Vectors are scaled into unit balls and lifted onto the sphere, where the largest inner
product is the smallest distance. A few random Gaussian (2-stable) projections keep
distances in the mean: the squared projected distance of two vectors over the squared
true one follows a chi-square law. The index is a kd-tree over the projections. A query
takes its projected neighbours in ascending order of their boxes and verifies them with
original vectors; it stops when the chi-square law says that a vector as near as the
worst neighbour found would have shown up by now with probability ``certainty`` (Sun et
al., 2014). That holds for each true neighbour by itself, so it bounds the mean recall.

The upper part of the tree is fitted on a bounded sample and cuts all vectors into cells,
the lower part is built in tasks over bounded chunks of a cell. A query visits its nearest
cell first, then a few, then all that the test leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullspark.llm.common import stored

# An even number of projections: then the chi-square law has a closed form.
PROJECTIONS = 12
CERTAINTY = 0.95
# Rows that fit the upper tree, rows aimed at in a cell, most cells for each kind of
# vector, rows of a chunk that a task holds at once, rows of a box of the lower tree.
SAMPLE_ROWS = 16384
CELL_ROWS = 4096
MOST_CELLS = 4096
CHUNK_ROWS = 16384
BOX_ROWS = 256
# Queries that a task runs together.
BATCH = 256


def chi_square(x: np.ndarray, freedom: int) -> np.ndarray:
    """The distribution function for an even number of degrees of freedom."""
    half = np.asarray(x, np.float64) / 2
    term = np.ones_like(half)
    total = np.ones_like(half)
    for i in range(1, freedom // 2):
        term = term * half / i
        total += term
    return 1 - np.exp(-half) * total


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0 * freedom
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid), freedom) < p else (low, mid)
    return high


def projections(dimensions: int, count: int, seed: int = 0) -> np.ndarray:
    """``dimensions + 1`` by ``count`` standard normal values, the same in every task."""
    return np.random.default_rng([seed, dimensions, count]).standard_normal((dimensions + 1, count))


def usable(vector: Column) -> Column:
    """Not null, no component null or non-finite, not all zero."""
    finite = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def usable_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector, hash`` of the rows that take part; the hash speeds up grouping."""
    rows = vectors.select("vec_id", F.col("embedding").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    return rows.withColumn("hash", F.xxhash64("vector"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``hash, vector, ids``: one row for each distinct vector with its ``k + 1`` smallest
    ids; no query can need more copies of one vector. Spark limits the rows of a copied
    vector before the shuffle."""
    copies = Window.partitionBy("hash", "vector").orderBy("vec_id")
    few = rows.withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= k + 1)
    return few.groupBy("hash", "vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def norm_of(vector: Column) -> Column:
    """The Euclidean norm; dividing by the largest component keeps squares in range."""
    most = F.array_max(F.transform(vector, F.abs)).cast("double")
    return most * F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + (v / most) * (v / most)))


class Tree(NamedTuple):
    """A complete binary tree over projected points: node ``i`` has children ``2i + 1`` and
    ``2i + 2`` and sends points with ``point[axis[i]] > cut[i]`` to the latter."""

    axis: np.ndarray
    cut: np.ndarray
    depth: int

    def cells(self, points: np.ndarray) -> np.ndarray:
        """The number of each point's cell, from 0."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] > self.cut[node]
            node = 2 * node + 1 + right
        return node - len(self.axis)


def fit_tree(points: np.ndarray, depth: int) -> Tree:
    """Splits the widest axis at its median, level by level."""
    axis, cut = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    member = np.zeros(len(points), np.int64)
    for node in range(2**depth - 1):
        mine = np.flatnonzero(member == node)
        if len(mine) > 1:
            here = points[mine]
            axis[node] = (here.max(0) - here.min(0)).argmax()
            cut[node] = np.median(here[:, axis[node]])
        member[mine] = 2 * node + 1 + (points[mine, axis[node]] > cut[node])
    return Tree(axis, cut, depth)


def boxes_of(points: np.ndarray, size: int) -> list[np.ndarray]:
    """The points' numbers in boxes of at most ``size``: the leaves of a kd-tree."""
    open_boxes, boxes = [np.arange(len(points))], []
    while open_boxes:
        box = open_boxes.pop()
        if len(box) <= size:
            boxes.append(box)
            continue
        spread = points[box].max(0) - points[box].min(0)
        half = len(box) // 2
        order = np.argpartition(points[box, spread.argmax()], half)
        open_boxes += [box[order[half:]], box[order[:half]]]
    return boxes


def box_gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every box."""
    gaps = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        column = points[:, axis, None]
        gaps += np.maximum(np.maximum(low[None, :, axis] - column, column - high[None, :, axis]), 0) ** 2
    return gaps


class Chunk:
    """Vectors of one cell with the lower part of the tree, searched in place.

    ``longest`` is the norm that lifting took as the radius of the ball.
    """

    def __init__(self, vectors: np.ndarray, projected: np.ndarray, longest: float):
        self.vectors, self.projected, self.longest = vectors, projected, longest
        self.boxes = boxes_of(projected, BOX_ROWS)
        self.low = np.array([projected[b].min(0) for b in self.boxes])
        self.high = np.array([projected[b].max(0) for b in self.boxes])

    def search(
        self, queries: np.ndarray, lifted: np.ndarray, worst: np.ndarray, keep: int, reach: float
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores and row numbers (-1: none) of the ``keep`` best of each query, and how
        many vectors it verified.

        ``queries`` are unit vectors, ``lifted`` their projections, ``worst`` the scores of
        unit queries that are to be beaten, -inf for none.
        """
        n = len(queries)
        best, found = np.full((n, keep), -np.inf), np.full((n, keep), -1, np.int64)
        verified = np.zeros(n, np.int64)
        gaps = box_gaps(lifted, self.low, self.high)
        order = gaps.argsort(1)
        active = np.arange(n)
        for wave in range(len(self.boxes)):
            limit = stop_gap(np.maximum(worst, best[:, -1]), self.longest, reach)
            box = order[active, wave]
            going = gaps[active, box] < limit[active]
            active, box = active[going], box[going]
            for b in np.unique(box):
                rows, mine = self.boxes[b], active[box == b]
                apart = lifted[mine, None, :] - self.projected[None, rows, :]
                near = np.einsum("qrm,qrm->qr", apart, apart) < limit[mine, None]
                rows, mine = rows[near.any(0)], mine[near.any(1)]
                if not len(rows):
                    continue
                verified[mine] += len(rows)
                scores = queries[mine] @ self.vectors[rows].T
                better = scores.max(1) > best[mine, -1]
                mine, scores = mine[better], np.hstack([best[mine[better]], scores[better]])
                numbers = np.hstack([found[mine], np.broadcast_to(rows, (len(mine), len(rows)))])
                pick = np.argsort(-scores, 1, kind="stable")[:, :keep]
                best[mine] = np.take_along_axis(scores, pick, 1)
                found[mine] = np.take_along_axis(numbers, pick, 1)
        return best, found, verified


def stop_gap(worst: np.ndarray, longest: float, reach: float) -> np.ndarray:
    """Squared projected distance from which on no vector can belong to the neighbours with
    the asked certainty: beyond the chi-square quantile of the worst neighbour's distance."""
    return reach * np.maximum(0, 2 - 2 * worst / longest)


class Kind(NamedTuple):
    """What tasks know of the vectors of one dimension: projections, the upper tree, norms
    of bands, and of each cell its band, box, rows and numbers of its parts."""

    normal: np.ndarray
    tree: Tree
    longest: dict[int, float]
    cells: list[tuple[int, range]]
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def project(self, vectors: np.ndarray, norms: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """Projections of vectors scaled by ``longest`` and lifted onto the unit sphere."""
        up = np.sqrt(np.maximum(0, 1 - (norms / longest) ** 2))
        return (vectors / longest[:, None]) @ self.normal[:-1] + up[:, None] * self.normal[-1]

    def parts(self, units: np.ndarray, worst: np.ndarray, reach: float, first: float, last: float) -> list[list[int]]:
        """For each unit query the parts of some of its cells, as far as the stopping test
        leaves any: the cells that, the most promising first, have ``first`` to ``last``
        rows before them."""
        lifted = units @ self.normal[:-1]
        gaps = box_gaps(lifted, self.low, self.high)
        radius = np.array([self.longest[band] for band, _ in self.cells])
        hope = radius * (1 - gaps / (2 * self.normal.shape[1]))
        order = np.argsort(-hope, 1, kind="stable")
        before = self.rows[order].cumsum(1) - self.rows[order]
        going = gaps < reach * np.maximum(0, 2 - 2 * worst[:, None] / radius)
        now = np.take_along_axis(going, order, 1) & (before >= first) & (before < last)
        return [[p for c in order[q, now[q]] for p in self.cells[c][1]] for q in range(len(units))]


def _vectors(column: pa.ListArray, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(-1, width)


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


class Index(NamedTuple):
    """``placed`` holds every distinct vector by part; ``kinds`` is what fits a driver."""

    placed: DataFrame
    kinds: dict[int, Kind]


def build_index(rows: DataFrame, k: int, count: int = PROJECTIONS) -> Index:
    """Index all ``rows`` of ``usable_rows``.

    The upper tree of each dimension is fitted on at most ``SAMPLE_ROWS`` vectors, those
    with the smallest hash; cells, boxes and counts are of all vectors.
    """
    named = distinct_vectors(rows, k).withColumns({"dim": F.size("vector"), "norm": norm_of(F.col("vector"))})
    # A band is the rounded binary logarithm of the norm: long vectors do not blur short ones.
    flat = stored(named.withColumn("band", F.round(F.log2("norm")).cast("int")), "ann-vectors")
    kinds: dict[int, Kind] = {}
    totals: dict[int, int] = {}
    for row in flat.groupBy("dim", "band").agg(F.max("norm").alias("most"), F.count(F.lit(1)).alias("n")).collect():
        known = kinds.setdefault(row["dim"], Kind(projections(row["dim"], count), None, {}, [], None, None, None))
        known.longest[row["band"]] = row["most"]
        totals[row["dim"]] = totals.get(row["dim"], 0) + row["n"]
    some = flat.withColumn("_nth", F.row_number().over(Window.partitionBy("dim").orderBy("hash")))
    samples: dict[int, list] = {dim: [] for dim in kinds}
    for row in some.where(F.col("_nth") <= SAMPLE_ROWS).select("dim", "band", "norm", "vector").toLocalIterator():
        samples[row["dim"]].append((row["vector"], row["norm"], kinds[row["dim"]].longest[row["band"]]))
    for dim, sample in samples.items():
        points = kinds[dim].project(*(np.array(x, np.float64) for x in zip(*sample, strict=True)))
        depth = math.ceil(math.log2(max(1, min(MOST_CELLS, totals[dim] / CELL_ROWS))))
        kinds[dim] = kinds[dim]._replace(tree=fit_tree(points, depth))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, same in _by_dimension(batch):
                kind, norms = kinds[dim], same.column("norm").to_numpy()
                longest = np.array([kind.longest[b] for b in same.column("band").to_pylist()])
                points = kind.project(_vectors(same.column("vector"), dim), norms, longest)
                cells = pa.array(kind.tree.cells(points), pa.int32())
                flat_points = pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), count)
                columns = [*same.columns, cells, flat_points.cast(pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [*same.schema.names, "cell", "projected"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema)
    placed = stored(flat.mapInArrow(place, f"{fields}, cell int, projected array<double>"), "ann-index")
    edges = [f(F.col("projected")[i]).alias(f"{n}{i}") for i in range(count) for n, f in (("low", F.min), ("high", F.max))]
    boxes = placed.groupBy("dim", "band", "cell").agg(F.count(F.lit(1)).alias("n"), *edges)
    lows: dict[int, list] = {dim: [] for dim in kinds}
    highs: dict[int, list] = {dim: [] for dim in kinds}
    sizes = {dim: [] for dim in kinds}
    starts, following = [], 0
    for row in boxes.orderBy("dim", "band", "cell").collect():
        chunks = math.ceil(row["n"] / CHUNK_ROWS)
        kinds[row["dim"]].cells.append((row["band"], range(following, following + chunks)))
        lows[row["dim"]].append([row[f"low{i}"] for i in range(count)])
        highs[row["dim"]].append([row[f"high{i}"] for i in range(count)])
        sizes[row["dim"]].append(row["n"])
        starts.append((row["dim"], row["band"], row["cell"], following, chunks))
        following += chunks
    for dim in kinds:
        kinds[dim] = kinds[dim]._replace(
            low=np.array(lows[dim]), high=np.array(highs[dim]), rows=np.array(sizes[dim], np.int64)
        )
    # One row for each cell, at most MOST_CELLS for each dimension and band.
    numbers = F.broadcast(rows.sparkSession.createDataFrame(starts, "dim int, band int, cell int, start int, chunks int"))
    part = F.col("start") + F.pmod(F.col("hash"), F.col("chunks")).cast("int")
    return Index(placed.join(numbers, ["dim", "band", "cell"]).withColumn("part", part), kinds)


ENTRY = "struct<neg: double, first: bigint, ids: array<bigint>>"


def _visits(state: DataFrame, kinds: dict[int, Kind], reach: float, first: float, last: float) -> DataFrame:
    """``part`` and the query's columns, one row for each part that a query visits now."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, same in _by_dimension(batch):
                if dim not in kinds:
                    continue
                norms = same.column("norm").to_numpy()
                units = _vectors(same.column("vector"), dim) / norms[:, None]
                worst = same.column("worst").to_numpy() / norms
                parts = pa.array(kinds[dim].parts(units, worst, reach, first, last), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*same.columns, parts], [*same.schema.names, "parts"])

    columns = state.select("query", "vector", "dim", "norm", "worst")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema)
    chosen = columns.mapInArrow(choose, f"{fields}, parts array<int>")
    return chosen.select(F.explode("parts").alias("part"), "query", "vector", "dim", "norm", "worst")


# Visits of a part that one task serves.
VISITS = 65536


def _verify(index: Index, visits: DataFrame, keep: int, reach: float) -> DataFrame:
    """``query, verified, best``: what each query found in each part.

    A part's vectors and the queries that visit it come to a task in one sorted partition,
    vectors first. Queries pass in batches; a part with many visits is served by several
    tasks, each with the part's vectors.
    """
    kinds = index.kinds
    splits = visits.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("splits"))
    split = F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split")
    data = index.placed.join(splits, "part").select(
        "part", split, F.lit(0).alias("role"), "vector", "dim", "norm", "band", "ids", "projected"
    )
    asking = visits.join(splits, "part").select(
        "part",
        F.pmod(F.hash("query"), F.col("splits")).alias("split"),
        F.lit(1).alias("role"),
        "vector",
        "dim",
        "norm",
        "query",
        "worst",
    )
    rows = data.unionByName(asking, allowMissingColumns=True).repartition("part", "split")
    schema = pa.schema(
        [
            ("query", pa.int64()),
            ("verified", pa.int64()),
            ("best", pa.list_(pa.struct([("neg", pa.float64()), ("first", pa.int64()), ("ids", pa.list_(pa.int64()))]))),
        ]
    )

    def answer(chunk: Chunk, ids: pa.ListArray, kind: Kind, asked: pa.Table, dim: int) -> pa.RecordBatch:
        norms, worst = asked.column("norm").to_numpy(), asked.column("worst").to_numpy()
        vectors = _vectors(asked.column("vector").combine_chunks(), dim)
        units = vectors / norms[:, None]
        lifted = units @ kind.normal[:-1]
        scores, found, verified = chunk.search(units, lifted, worst / norms, keep, reach)
        out = []
        for q, query in enumerate(asked.column("query").to_pylist()):
            best = []
            for r in found[q][(found[q] >= 0) & (scores[q] * norms[q] >= worst[q] - 1e-9 * abs(worst[q]))]:
                named = ids[int(r)].as_py()
                best.append({"neg": -math.fsum((vectors[q] * chunk.vectors[r]).tolist()), "first": named[0], "ids": named})
            out.append({"query": query, "verified": int(verified[q]), "best": best})
        return pa.RecordBatch.from_pylist(out, schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, chunk, ids, kind, dim = None, [], None, None, None, 0
        for batch in batches:
            place = np.stack([batch.column(n).to_numpy() for n in ("part", "split", "role")], 1)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(place)], strict=True):
                here, rows = tuple(place[start][:2]), batch.slice(start, end - start)
                if here != at:
                    at, held, chunk = here, [], None
                if place[start][2] == 0:
                    held.append(rows)
                    continue
                if chunk is None:
                    own = pa.Table.from_batches(held).combine_chunks()
                    dim, band = own.column("dim")[0].as_py(), own.column("band")[0].as_py()
                    kind, ids = kinds[dim], own.column("ids").combine_chunks()
                    points = _vectors(own.column("projected").combine_chunks(), kind.normal.shape[1])
                    chunk = Chunk(_vectors(own.column("vector").combine_chunks(), dim), points, kind.longest[band])
                    held = []
                for first in range(0, rows.num_rows, BATCH):
                    yield answer(chunk, ids, kind, pa.Table.from_batches([rows.slice(first, BATCH)]), dim)

    return rows.sortWithinPartitions("part", "split", "role").mapInArrow(
        search, f"query long, verified long, best array<{ENTRY}>"
    )


def nearest_neighbours(
    queries: DataFrame, vectors: DataFrame, k: int = 20, certainty: float = CERTAINTY, count: int = PROJECTIONS
) -> DataFrame:
    """``query_id, rank, vec_id, score, verified``: for each row of ``queries`` the ``k``
    nearest rows found in ``vectors`` by inner product, ties to the smaller id; rows with
    the query's own id are left out. ``verified`` is the number of vectors whose inner
    product the query took.

    Both tables have ``vec_id, embedding``; other columns are not read. Scores are the
    correctly rounded sums of the products of the original components. Vectors null, zero
    or holding null or non-finite components, and rows without id, take no part. Vectors
    of different dimension never meet. Rows equal in id and vector count once. With fewer
    rows than ``k`` a query gets all of them, with none it has no row.
    """
    keep, reach = k + 1, chi_square_quantile(certainty, count)
    index = build_index(usable_rows(vectors), k, count)
    asking = usable_rows(queries).distinct()
    state = asking.select("hash", "vector").distinct().withColumns(
        {
            "query": F.monotonically_increasing_id(),
            "dim": F.size("vector"),
            "norm": norm_of(F.col("vector")),
            "best": F.array().cast(f"array<{ENTRY}>"),
            "worst": F.lit(float("-inf")),
            "verified": F.lit(0).cast("long"),
        }
    )
    state = stored(state, "ann-queries")
    # The nearest cell, or as many as hold half a cell's rows; a few more; all the others.
    edges = [0, CELL_ROWS // 2, 4 * CELL_ROWS, math.inf]
    for first, last in zip(edges, edges[1:]):
        visits = stored(_visits(state, index.kinds, reach, first, last), "ann-visits")
        found = _verify(index, visits, keep, reach).groupBy("query").agg(
            F.flatten(F.collect_list("best")).alias("more"), F.sum("verified").alias("also")
        )
        best = F.slice(F.array_sort(F.concat("best", F.coalesce("more", F.array().cast(f"array<{ENTRY}>")))), 1, keep)
        joined = state.join(found, "query", "left").select(
            "hash",
            "vector",
            "query",
            "dim",
            "norm",
            best.alias("best"),
            (F.col("verified") + F.coalesce("also", F.lit(0))).alias("verified"),
        )
        worst = F.when(F.size("best") == keep, -F.element_at("best", keep)["neg"]).otherwise(F.lit(float("-inf")))
        state = stored(joined.withColumn("worst", worst), "ann-state")
    flat = F.flatten(F.transform("best", lambda b: F.transform(b["ids"], lambda i: F.struct(b["neg"].alias("neg"), i.alias("id")))))
    answers = asking.join(state.select("hash", "vector", F.array_sort(flat).alias("near"), "verified"), ["hash", "vector"])
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("vec_id")), 1, k)
    return answers.select(F.col("vec_id").alias("query_id"), "verified", F.posexplode(others).alias("place", "near")).select(
        "query_id",
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("near")["id"].alias("vec_id"),
        (-F.col("near")["neg"]).alias("score"),
        "verified",
    )
