"""Nearest neighbours and centroid clustering against brute force, and their edge cases."""

import hashlib
import math

import numpy as np
import pytest

from lullspark.llm import centroids, neighbours

CLASH = "hash string, norm string, part string, x string"
SCHEMA = f"vec_id long, embedding array<float>, label int, {CLASH}"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "h", "n", "p", "x") for i, v in rows], SCHEMA).repartition(3)


def plain_neighbours(rows, query, k):
    """Ids and scores of the k nearest, by the definition."""
    own, vector = query
    near = [
        (-math.fsum(a * b for a, b in zip(vector, v)), i)
        for i, v in rows
        if v is not None and len(v) == len(vector) and i not in (None, own) and any(v) and all(x is not None and math.isfinite(x) for x in v)
    ]
    return [(i, -s) for s, i in sorted(near)[:k]]


def random_rows(count, width, seed, scale=1.0):
    vectors = np.random.default_rng(seed).standard_normal((count, width)).astype(np.float32) * np.float32(scale)
    return [(i, v) for i, v in enumerate(vectors.tolist())]


@pytest.mark.parametrize("lengths", ["equal", "spread"])
def test_recall_of_neighbours(spark, monkeypatch, lengths):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 128)
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 64)
    monkeypatch.setattr(neighbours, "BOX_ROWS", 16)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 24))
    points = centres[rng.integers(0, 8, 1500)] + 0.25 * rng.standard_normal((1500, 24))
    points /= np.linalg.norm(points, axis=1)[:, None]
    if lengths == "spread":
        points *= np.exp(2 * rng.standard_normal(1500))[:, None]
    rows = [(i, v) for i, v in enumerate(points.astype(np.float32).tolist())]
    table = frame(spark, rows)
    got = neighbours.nearest_neighbours(table.where("vec_id % 20 = 0"), table).collect()
    hits = 0
    for query in rows[::20]:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == query[0])
        want = plain_neighbours(rows, query, 20)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        assert all(s == math.fsum(a * b for a, b in zip(query[1], rows[i][1])) for _, i, s in mine)
        hits += len({m[1] for m in mine} & {i for i, _ in want})
    assert hits / (20 * 75) >= 0.9
    # The index spares most of the work where vectors are clustered.
    assert sum({r["query_id"]: r["verified"] for r in got}.values()) < 0.7 * 75 * 1500


def test_neighbours_of_copies_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    copies = [(i, [1.0, 0.0, 0.0]) for i in range(100, 160)]
    others = [(20, [0.0, 1.0, 0.0]), (40, [0.5, 0.5, 0.0]), (60, [-1.0, 0.0, -0.0]), (7, [0.0, 0.0, -3.0])]
    bad = [(80, None), (0, [0.0, 0.0, 0.0]), (1, [nan, 1.0, 1.0]), (2, [inf, 1.0, 1.0]), (3, [None, 1.0, 1.0]), (4, [])]
    rows = [*copies, *others, *bad, (None, [1.0, 1.0, 1.0]), (180, [2.0, 1.0]), (200, [1.0, 1.0])]
    table = frame(spark, [*rows, copies[0]])
    got = {}
    for r in neighbours.nearest_neighbours(table.where("vec_id % 20 = 0"), table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {20, 40, 60, 100, 120, 140, 180, 200}
    for query in [r for r in rows if r[0] in got]:
        assert got[query[0]] == plain_neighbours(rows, query, 20)
    assert got[180] == [(200, 3.0)]


def test_no_neighbours(spark):
    nothing = frame(spark, [])
    one = frame(spark, [(20, [1.0, 2.0])])
    assert neighbours.nearest_neighbours(nothing, nothing).collect() == []
    assert neighbours.nearest_neighbours(one, nothing).collect() == []
    assert neighbours.nearest_neighbours(one, one).collect() == []


def test_chi_square():
    draws = (np.random.default_rng(1).standard_normal((200_000, 12)) ** 2).sum(1)
    for p in (0.5, 0.9, 0.95):
        assert abs((draws < neighbours.chi_square_quantile(p, 12)).mean() - p) < 0.005


def plain_clusters(rows, k, rounds):
    """The rounds in plain integers; rows are (id, integer components)."""
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [r[1] for r in sorted(rows, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centres)) for _, x in rows]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            mine = [x for (_, x), (_, c) in zip(rows, found) if c == n]
            if mine:
                centres[n] = [sum(column) // len(mine) for column in zip(*mine)]
    return assign(), centres


def test_clusters_equal_plain_rounds(spark):
    rows = [(i, [x * (1 + i % 3) for x in v]) for i, v in random_rows(300, 64, 3)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    bad = [(2000, None), (2001, [1.0] * 63), (2002, [float("nan")] * 64), (2003, [None] * 64), (2004, [float("inf")] * 64), (2005, [])]
    got = {r["vec_id"]: r for r in centroids.cluster_vectors(frame(spark, [*rows, *bad])).collect()}
    whole = [(i, [math.floor(256 * x) for x in np.array(v, np.float32).astype(float).tolist()]) for i, v in rows]
    found, centres = plain_clusters(whole, 40, 5)
    assert len(got) == len(rows)
    for (i, _), (distance, cluster) in zip(whole, found):
        row = got[i]
        assert (row["cluster"], row["distance"]) == (cluster, distance)
        assert row["cluster_inertia"] == sum(d for d, c in found if c == cluster)
        assert row["inertia"] == sum(d for d, _ in found)
        assert row["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[cluster])).encode()).hexdigest()


def test_pivots_spare_distances(spark):
    """Well separated groups: a pivot's distance tells them apart."""
    rng = np.random.default_rng(8)
    rows = [(i, (np.full(64, 20.0 * (i % 40)) + rng.standard_normal(64)).tolist()) for i in range(400)]
    got = centroids.cluster_vectors(frame(spark, rows)).collect()
    assert sum(r["n_exact"] for r in got) < 0.5 * 40 * len(rows)


def test_few_vectors_and_large_components(spark):
    assert centroids.cluster_vectors(frame(spark, [])).collect() == []
    same = frame(spark, [(1, [1.0] * 64), (1, [1.0] * 64), (None, [2.0] * 64)])
    got = centroids.cluster_vectors(same).collect()
    assert sorted((r["vec_id"] or 0, r["distance"]) for r in got) == [(0, 0), (1, 0), (1, 0)]
    assert {r["cluster"] for r in got if r["vec_id"] == 1} in ({0}, {1})
    with pytest.raises(Exception, match="component too large"):
        centroids.cluster_vectors(frame(spark, [(1, [1e9] * 64)])).collect()
