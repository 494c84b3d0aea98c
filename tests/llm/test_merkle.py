"""The Merkle manifest against a tree made by the definition."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lullspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos string, block string, root string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc, text):
    fields = [doc[0], doc[3], doc[2], doc[4], text]
    return digest("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([digest("".join(found[-1][i : i + 16])) for i in range(0, len(found[-1]), 16)])
    return found


def path(tree, i):
    for nodes in tree[:-1]:
        run = i - i % 16
        yield "".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])
        i //= 16


def plain_manifest(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for doc in docs:
        groups.setdefault(doc[3], []).append(doc)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        groups[s].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
        trees[s] = levels([leaf(d, d[1]) for d in groups[s]])
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        for i, doc in enumerate(groups[s]):
            sides = [*path(trees[s], i), *path(top, n)]
            node = trees[s][0][i]
            if doc[0] is not None and zlib.crc32(str(doc[0]).encode()) % 5 == 0:
                node = leaf(doc, None if doc[1] is None else doc[1].translate(lower))
            for before, after in sides:
                node = digest(before + node + after)
            root = top[-1][0]
            proof = digest("".join(a + b for a, b in sides))
            out.append((doc[0], trees[s][0][i], trees[s][-1][0], root, proof, node, node == root))
    return out


def run(spark, docs):
    frame = spark.createDataFrame([(*d, "g", "p", "b", "r") for d in docs], SCHEMA).repartition(3)
    found = merkle.manifest(frame)
    return found, [tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def documents(counts, seed=0):
    rng = random.Random(seed)
    ids = rng.sample(range(10**6), sum(counts.values()))
    return [(ids.pop(), rng.choice(["Text", "text", "ÄB", None, ""]), "en", s, 3) for s, n in counts.items() for _ in range(n)]


@pytest.mark.parametrize(
    "counts",
    [
        {"a": 1},
        {"a": 16, None: 17, "": 2, "é": 1, "z": 256},
        {"a": 257, "b": 1, "c": 4100},
        {f"s{i}": 1 + i % 2 for i in range(300)},
    ],
    ids=["lone", "runs", "three-levels", "many-sources"],
)
def test_manifest_equals_the_definition(spark, counts):
    docs = documents(counts)
    _, got = run(spark, docs)
    assert sorted(got, key=repr) == sorted(plain_manifest(docs), key=repr)


def test_manifest_edges(spark):
    long_text = "Word " * 60_000
    docs = [
        (None, "A", None, None, None),
        (None, "A", None, None, None),
        (None, None, "en", "a", 1),
        (5, long_text, "en", "a", 1),
        (5, long_text, "en", "a", 1),
        (5, "B", "en", "a", None),
        (6, "", "en", "a", 0),
        (7, None, "en", "a", 0),
    ]
    _, got = run(spark, docs)
    assert sorted(got, key=repr) == sorted(plain_manifest(docs), key=repr)
    assert run(spark, [])[1] == []


def test_versions_share_all_but_their_path(spark):
    docs = documents({"a": 700, "b": 3}, seed=4)
    found, _ = run(spark, docs)
    rows = found.collect()
    made = [r for r in rows if r["version"] is not None]
    # Three levels of the larger source, one of the smaller, and one to join both.
    assert {(r["source"], len(r["version"])) for r in made} <= {("a", 4), ("b", 2)} and made
    assert all(r["version"][-1] == r["folded_root"] for r in made)
    nodes = merkle.version_nodes(found)
    places = nodes.where("source = 'a' and level = 1").join(found.select("doc_id", "pos"), "doc_id")
    assert places.where(F.col("place") != F.floor(F.col("pos") / 16)).count() == 0
    assert nodes.where("place is null").count() == len(made)


def test_own_tampering(spark):
    docs = [(i, "same", "en", "a", 4) for i in range(40)]
    frame = spark.createDataFrame([(*d, "g", "p", "b", "r") for d in docs], SCHEMA)
    found = merkle.manifest(frame, F.when(F.col("doc_id") == 7, F.lit("other"))).collect()
    assert [r["doc_id"] for r in found if not r["verified"]] == [7]
    untouched = merkle.manifest(frame, F.when(F.col("doc_id") == 7, F.col("text"))).collect()
    assert all(r["verified"] for r in untouched) and sum(r["version"] is not None for r in untouched) == 1


def test_every_leaf_is_folded_to_a_root(spark, monkeypatch):
    """A root that does not belong to the leaves is found by untouched leaves too."""
    docs = documents({"a": 300, "b": 20}, seed=9)
    frame = spark.createDataFrame([(*d, "g", "p", "b", "r") for d in docs], SCHEMA)
    original = merkle._source_paths

    def forged(subroots):
        found = original(subroots)
        paths, rest = found if isinstance(found, tuple) else (found, None)
        paths = paths.withColumn("root", F.lit("0" * 64))
        return (paths, rest) if isinstance(found, tuple) else paths

    monkeypatch.setattr(merkle, "_source_paths", forged)
    found = merkle.manifest(frame).select("verified", "folded_root").collect()
    assert len(found) == 320 and not any(r["verified"] for r in found)


@pytest.mark.parametrize("counts", [{"a": 700, None: 3, "b": 1}, {f"s{i}": 1 + i % 3 for i in range(40)}, {"a": 1}])
def test_a_version_is_read_from_stored_nodes(spark, counts):
    docs = documents(counts, seed=6)
    frame = spark.createDataFrame([(*d, "g", "p", "b", "r") for d in docs], SCHEMA)
    chosen = docs[0][0]
    tree = merkle.persistent_tree(frame, F.when(F.col("doc_id") == chosen, F.lit("changed")))

    def by_definition(changed):
        groups = {}
        for d in sorted(docs, key=lambda d: d[0]):
            groups.setdefault(d[3], []).append(leaf(d, "changed" if changed and d[0] == chosen else d[1]))
        order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
        trees = [(s, False, levels(groups[s])) for s in order]
        trees.append((None, True, levels([t[-1][0] for _, _, t in trees])))
        return {(s, top, k, i): x for s, top, t in trees for k, nodes in enumerate(t) if k for i, x in enumerate(nodes)}

    def read(which):
        rows = merkle.read_version(tree, which).collect()
        assert len({r[:4] for r in rows}) == len(rows)
        return {tuple(r[:4]): r["digest"] for r in rows}, sum(not r["shared"] for r in rows)

    base, copied = read(F.col("doc_id") == -1)
    assert base == by_definition(False) and copied == 0
    version, copied = read(F.col("doc_id") == chosen)
    assert version == by_definition(True)
    assert copied == sum(version[at] != base[at] for at in base)
    nodes = merkle.version_nodes(tree.paths).collect()
    assert len(nodes) == copied and {r["copy_of"] for r in nodes} <= set(base.values())
