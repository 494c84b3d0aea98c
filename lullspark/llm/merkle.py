"""A Merkle manifest of a dataset as a persistent, path-copying tree.

Leaves ascend by id within a source; runs of sixteen nodes fold into one until a single
node, the source's subroot, is left. Subroots fold into the root by the same rule. A tree
is built and walked in aligned blocks of 256 nodes, two levels at a time: a block is the
most that one task holds of a source, however large that is, and the roots of blocks are
the nodes of the next, 256 times smaller, tree.

Changing a leaf never changes a node. It makes a version: copies of the leaf's ancestors,
bottom up, whose other children are the untouched nodes of the base tree. A version is
begun in the leaf's block and goes on through the siblings that the upper trees hand down
to that block, so versions are as spread out as the leaves are. All nodes of the base tree
are stored and never written again; ``read_version`` reads a version's whole tree from
them and from its copies.

Every leaf, changed or not, is folded up to a root of its own, which is then held against
the stored one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullspark.llm.common import ascii_lower, stored

FANOUT = 16
LEVELS = 2
BLOCK = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "before array<string>, after array<string>, subroot string, root string, number long"


class PersistentTree(NamedTuple):
    """``paths``: the rows of ``manifest``. ``nodes``: ``source, top, level, place, digest``
    of the base tree above its leaves; those with ``top`` join the sources' subroots."""

    paths: DataFrame
    nodes: DataFrame



def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """SHA-256 of the fields, each as byte count, colon and value; ``-`` stands for null."""
    parts = [
        F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-"))
        for f in fields
    ]
    return F.sha2(F.concat(*parts), 256)


def numbered_nodes(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``pos``, gapless from 0 within each ``g`` by ``order``, and ``depth``,
    the number of levels up to the one node that is left of the group.

    Rows are range-partitioned and sorted, not gathered by group; a table with one row for
    each group and partition says where a partition's part of a group begins.
    """
    by = ["g", *order]
    rows = stored(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()), name
    ).withColumn("_part", F.shiftright("_row", 33))
    earlier = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("g", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = parts.select(
        "g",
        "_part",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy("g")).alias("_size"),
    )
    # n nodes have as many levels as n - 1 has hexadecimal digits; one node has none.
    depth = F.when(F.col("_size") == 1, 0).otherwise(F.length(F.hex(F.col("_size") - 1)))
    return (
        rows.join(starts, ["g", "_part"])
        .withColumn("pos", F.col("_row") + F.col("_shift"))
        .withColumn("depth", depth.cast("int"))
        .drop("_row", "_part", "_shift", "_size")
    )


def _fold(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of a block level by level, the block's root last."""
    found = [digests]
    for _ in range(levels):
        below = found[-1]
        found.append([_digest("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block after the other; no more than a block and a batch are held."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    for _, block in groupby(rows(), lambda row: (row["g"], row["block"])):
        yield list(block)


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _by_block(df: DataFrame) -> DataFrame:
    return df.repartition("g", "block").sortWithinPartitions("g", "block", "pos")


def _up(nodes: DataFrame, name: str) -> DataFrame:
    """``g, pos, depth, digest, step, block_root`` of the nodes above ``nodes`` in all its
    blocks, ``step`` levels up; ``pos`` counts among the nodes of that level."""
    fields = [("g", pa.string()), ("pos", pa.int64()), ("depth", pa.int32()), ("digest", pa.string())]
    schema = pa.schema([*fields, ("step", pa.int32()), ("block_root", pa.bool_())])

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for block in _blocks(batches):
                depth, row = block[0]["depth"], {"g": block[0]["g"]}
                levels = min(depth, LEVELS)
                for step, digests in enumerate(_fold([node["digest"] for node in block], levels)):
                    first = block[0]["block"] * FANOUT ** (LEVELS - step)
                    for i, digest in enumerate(digests if step or not levels else []):
                        place = {"pos": first + i, "depth": depth - step, "digest": digest}
                        yield row | place | {"step": step, "block_root": step == levels}

        return _batched(found(), schema)

    blocks = _by_block(nodes.select("g", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "depth", "digest"))
    kinds = "g string, pos long, depth int, digest string, step int, block_root boolean"
    return stored(blocks.mapInArrow(above, kinds), name)


def _trees(nodes: DataFrame, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """``nodes``, the roots of their blocks, the roots of those blocks, and so on, up to
    one node for each group; and ``g, level, place, digest`` of all nodes above ``nodes``."""
    trees, every = [nodes], []
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for level in range(0, deepest, LEVELS):
        found = _up(trees[-1], f"{name}-{level}")
        every.append(found.where("step > 0").select("g", (F.col("step") + level).alias("level"), F.col("pos").alias("place"), "digest"))
        # A root of few levels stands for its block in the trees above, at place 0.
        trees.append(found.where("block_root").select("g", "pos", "depth", "digest"))
    return trees, every


def _down(
    nodes: DataFrame,
    above: DataFrame,
    kept: list[str],
    emit: Callable[[dict, list[str], list[str], dict], dict],
    result: str,
    fields: list[tuple[str, pa.DataType]],
) -> DataFrame:
    """``emit(node, before, after, above)`` for every node.

    ``before`` and ``after`` are the joined siblings at the left and right of the node's
    path, level by level within its block and then from ``above``, which has one row for
    each block. Both lie in one sorted partition: a block's row of ``above`` comes first.
    """
    schema = pa.schema(fields)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for top, *block in _blocks(batches):
                if not block:
                    continue
                levels = _fold([row["digest"] for row in block], min(block[0]["depth"], LEVELS))[:-1]
                sides = []
                for nodes_here in levels:
                    sides.append([])
                    for i in range(len(nodes_here)):
                        run = i - i % FANOUT
                        sides[-1].append(
                            ("".join(nodes_here[run:i]), "".join(nodes_here[i + 1 : run + FANOUT]))
                        )
                for i, node in enumerate(block):
                    path = [side[i // FANOUT**level] for level, side in enumerate(sides)]
                    yield emit(node, [p[0] for p in path] + top["before"], [p[1] for p in path] + top["after"], top)

        return _batched(found(), schema)

    below = nodes.select("g", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "depth", "digest", *kept)
    heads = above.select(
        "g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "before", "after", "subroot", "root", "number"
    )
    return _by_block(heads.unionByName(below, allowMissingColumns=True)).mapInArrow(walk, result)


def _path_rows(node: dict, before: list[str], after: list[str], top: dict) -> dict:
    known = {name: top[name] for name in ("subroot", "root", "number")}
    return {"g": node["g"], "pos": node["pos"], "before": before, "after": after} | known


PATH_FIELDS = [
    ("g", pa.string()),
    ("pos", pa.int64()),
    ("before", pa.list_(pa.string())),
    ("after", pa.list_(pa.string())),
    ("subroot", pa.string()),
    ("root", pa.string()),
    ("number", pa.int64()),
]


def _paths(trees: list[DataFrame], top: DataFrame) -> DataFrame:
    """The paths of the nodes one step above ``trees[0]``, handed down from ``top``."""
    for nodes in reversed(trees[1:-1]):
        top = _down(nodes, top, [], _path_rows, f"g string, pos long, {PATH}", PATH_FIELDS)
    return top


def _source_paths(subroots: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``g, pos (0), before, after, subroot, root, number`` for each source, and the nodes
    above the subroots; ``number`` is the source's place among the sources."""
    named = subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest")
    nodes = numbered_nodes(named, ["name"], "merkle-sources")
    trees, every = _trees(nodes, "merkle-top")
    nothing = F.array().cast("array<string>")
    sides = [nothing.alias("before"), nothing.alias("after")]
    zero = F.lit(0).cast("long")
    if len(trees) == 1:
        alone = [F.col("digest").alias("subroot"), F.col("digest").alias("root"), zero.alias("number")]
        return nodes.select(F.col("name").alias("g"), zero.alias("pos"), *sides, *alone), every
    top = trees[-1].select("g", "pos", *sides, F.lit("").alias("subroot"), F.col("digest").alias("root"), zero.alias("number"))

    def emit(node: dict, before: list[str], after: list[str], above: dict) -> dict:
        known = {"g": node["name"], "pos": 0, "subroot": node["digest"], "number": node["pos"]}
        return _path_rows(node, before, after, above) | known

    return _down(nodes, _paths(trees, top), ["name"], emit, f"g string, pos long, {PATH}", PATH_FIELDS), every


def _ancestors(leaf: str, before: list[str], after: list[str]) -> list[str]:
    """The nodes that a leaf and its siblings give, bottom up; the last one is the root."""
    found = []
    for left, right in zip(before, after, strict=True):
        leaf = _digest(left + leaf + right)
        found.append(leaf)
    return found


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """The paths of ``persistent_tree``, one row for each row of ``docs``."""
    return persistent_tree(docs, tampered).paths


def persistent_tree(docs: DataFrame, tampered: Column | None = None) -> PersistentTree:
    """The stored base tree and one path for each row of ``docs``: ``doc_id, source, pos,
    depth, leaf, subroot, root, proof_sha256, folded_root, verified, version, copied,
    number``.

    ``tampered`` is the text that a document has in its own version; null leaves the
    document as it is. By default it is the text with A-Z lower-cased where 5 divides the
    CRC-32 of the id. ``version`` holds the copied ancestors of the changed leaf, bottom
    up; its last node is the version's root, and ``copied`` the base tree's nodes that they
    copy. Both are null where no version is made. ``folded_root`` is always folded from a
    leaf, the changed or else the original one, and its original siblings. ``depth`` counts
    the levels from leaf to subroot, ``number`` is the source's place among the sources.

    Nulls are fields like any other; a null id comes before all ids of its source, a null
    source before all sources. Equal ids are ordered by leaf, so rows equal in all columns
    have equal leaves. An empty text differs from a null one. An empty table gives an
    empty result. Columns other than those of the leaf are not read. A hash is always
    taken over the whole text.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    other = F.when(crc % 5 == 0, ascii_lower(F.col("text"))) if tampered is None else tampered
    fields = [F.col(f) for f in FIELDS]
    leaves = numbered_nodes(
        docs.select(
            F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source"))).alias("g"),
            "doc_id",
            leaf_of(*fields).alias("digest"),
            F.when(other.isNotNull(), leaf_of(*fields[:-1], other)).alias("changed"),
        ),
        ["doc_id", "digest"],
        "merkle-leaves",
    )
    trees, inner = _trees(leaves, "merkle-base")
    tops, joined = _source_paths(trees[-1].select("g", "digest"))
    above = stored(_paths(trees, tops), "merkle-paths") if len(trees) > 1 else tops
    kind = dict(docs.dtypes)["doc_id"]

    def emit(node: dict, before: list[str], after: list[str], top: dict) -> dict:
        changed, root = node["changed"], top["root"]
        own = node["digest"] if changed is None else changed
        path = _ancestors(own, before, after)
        folded = path[-1] if path else own
        return {
            "doc_id": node["doc_id"],
            "g": node["g"],
            "pos": node["pos"],
            "depth": node["depth"],
            "leaf": node["digest"],
            "subroot": top["subroot"],
            "root": root,
            "proof_sha256": _digest("".join(a + b for a, b in zip(before, after, strict=True))),
            "folded_root": folded,
            "verified": folded == root,
            "version": None if changed is None else path,
            "copied": None if changed is None else _ancestors(node["digest"], before, after),
            "number": top["number"],
        }

    result = (
        f"doc_id {kind}, g string, pos long, depth int, leaf string, subroot string, root string, "
        "proof_sha256 string, folded_root string, verified boolean, version array<string>, "
        "copied array<string>, number long"
    )
    texts = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    out = [("doc_id", id_type), ("g", pa.string()), ("pos", pa.int64()), ("depth", pa.int32())]
    out += [(name, pa.string()) for name in texts]
    out += [("verified", pa.bool_()), ("version", pa.list_(pa.string())), ("copied", pa.list_(pa.string()))]
    out += [("number", pa.int64())]
    walked = _down(leaves, above, ["doc_id", "changed"], emit, result, out)
    source = F.when(F.col("g") != "", F.substr("g", F.lit(2)))
    paths = walked.select("doc_id", source.alias("source"), *[n for n, _ in out[2:]])
    none = docs.sparkSession.createDataFrame([], "source string, top boolean, level int, place long, digest string")
    nodes = none
    for found in inner:
        nodes = nodes.unionByName(found.select(source.alias("source"), F.lit(False).alias("top"), "level", "place", "digest"))
    for found in joined:
        no_source = F.lit(None).cast("string").alias("source")
        nodes = nodes.unionByName(found.select(no_source, F.lit(True).alias("top"), "level", "place", "digest"))
    return PersistentTree(paths, nodes)


def version_nodes(found: DataFrame) -> DataFrame:
    """``doc_id, source, level, place, digest, copy_of, top_level, top_place``: the nodes that
    the versions of a manifest copied, and the base tree's nodes that they are copies of.
    ``level`` counts from 1 above the leaves; up to the leaf's ``depth`` the levels belong to
    the tree of its source and ``place`` is the node's number there, beyond it they belong
    to the tree of subroots and ``place`` is null; ``top_level`` and ``top_place`` are its
    numbers in that tree. Every other node that a version reads is the base tree's."""
    both = F.arrays_zip("version", "copied")
    nodes = found.select("doc_id", "source", "pos", "depth", "number", F.posexplode(both).alias("below", "node"))
    level = F.col("below") + 1
    place = F.when(level <= F.col("depth"), F.floor(F.col("pos") / F.pow(F.lit(16), level)).cast("long"))
    top_level = F.when(level > F.col("depth"), level - F.col("depth"))
    top_place = F.floor(F.col("number") / F.pow(F.lit(16), top_level)).cast("long")
    return nodes.select(
        "doc_id",
        "source",
        level.alias("level"),
        place.alias("place"),
        F.col("node.version").alias("digest"),
        F.col("node.copied").alias("copy_of"),
        top_level.alias("top_level"),
        top_place.alias("top_place"),
    )


def read_version(tree: PersistentTree, which: Column) -> DataFrame:
    """``source, top, level, place, digest, shared`` of all nodes above the leaves in the
    version of the one document that ``which`` names: its copies where it has any, the base
    tree's own nodes, ``shared``, everywhere else. Without a version, the base tree."""
    copies = version_nodes(tree.paths.where(which)).select(
        F.when(F.col("place").isNotNull(), F.col("source")).alias("source"),
        F.col("place").isNull().alias("top"),
        F.coalesce("top_level", "level").alias("level"),
        F.coalesce("place", "top_place").alias("place"),
        F.col("digest").alias("own"),
    )
    n, c = tree.nodes.alias("n"), copies.alias("c")
    same = F.col("n.source").eqNullSafe(F.col("c.source"))
    for name in ("top", "level", "place"):
        same = same & (F.col(f"n.{name}") == F.col(f"c.{name}"))
    return n.join(c, same, "left").select(
        "n.source", "n.top", "n.level", "n.place", F.coalesce("own", "digest").alias("digest"), F.col("own").isNull().alias("shared")
    )
