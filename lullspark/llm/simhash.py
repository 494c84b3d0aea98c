"""Near duplicates by SimHash, searched by meeting in the middle.

Two fingerprints at most three bits apart have a common variant: one of them clears two
of its ones, or fewer bits, and the other flips one bit. (Of three differing bits, one
side has ones in at least two.) So every fingerprint emits itself, its 64 single flips
and the pairs of its ones, a quarter of all variants within two bits. Equal variants
meet. In such a meeting one fingerprint that is at most one flip away is within three
bits of all others; links to it keep the group connected without listing its pairs.
Links are deduplicated and their distance is verified.

Variants are not shuffled: a group is a few parities of bits, and a flip changes at most
one of them, so many variants of a fingerprint are in one group. The fingerprint goes once
to each group that has some, and its variants are made there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lullspark.llm.common import as_rows, row_text, stored
from lullspark.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
SHINGLES_AT_ONCE = 1 << 16
FINGERPRINTS_AT_ONCE = 2000
# A group of the shuffle has four million variants, a task makes a million of them at once.
VARIANTS_PER_GROUP = 1 << 22
VARIANTS_AT_ONCE = 1 << 20
# Small tables have 64 groups, for parallel work.
GROUP_BITS = 6
GROUPS_PER_TASK = 8
CELL_BITS = 12
FLIP_MASK = np.uint64(0xFFF)
ITSELF = 1 << 6

U = np.uint64
PARITIES = 0xFFFF << 48

# What a variant flips: nothing, a bit, or two bits that must be ones.
BIT = U(1) << np.arange(64, dtype=U)
FIRST, SECOND = np.triu_indices(64, 1)
TWO = BIT[FIRST] | BIT[SECOND]
MASKS = np.concatenate([np.zeros(1, U), BIT, TWO])
ONES = np.concatenate([np.zeros(65, U), TWO])
FLIPS = np.concatenate([np.full(1, ITSELF), np.arange(64) * 65, FIRST << 6 | SECOND]).astype(U)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased words' shingles, repeats counted; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    spans = list(zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(spans), SHINGLES_AT_ONCE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans[i : i + SHINGLES_AT_ONCE]], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fingerprint`` (a signed long) for every row."""

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), U, batch.num_rows)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fingerprint"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64(row_text()).alias("text_hash"), row_text().alias("text"))
    return rows.mapInArrow(hash_texts, f"doc_id {kind}, text_hash long, fingerprint long")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that is its own inverse: the leading 16 bits become the parities of every
    sixteenth bit. It is linear, so what a flip changes is the same for all fingerprints."""
    folded = x ^ (x << U(32))
    return ((folded ^ (folded << U(16))) & U(PARITIES)) | (x & ~U(PARITIES))


def _unmix(x: np.ndarray) -> np.ndarray:
    return _mix(x)


def leading(x: np.ndarray, bits: int) -> np.ndarray:
    """The leading ``bits`` of the mixed values."""
    return _mix(x) >> U(64 - bits) if bits else np.zeros_like(x)


def variants(values: np.ndarray, bits: int = 0, cell: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The variants of some fingerprints in a cell, the leading ``bits`` of the mixed variant,
    and, in twelve bits, what each has flipped; without a cell all of them."""
    changes, away = leading(MASKS, bits), leading(values, bits) ^ U(cell)
    parts = [(values[:0], FLIPS[:0])]
    for change in np.unique(changes):
        at = changes == change
        masks, ones, flips = MASKS[at], ONES[at], FLIPS[at]
        near = values[away == change]
        for i in range(0, len(near), FINGERPRINTS_AT_ONCE):
            some = near[i : i + FINGERPRINTS_AT_ONCE]
            row, flip = np.nonzero((some[:, None] & ones) == ones)
            parts.append((some[row] ^ masks[flip], flips[flip]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def cells(values: np.ndarray, bits: int, group: int = 0, group_bits: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Variants by cell, the leading ``bits`` of the mixed variant; each entry packs the
    other bits of the mixed variant (52 at most matter) with the flips. With ``group``
    only the cells that begin with its ``group_bits``."""
    flat, flips = variants(values, group_bits, group)
    mixed = _mix(flat)
    cell = (mixed >> U(64 - bits)).astype(np.int64)
    entries = (mixed << U(CELL_BITS)) | flips
    order = np.argsort(cell, kind="stable")
    cell, entries = cell[order], entries[order]
    starts, ends = np.flatnonzero(np.diff(cell, prepend=-1)), np.flatnonzero(np.diff(cell, append=-1)) + 1
    for a, b in zip(starts, ends, strict=True):
        yield int(cell[a]), entries[a:b]


def cell_links(top: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between fingerprints that meet in a cell (``top``: its leading 12 bits)."""
    entries = np.sort(entries)
    low, flips = entries >> U(CELL_BITS), (entries & FLIP_MASK).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    sizes = np.diff(np.r_[starts, len(low)])
    near = (flips >> 6) >= (flips & 63)
    hub = np.minimum.reduceat(np.where(near, np.arange(len(low)), len(low)), starts)
    met = np.repeat((sizes > 1) & (hub < len(low)), sizes)
    left, right = np.repeat(hub, sizes)[met], np.flatnonzero(met)
    different = left != right

    def original(at: np.ndarray) -> np.ndarray:
        variant = _unmix((U(top) << U(64 - CELL_BITS)) | low[at])
        i, j = (flips[at] >> 6).astype(U), (flips[at] & 63).astype(U)
        mask = np.where(i == j, U(1) << i, (U(1) << i) | (U(1) << j))
        return variant ^ np.where(i > j, U(0), mask)

    a, b = original(left[different]), original(right[different])
    close = (np.bitwise_count(a ^ b) <= RADIUS) & (a != b)
    return a[close], b[close]


def group_links(values: np.ndarray, group: int, bits: int, at_once: int = VARIANTS_AT_ONCE) -> Iterator[np.ndarray]:
    """Verified links, in rows of two, between fingerprints whose variants meet in a group,
    the leading ``bits``. A group of many variants, as near copies give, is split by one more
    bit until a part has few."""
    changes, times = np.unique(leading(MASKS, bits), return_counts=True)
    away = leading(values, bits) ^ U(group)
    change = np.minimum(np.searchsorted(changes, away), len(changes) - 1)
    held = changes[change] == away
    values = values[held]
    # Of the pairs of bits a quarter are ones.
    if times[change[held]].sum() > 4 * at_once:
        yield from group_links(values, 2 * group, bits + 1, at_once)
        yield from group_links(values, 2 * group + 1, bits + 1, at_once)
        return
    cell_bits = max(CELL_BITS, bits)
    links = [np.zeros((0, 2), U)]
    for cell, entries in cells(values, cell_bits, group, bits):
        a, b = cell_links(cell >> (cell_bits - CELL_BITS), entries)
        links.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
    yield np.unique(np.concatenate(links), axis=0)


def dealt(distinct: DataFrame, bits: int) -> DataFrame:
    """``grp, fingerprint``: a row for each group, of ``bits``, that may have variants of it."""
    x = F.col("fingerprint")
    folded = x.bitwiseXOR(F.shiftleft(x, 32))
    parities = folded.bitwiseXOR(F.shiftleft(folded, 16)).bitwiseAND(PARITIES - (1 << 64))
    mixed = parities.bitwiseOR(x.bitwiseAND(~PARITIES & (1 << 64) - 1))
    changes = np.unique(leading(MASKS, bits)).astype(np.int64).tolist()
    own = distinct.select(F.shiftrightunsigned(mixed, 64 - bits).alias("own"), "fingerprint")
    rows = own.select("own", F.explode(F.array(*map(F.lit, changes))).alias("change"), "fingerprint")
    return rows.select(F.col("own").bitwiseXOR(F.col("change")).cast("long").alias("grp"), "fingerprint")


def near_links(distinct: DataFrame, count: int) -> DataFrame:
    """``a, b``: links that connect all of ``count`` distinct fingerprints within three bits."""
    spark = distinct.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(GROUP_BITS, math.ceil(math.log2(max(1, count * 600 / VARIANTS_PER_GROUP))))

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.concatenate([b.column("fingerprint").to_numpy() for b in batches]).view(U)
        for links in group_links(values, key[0].as_py(), bits):
            found = links.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    rows = dealt(distinct.repartition(tasks, "fingerprint"), bits)
    # A group has few bytes and much to do: it is not for the adaptive plan to join their tasks.
    groups = rows.repartition(max(tasks, (1 << bits) // GROUPS_PER_TASK), "grp")
    return groups.groupBy("grp").applyInArrow(meet, "a long, b long").distinct()


def _near_duplicates(docs: DataFrame, shingle: int, similar: DataFrame | None = None) -> DataFrame:
    """``doc_id, text_hash, fingerprint, root, component_id``; all but the id are never null.

    ``similar (a, b)`` are further links, between text hashes.
    """
    rows = stored(fingerprints(docs, shingle), "simhash")
    distinct = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    links = near_links(distinct.select("fingerprint"), distinct.count())
    if similar is not None:
        of_text = rows.select("text_hash", "fingerprint").distinct()
        a = of_text.select(F.col("text_hash").alias("a"), F.col("fingerprint").alias("fa"))
        b = of_text.select(F.col("text_hash").alias("b"), F.col("fingerprint").alias("fb"))
        further = similar.join(a, "a").join(b, "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
        links = links.unionByName(further)
    roots = components(links)
    placed = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = placed.join(least, "root").select("fingerprint", "root", "component_id")
    return rows.join(found, "fingerprint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Rows link when their fingerprints differ in three bits or fewer; the component is the
    smallest ``doc_id`` reachable (null if no row of it has one). Texts with fewer words
    than a shingle are one shingle; null and empty texts have fingerprint zero, which
    links like any other. Equal texts have equal fingerprints and are one row of the
    search. An empty table gives an empty result. Other columns are not read.
    """
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return _near_duplicates(docs, shingle).select("doc_id", shown.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similar: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of the
    smallest id stays (of texts with that id, the one with the smallest hash).

    ``similar (a, b)`` links further texts by their hashes (``xxhash64``).
    A row equal to another in id and text stays once; only where there are such rows
    among those to keep are the texts shuffled for it.
    """
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    texts = _near_duplicates(docs, shingle, similar).where(first).groupBy("root", "doc_id", "text_hash")
    kept = stored(
        texts.agg(F.count(F.lit(1)).alias("n"))
        .groupBy("root", "doc_id")
        .agg(F.min_by(F.struct("text_hash", "n"), "text_hash").alias("text"))
        .select("doc_id", "text.text_hash", "text.n"),
        "simhash-kept",
    )
    own = as_rows(docs).withColumns({"id": F.col("row.doc_id"), "hash": F.xxhash64(row_text("row.text"))})
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    rows = own.join(kept, same, "left_semi")
    if kept.where("n > 1").limit(1).count():
        rows = rows.dropDuplicates(["id", "hash"])
    return rows.select("row.*")
