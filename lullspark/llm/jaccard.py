"""Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The search is exact. Shingles are put in one order, the same for all texts, in which those
that many texts hold come last, the most frequent at the end. Of two similar texts, each has
a common shingle among the first fifth (and one) of its own, so only these are shuffled, and
of them only those that occur twice are kept. All that come before the first common shingle
of two texts are in one of them only: its place in each set bounds the overlap, and with it
the sizes that the other set may have. A text that has no other of such a size in a meeting
leaves it; those that fit are candidates, and the whole sets decide. Links matter only for
the groups that they connect: first every text is held against the hub of each meeting, then,
in meetings that still have several groups, texts of different groups against each other; so
a large group of copies is never paired with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullspark.llm.common import give_up_shuffles, row_text, stored
from lullspark.llm.components import components

WORDS = 5
# The order of shingles decides only how many candidates there are. A task counts its texts'
# shingles four million at a time; the most frequent of what it saw twice come last. Of a
# million at a time, it saw too few twice of those that some texts in ten thousand hold.
COUNTED_AT_ONCE = 1 << 22
COMMON = 1 << 17
# Texts of which a task holds shingles at once.
TEXTS_AT_ONCE = 1000
# Meetings are by 48 bits of a shingle: fewer bytes move, and the sets decide anyway.
MEET_BITS = 48
# Bits of a filter that tasks get: 2 MB. A full one lets all through, to an exact join.
FILTER_BITS = 1 << 24
HUBS = 4
U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
MIX = U(0xFF51AFD7ED558CCD)


def shingle_set(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the lower-cased words' distinct shingles; empty without words.

    A text with fewer words than a shingle is one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words))
    width = min(WORDS, len(words))
    last = len(words) - width + 1
    mixed = np.full(last, U(width))
    for i in range(width):
        mixed = (mixed ^ (mixed >> U(33))) * ODD + hashes[i : i + last]
    mixed = (mixed ^ (mixed >> U(33))) * MIX
    return np.unique(mixed ^ (mixed >> U(33)))


def _common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most texts hold, sorted, and the rank of each by its number of texts,
    the rarest first; all texts are counted, ``COMMON`` bounds what the driver gets."""

    def repeated(parts: list[np.ndarray]) -> pa.RecordBatch:
        held = np.concatenate(parts)
        held.sort()
        values, counts = np.unique(held[1:][held[1:] == held[:-1]], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts + 1)], names=["shingle", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros(0, U)], 0
        for batch in batches:
            for t in batch.column(0):
                held.append(shingle_set(t.as_py()))
                size += len(held[-1])
                if size >= COUNTED_AT_ONCE:
                    yield repeated(held)
                    held, size = [np.zeros(0, U)], 0
        yield repeated(held)

    found = docs.select(row_text().alias("text")).mapInArrow(count, "shingle long, n long")
    most = found.groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(COMMON)
    found = most.toArrow()
    values, counts = found["shingle"].to_numpy().view(U), found["n"].to_numpy()
    ranks = np.zeros(len(values), np.int32)
    ranks[np.lexsort((values, counts))] = np.arange(len(values))
    order = np.argsort(values)
    return values[order], ranks[order]


def in_order(found: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A sorted set in the order of all texts: the common shingles last, by rank."""
    values, ranks = common
    if not len(values):
        return found
    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
    late = values[at] == found
    return np.concatenate([found[~late], found[late][np.argsort(ranks[at[late]])]])


def bitmap(found: np.ndarray) -> bytes:
    """A set as a bitmap of at least twice as many bits, a power of two."""
    bits = 1 << max(3, (2 * len(found) - 1).bit_length()) if len(found) else 8
    held = np.zeros(bits, np.uint8)
    held[(found & U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(held, bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def may_be_similar(bits_a: bytes, size_a: int, bits_b: bytes, size_b: int) -> bool:
    """False only for sets that have a similarity below 0.8.

    A common element sets a bit in both. So no more are common than bits are, and elements
    of the one set that share a bit with another of their own.
    """
    a, b = np.frombuffer(bits_a, np.uint8), np.frombuffer(bits_b, np.uint8)
    size = min(len(a), len(b))
    a, b = _folded(a, size), _folded(b, size)
    both = int(np.bitwise_count(a & b).sum())
    most = both + min(size_a - int(np.bitwise_count(a).sum()), size_b - int(np.bitwise_count(b).sum()))
    return 9 * most >= 4 * (size_a + size_b)


def _filter_of(values: DataFrame) -> np.ndarray:
    """A bit for each hash of the one column; the driver gets at most ``FILTER_BITS`` bits."""
    at = F.pmod(F.xxhash64(values.columns[0]), F.lit(FILTER_BITS))
    words = values.select(F.floor(at / 64).alias("word"), F.pmod(at, F.lit(64)).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
    table, held = found.toArrow(), np.zeros(FILTER_BITS // 64, np.int64)
    held[table["word"].to_numpy()] = table["bits"].to_numpy()
    return held


def _hits(batch: pa.RecordBatch, held: np.ndarray) -> pa.RecordBatch:
    """The rows whose place ``_filter`` has its bit set, without that column."""
    at = batch.column("_filter").to_numpy()
    hit = (held[at >> 6] >> (at & 63)) & 1
    return batch.filter(pa.array(hit.astype(bool))).drop_columns(["_filter"])


def _passing(rows: DataFrame, name: str, held: np.ndarray) -> DataFrame:
    """Rows whose column ``name`` may be among the values of a filter."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _hits(batch, held)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn("_filter", F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))).mapInArrow(keep, fields)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(first, TEXTS_AT_ONCE)


NAMES = ("doc_id", "text_hash", "set_key", "size", "prefix", "bits")


def _signatures(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id, text_hash, set_key, size, prefix, bits`` for every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keys, sizes, prefixes, bitmaps = [], [], [], []
            for t in batch.column("text"):
                found = shingle_set(t.as_py())
                n = len(found)
                keep = n - (4 * n + 4) // 5 + 1 if n else 0
                first = in_order(found, common)[:keep]
                keys.append(xxhash.xxh128_digest(found.tobytes()))
                sizes.append(n)
                bitmaps.append(bitmap(found))
                prefixes.append((first >> U(64 - MEET_BITS)).view(np.int64))
            columns = [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array(keys, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(prefixes, pa.list_(pa.int64())),
                pa.array(bitmaps, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*NAMES])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64(row_text()).alias("text_hash"), row_text().alias("text"))
    return rows.mapInArrow(sign, f"doc_id {kind}, text_hash long, set_key binary, size long, prefix array<long>, bits binary")


def _read_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``id, shingles`` for each row of ``docs`` that ``wanted (id, doc_id, text_hash)`` names.

    A task has one Python worker, which drops the other rows and gives no text back."""
    key = F.xxhash64("doc_id", "text_hash")
    held = _filter_of(wanted.select(key.alias("key")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(_hits(b, held) for b in batches):
            shingles = pa.array([shingle_set(t.as_py()).view(np.int64) for t in batch.column("text")], pa.list_(pa.int64()))
            columns = [batch.column("doc_id"), batch.column("text_hash"), shingles]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "shingles"])

    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.xxhash64(row_text()).alias("text_hash"), row_text().alias("text"))
    placed = texts.withColumn("_filter", F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)))
    d = placed.mapInArrow(whole, f"doc_id {kind}, text_hash long, shingles array<long>").alias("d")
    w = wanted.alias("w")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash"))
    return d.join(w, same).select("w.id", "d.shingles")


def _whole_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``id, shingles`` of the sets ``wanted (id, doc_id, text_hash)``, one row of each; by
    id and hash a text is read once, and copies of it meet nowhere."""
    full = stored(_read_sets(wanted, docs), "jaccard-sets")
    # Only equal rows can give a set twice.
    return full if full.count() == wanted.count() else stored(full.dropDuplicates(["id"]), "jaccard-sets")


def _fit(x: str, y: str) -> Column:
    """Whether the rows ``x`` and ``y`` of a meeting, whose shingle is taken as their first
    common one, may be similar: each size is at least 4/5 of the other and at most ``most``."""
    small = 5 * F.least(f"{x}.size", f"{y}.size") >= 4 * F.greatest(f"{x}.size", f"{y}.size")
    return small & (F.col(f"{x}.size") <= F.col(f"{y}.most")) & (F.col(f"{y}.size") <= F.col(f"{x}.most"))


def _candidates(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Distinct ``a < b`` of ``pairs (x, y)`` whose bitmaps allow a similarity of 0.8."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("bits_a", "size_a", "bits_b", "size_b")]
            may = pa.array([may_be_similar(*row) for row in zip(*columns, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(may)

    ordered = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
    a, b = [named.select(*[F.col(c).alias(n) for c, n in (("id", n), ("size", f"size_{n}"), ("bits", f"bits_{n}"))]) for n in ("a", "b")]
    return stored(ordered.join(a, "a").join(b, "b").mapInArrow(judge, "a long, b long"), "jaccard-candidates")


def _verified(pairs: DataFrame, named: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs (a, b)`` whose whole sets are similar."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    full = _whole_sets(stored(wanted.join(named.select("id", "doc_id", "text_hash"), "id"), "jaccard-wanted"), docs)
    a = full.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = full.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    similar = pairs.join(a, "a").join(b, "b").where(9 * common >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")
    return stored(similar, "jaccard-similar")


def _distinct_sets(rows: DataFrame) -> DataFrame:
    """``id, set_key, doc_id, text_hash, size, prefix, bits``: one row for each set, with a
    number, which is read from the table that has it."""
    sets = rows.groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("row"), *[F.first(n).alias(n) for n in ("size", "prefix", "bits")]
    )
    columns = ("set_key", "row.doc_id", "row.text_hash", "size", "prefix", "bits")
    return stored(sets.select(F.monotonically_increasing_id().alias("id"), *columns), "jaccard-names")


def _meetings(named: DataFrame) -> DataFrame:
    """``shingle, id, size, most, hub``: the shingles that several sets have among their
    first, with the sets that may have a similar one there.

    ``most`` is the largest size that a set may have whose first common shingle with this
    one it is: of the n here, those from place p on are at most common, n - p of them. Past a
    ninth of a set ``most`` is below its own size, so of two similar sets the smaller one has
    the shingle in its first ninth; a set that has not needs another that has, of a size that
    fits. The hub is the set that is in most meetings: copies with few edits are in more than
    those with many, whose own shingles come first, and are similar to more. Of equals a
    random one is, different in meetings of the same texts, so most groups are whole then.
    """
    most = F.floor((5 * F.col("size") - 9 * F.col("place")) / 4).alias("most")
    postings = named.select("id", "size", F.posexplode("prefix").alias("place", "shingle")).select("shingle", "id", "size", most)
    early = F.col("most") >= F.col("size")
    counted = postings.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(early, F.col("size"))).alias("lo"), F.max(F.when(early, F.col("size"))).alias("hi")
    )
    shared = stored(counted.where("n > 1 and lo is not null").drop("n"), "jaccard-shared")
    met = _passing(postings, "shingle", _filter_of(shared.select("shingle"))).join(shared, "shingle")
    other = (F.col("lo") <= F.col("most")) & (5 * F.col("hi") >= 4 * F.col("size"))
    fit = stored(met.where(early | other).select(postings.columns), "jaccard-fit")
    places = fit.groupBy("id").agg(F.count(F.lit(1)).alias("places"))
    chance = F.xxhash64("id", F.pmod("shingle", F.lit(HUBS)))
    hubs = fit.join(places, "id").groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"), F.max_by(F.struct("id", "size", "most"), F.struct("places", chance)).alias("hub")
    )
    return stored(fit.join(hubs.where("n > 1").drop("n"), "shingle"), "jaccard-meetings")


def _mixed(meetings: DataFrame, roots: DataFrame) -> DataFrame:
    """``shingle, id, size, most, root, home`` of the meetings whose sets are in several
    groups; ``home`` is the hub's. Sets of it stay if another's size may fit."""
    rooted = meetings.join(roots, F.col("id") == F.col("node"), "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "id"))
    home = rooted.where(F.col("id") == F.col("hub.id")).select("shingle", F.col("root").alias("home"))
    placed = stored(rooted.drop("hub", "node").join(home, "shingle"), "jaccard-placed")
    away = placed.where("root <> home").groupBy("shingle")
    others = away.agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.max("most").alias("top"))
    fits = (F.col("size") <= F.col("top")) & (F.col("lo") <= F.col("most")) & (5 * F.col("hi") >= 4 * F.col("size"))
    several = placed.join(others, "shingle").where((F.col("root") != F.col("home")) | fits)
    return stored(several.select(placed.columns), "jaccard-mixed")


def _crossed(mixed: DataFrame) -> DataFrame:
    """``x, y``: the sets of different groups that fit in a meeting, one of them not of the hub's group."""
    g, h = mixed.where("root <> home").alias("g"), mixed.alias("h")
    once = (F.col("h.root") == F.col("h.home")) | (F.col("g.root") < F.col("h.root"))
    between = (F.col("g.shingle") == F.col("h.shingle")) & once & _fit("g", "h")
    return g.join(h, between).select(F.col("g.id").alias("x"), F.col("h.id").alias("y"))


def similar_texts(docs: DataFrame) -> DataFrame:
    """``a, b``: links of ``text_hash`` that connect all similar texts of ``docs``.

    A null text is empty; texts without words are similar to each other only. Rows with a
    null or repeated id are texts like any other; equal rows are one. An empty table gives
    no link. Texts are named by 64-bit hashes: of n distinct texts two share one with
    probability n^2 / 2^65, and would then be taken for one. Every step is written, and the
    files of its shuffles are given up before the next one.
    """
    spark = docs.sparkSession
    rows = stored(_signatures(docs, _common_shingles(docs)), "jaccard")
    named = _distinct_sets(rows)
    give_up_shuffles(spark)
    meetings = _meetings(named)
    give_up_shuffles(spark)
    hubs = meetings.alias("m").where(_fit("m", "m.hub")).select(F.col("id").alias("x"), F.col("hub.id").alias("y"))
    first = _verified(_candidates(hubs, named), named, docs)
    give_up_shuffles(spark)
    mixed = _mixed(meetings, components(first))
    second = _verified(_candidates(_crossed(mixed), named), named, docs)

    left = named.select(F.col("id").alias("a"), F.col("text_hash").alias("ta"))
    right = named.select(F.col("id").alias("b"), F.col("text_hash").alias("tb"))
    similar = first.unionByName(second).join(left, "a").join(right, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
    equal = (
        rows.select("set_key", F.col("text_hash").alias("b"))
        .distinct()
        .join(named.select("set_key", F.col("text_hash").alias("a")), "set_key")
        .where("a <> b")
        .select("a", "b")
    )
    links = stored(similar.unionByName(equal), "jaccard-links")
    give_up_shuffles(spark)
    return links
