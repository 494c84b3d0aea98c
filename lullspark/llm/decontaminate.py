"""Benchmark decontamination with a distributed positional inverted index.

The index is split by documents: each block of texts is one row with its terms and,
for each term, the sorted positions in the block. Posting lists so never leave their
block, and a term that every document has is no hot key. A search first sums up how
often each test term occurs in all blocks, then intersects, per block, the position
lists of a phrase from its rarest term on, shifted by the terms' places in the phrase.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lullspark.llm.common import as_rows, row_text, stored

WINDOW = 13
BLOCK_BYTES = 4 << 20
# Test texts are searched in batches of about this size, one after another.
BATCH_BYTES = 4 << 20
BLANK = ord(" ")
# Fixed rule for words: A-Z lower-cased; digits, letters and all beyond ASCII are kept.
WORD_BYTES = bytes(
    ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else BLANK for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def index_block(ids: list, hashes: list[int], texts: list[list[bytes]]) -> dict:
    """One row of the index: documents, where they begin, terms, counts and positions."""
    words = [w for t in texts for w in t]
    terms = sorted(set(words))
    number = {t: i for i, t in enumerate(terms)}
    numbers = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
    return {
        "doc_ids": ids,
        "text_hashes": hashes,
        "starts": np.cumsum([0, *map(len, texts)]).astype(np.int32).tobytes(),
        "terms": b" ".join(terms),
        "counts": np.bincount(numbers, minlength=len(terms)).astype(np.int32).tobytes(),
        "positions": np.argsort(numbers, kind="stable").astype(np.int32).tobytes(),
    }


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The stored index of all whole texts of ``docs (doc_id, text)``.

    A block holds whole documents up to ``block_bytes``; a longer one is a block alone.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = (
        f"doc_ids array<{kind}>, text_hashes array<long>, starts binary, terms binary, "
        "counts binary, positions binary"
    )

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, texts, size = [], [], [], 0
        arrow = None
        for batch in batches:
            arrow = arrow or pa.schema([
                ("doc_ids", pa.list_(batch.schema.field("doc_id").type)), ("text_hashes", pa.list_(pa.int64())),
                *[(c, pa.binary()) for c in ("starts", "terms", "counts", "positions")],
            ])
            for i, h, t in zip(*(batch.column(c) for c in ("doc_id", "text_hash", "text")), strict=True):
                text = t.as_py()
                if texts and size + len(text) > block_bytes:
                    yield pa.RecordBatch.from_pylist([index_block(ids, hashes, texts)], schema=arrow)
                    ids, hashes, texts, size = [], [], [], 0
                ids.append(i.as_py())
                hashes.append(h.as_py())
                texts.append(words_of(text))
                size += len(text)
        if texts:
            yield pa.RecordBatch.from_pylist([index_block(ids, hashes, texts)], schema=arrow)

    rows = docs.select("doc_id", F.xxhash64(row_text()).alias("text_hash"), row_text().alias("text"))
    return stored(rows.mapInArrow(blocks, schema), "positional-index")


class Postings:
    """Position lists of one block."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes) -> None:
        self.terms = {t: i for i, t in enumerate(terms.split())}
        self.ends = np.cumsum(np.frombuffer(counts, np.int32))
        self.positions = np.frombuffer(positions, np.int32)

    def of(self, term: bytes) -> np.ndarray:
        i = self.terms.get(term)
        return self.positions[:0] if i is None else self.positions[self.ends[i - 1] if i else 0 : self.ends[i]]

    def phrase(self, places: Sequence[tuple[bytes, int]]) -> np.ndarray:
        """Where a phrase begins, from its terms and their offsets, the rarest term first."""
        term, offset = places[0]
        begins = self.of(term) - offset
        begins = begins[begins >= 0]
        for term, offset in places[1:]:
            if not len(begins):
                break
            listed = self.of(term)
            at = np.searchsorted(listed, begins + offset)
            found = at < len(listed)
            found[found] = listed[at[found]] == begins[found] + offset
            begins = begins[found]
        return begins

    def together(self, terms: Sequence[bytes], within: int) -> np.ndarray:
        """Starts of stretches of ``within`` words that begin with one of the terms and have
        all of them in any order, the rarest term first."""
        lists = [self.of(t) for t in terms]
        if not all(map(len, lists)):
            return self.positions[:0]
        begins = np.unique(np.concatenate(lists))
        for listed in lists:
            at = np.searchsorted(listed, begins)
            found = at < len(listed)
            found[found] = listed[at[found]] < begins[found] + within
            begins = begins[found]
        return begins


def term_counts(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """How often each of some terms occurs in the whole index; reads terms and counts only."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for names, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
                numbers = np.frombuffer(counts.as_py(), np.int32)
                for i, name in enumerate(names.as_py().split()):
                    if name in shared.value:
                        total[name] = total.get(name, 0) + int(numbers[i])
        yield pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], names=["term", "n"]
        )

    found = index.select("terms", "counts").mapInArrow(count, "term binary, n long")
    return {bytes(r["term"]): r["n"] for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}


@dataclass
class Windows:
    """The distinct windows of a batch of items, as arrays: words by number, where each
    window begins in them, and the items it is from, window after window."""

    terms: list[bytes]
    words: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray
    items: list[str]
    owners: np.ndarray
    owner_ends: np.ndarray

    def names(self, window: int) -> list[str]:
        own = self.owners[self.owner_ends[window - 1] if window else 0 : self.owner_ends[window]]
        return [self.items[i] for i in own.tolist()]

    def numbers(self, window: int) -> np.ndarray:
        return self.words[self.begins[window] : self.begins[window] + self.lengths[window]]

    def by_rarest(self, counts: np.ndarray) -> dict[bytes, list[int]]:
        """Windows of which every term is in the index, by the rarest of their terms."""
        found: dict[bytes, list[int]] = {}
        for window in range(len(self.begins)):
            numbers = self.numbers(window)
            rarest = numbers[counts[numbers].argmin()]
            if counts[rarest]:
                found.setdefault(self.terms[rarest], []).append(window)
        return found

    def places(self, window: int, counts: np.ndarray) -> list[tuple[bytes, int]]:
        """A window's terms and their offsets, the rarest term first."""
        numbers = self.numbers(window)
        return [(self.terms[numbers[i]], i) for i in counts[numbers].argsort(kind="stable").tolist()]


def item_windows(items: Sequence[tuple[str | None, list[bytes]]], length: int = WINDOW) -> Windows:
    """All runs of ``length`` words of the items; a shorter text with any word is one window."""
    number: dict[bytes, int] = {}
    words = np.array([number.setdefault(w, len(number)) for _, t in items for w in t], np.int32)
    names: dict[str, int] = {}
    known: dict[bytes, int] = {}
    begins, lengths, owners = [], [], []
    start = 0
    for name, text in items:
        size = min(length, len(text))
        for begin in range(start, start + len(text) - size + 1) if text else ():
            window = known.setdefault(words[begin : begin + size].tobytes(), len(known))
            if window == len(begins):
                begins.append(begin)
                lengths.append(size)
            if name is not None:
                owners.append((window, names.setdefault(name, len(names))))
        start += len(text)
    own = np.unique(np.array(owners, np.int64).reshape(-1, 2), axis=0)
    ends = np.searchsorted(own[:, 0], np.arange(len(begins)), side="right")
    return Windows(
        list(number), words, np.array(begins, np.int64), np.array(lengths, np.int64), list(names), own[:, 1], ends
    )


def _batches(items: DataFrame, batch_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Words of the test items by id, in batches of bounded size."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / batch_bytes))
    named = items.where("text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    for i in range(count):
        part = named.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == i)
        yield [(r["item"], words_of(r["text"])) for r in part.collect()]


DOC_HITS = "array<struct<start:int,end:int>>"


def _searched(index: DataFrame, items: list[tuple[str, list[bytes]]], length: int) -> DataFrame:
    """Every indexed document with the stretches hit by one batch of items, and those items."""
    windows = item_windows(items, length)
    in_index = term_counts(index, set(windows.terms)) if windows.terms else {}
    counts = np.array([in_index.get(t, 0) for t in windows.terms], np.int64)
    # Plain values only, so that executors need no class to load them.
    shared = index.sparkSession.sparkContext.broadcast((vars(windows), counts, windows.by_rarest(counts)))
    kind = dict(index.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    schema = f"block long, place int, doc_id {kind}, text_hash long, n_words long, hits {DOC_HITS}, items array<string>"

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts, by_rarest = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                block = {c: batch.column(c)[row] for c in batch.schema.names}
                yield _search_block(block, Windows(**values), counts, by_rarest)

    return index.withColumn("block", F.xxhash64("doc_ids", "text_hashes", "starts")).mapInArrow(search, schema)


def _search_block(block: dict, windows: Windows, counts: np.ndarray, by_rarest: dict[bytes, list[int]]) -> pa.RecordBatch:
    postings = Postings(*(block[c].as_py() for c in ("terms", "counts", "positions")))
    starts = np.frombuffer(block["starts"].as_py(), np.int32)
    documents = len(starts) - 1
    hits: list[list] = [[] for _ in range(documents)]
    items: list[set] = [set() for _ in range(documents)]
    for term in postings.terms.keys() & by_rarest.keys():
        for window in by_rarest[term]:
            places, names = windows.places(window, counts), windows.names(window)
            begins = postings.phrase(places)
            owner = np.searchsorted(starts, begins, side="right") - 1
            inside = begins + len(places) <= starts[owner + 1]
            for at, doc in zip(begins[inside].tolist(), owner[inside].tolist(), strict=True):
                hits[doc].append((at, at + len(places)))
                items[doc].update(names)
    merged = [_merge(h, int(starts[i])) for i, h in enumerate(hits)]
    hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block["block"].as_py()] * documents, pa.int64()),
            pa.array(range(documents), pa.int32()),
            block["doc_ids"].values,
            block["text_hashes"].values,
            pa.array(np.diff(starts), pa.int64()),
            pa.array([[{"start": a, "end": b} for a, b in m] for m in merged], hit_type),
            pa.array([sorted(i) for i in items], pa.list_(pa.string())),
        ],
        names=["block", "place", "doc_id", "text_hash", "n_words", "hits", "items"],
    )


def _merge(spans: list[tuple[int, int]], origin: int) -> list[tuple[int, int]]:
    """Sorted stretches without overlap, counted from ``origin``."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a - origin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b - origin))
        else:
            out.append((a - origin, b - origin))
    return out


def phrase_hits(index: DataFrame, items: DataFrame, length: int = WINDOW, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``doc_id, text_hash, n_words, hits, items`` of every indexed document: its stretches
    of words (end exclusive) inside an occurrence of any window of ``items (item_id, text)``."""
    found = [_searched(index, batch, length) for batch in _batches(items, batch_bytes)]
    if len(found) == 1:
        return found[0].drop("block", "place")
    everything = found[0]
    for more in found[1:]:
        everything = everything.unionByName(more)
    none = F.array().cast(DOC_HITS)

    def join(done, span):
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        wider = wider.cast("struct<start:int,end:int>")
        rest = F.slice(done, 1, F.size(done) - 1)
        touches = (F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["end"])
        return F.when(touches, F.concat(rest, F.array(wider))).otherwise(F.concat(done, F.array(span)))

    # A block may occur twice if its texts and ids do; then its rows are counted.
    ranked = everything.groupBy("block", "place", "doc_id", "text_hash", "n_words").agg(
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        (F.count(F.lit(1)) / len(found)).cast("int").alias("times"),
    )
    return ranked.select(
        "doc_id", "text_hash", "n_words",
        F.aggregate(F.array_sort("hits"), none, join).alias("hits"),
        "items", F.explode(F.sequence(F.lit(1), "times")).alias("_"),
    ).drop("_")


def proximity_hits(index: DataFrame, terms: Sequence[str], within: int) -> DataFrame:
    """``doc_id, start``: stretches of ``within`` words of one document that begin with one
    of ``terms`` and have all of them, in any order."""
    wanted = sorted({w for t in terms for w in words_of(t)})
    counts = term_counts(index, set(wanted))
    rarest = sorted(wanted, key=lambda t: (counts.get(t, 0), t))
    kind = dict(index.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = {c: batch.column(c)[row] for c in batch.schema.names}
                postings = Postings(*(block[c].as_py() for c in ("terms", "counts", "positions")))
                starts = np.frombuffer(block["starts"].as_py(), np.int32)
                begins = postings.together(rarest, within)
                owner = np.searchsorted(starts, begins, side="right") - 1
                last = np.stack([_first_from(postings.of(t), begins) for t in rarest]).max(axis=0, initial=0)
                inside = last < starts[owner + 1]
                ids = block["doc_ids"].values.take(pa.array(owner[inside]))
                at = pa.array((begins - starts[owner])[inside], pa.int32())
                yield pa.RecordBatch.from_arrays([ids, at], names=["doc_id", "start"])

    return index.mapInArrow(search, f"doc_id {kind}, start int")


def _first_from(listed: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return listed[np.searchsorted(listed, begins)] if len(begins) else begins


def contamination(docs: DataFrame, items: DataFrame, length: int = WINDOW, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits, items, text_hash``.

    A word is hit if it lies inside an occurrence of a window of an item: 13 consecutive
    words, or the whole item if it has fewer (none: no window). A document is
    contaminated if at least one word in twenty is hit. Null texts have no words and are
    clean; null item texts are skipped, an item without an id hits words but is not
    counted; repeated rows are judged alike; empty tables give an empty result or no hit.
    """
    found = phrase_hits(build_index(docs), items, length, batch_bytes)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", hit).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
        "hits",
        "items",
        "text_hash",
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    bad = contamination(docs, items).where("contaminated").select("doc_id", "text_hash").distinct()
    rows = as_rows(docs).withColumn("hash", F.xxhash64(row_text("row.text")))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    return rows.join(stored(bad, "contaminated"), same, "left_anti").select("row.*")
