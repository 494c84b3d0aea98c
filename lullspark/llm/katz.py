"""A word bigram model with Katz backoff, trained and applied without one row per token.

Texts are kept in blocks. Each block sends its distinct keys (words, then word pairs) as
sorted, packed arrays to partitions of the key space; a partition merges them, stores
the merged counts, and answers every block in the order of its keys. So each key moves
once per block, and counts, discounts and backoff weights cover all training texts.

Words are known by the 64-bit XXH64 of their bytes while they are counted (n distinct
words share one with probability n * n / 2 ** 65) and by a number after that. Numbers
follow frequency, which packs pairs well and makes a word's count a lookup in a
table of count levels. Pairs are partitioned by the history, except for the most
frequent histories, whose pairs are spread and whose weights are summed up in between.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lullspark.llm.common import row_text, scratch_path, stored

BLOCK_BYTES = 8 << 20
TOKENS_PER_PARTITION = 2_000_000
LARGEST_DISCOUNTED = 5
BEGIN, UNKNOWN, SPREAD = 0, (1 << 32) - 1, 1024
# No word has white space, so this cannot clash with one.
END_TOKEN = b"\n"
U = np.uint64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Integers or floats as compressed byte planes, ascending ones by their gaps."""
    if ascending and len(values):
        values = np.concatenate((values[:1], np.diff(values)))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else values
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type, ascending: bool = False) -> np.ndarray:
    plain = zstandard.ZstdDecompressor().decompress(data)
    width = np.dtype(kind).itemsize
    values = np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(width, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if ascending else values


def distinct_sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of weights of each."""
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(keys) else weights


BLOCK = "block long, doc_ids array<{kind}>, held array<boolean>, tokens array<long>, texts binary, sizes binary"


def text_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """The texts in stored blocks of whole documents, bucketed by block.

    Buckets let the answers come to the blocks, which are never shuffled themselves.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size, schema = [], [], [], 0, None

        def block() -> pa.RecordBatch:
            row = {
                "block": uuid.uuid4().int >> 65,
                "doc_ids": ids,
                "held": held,
                "tokens": [len(t.split()) + 1 for t in texts],
                "texts": zstandard.ZstdCompressor(level=3).compress(b"".join(texts)),
                "sizes": pack(np.array([len(t) for t in texts], np.int64)),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([
                ("block", pa.int64()), ("doc_ids", pa.list_(batch.schema.field("doc_id").type)),
                ("held", pa.list_(pa.bool_())), ("tokens", pa.list_(pa.int64())),
                ("texts", pa.binary()), ("sizes", pa.binary()),
            ])
            for i, h, t in zip(*(batch.column(c) for c in ("doc_id", "held", "text")), strict=True):
                text = t.as_py().encode("utf-8", "surrogatepass").lower()
                if texts and size + len(text) > block_bytes:
                    yield block()
                    ids, held, texts, size = [], [], [], 0
                ids.append(i.as_py())
                held.append(h.as_py())
                texts.append(text)
                size += len(text)
        if texts:
            yield block()

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), row_text().alias("text"))
    name, tasks = f"katz_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.mapInArrow(gather, BLOCK.format(kind=kind)).write.bucketBy(tasks, "block")
    writer.option("path", scratch_path(spark, "katz-blocks")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def block_words(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct word hashes of a block, each token's place among them, tokens by text."""
    sizes = unpack(row["sizes"], np.int64)
    data = zstandard.ZstdDecompressor().decompress(row["texts"]) if sizes.sum() else b""
    words, counts, at = [], [], 0
    for size in sizes.tolist():
        own = data[at : at + size].split()
        words += own
        words.append(END_TOKEN)
        counts.append(len(own) + 1)
        at += size
    number: dict[bytes, int] = {}
    places = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(digest, number), U, len(number))
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return hashes[order], rank[places], np.array(counts, np.int64)


SENT = "part long, block long, keys binary, counts binary"


def sent_rows(parts: np.ndarray, block: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sorted keys and their training counts, one row for each partition that has any."""
    order = np.argsort(parts, kind="stable")
    parts, keys, counts = parts[order], keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
    slices = list(zip(starts, [*starts[1:], len(parts)], strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(parts[starts].astype(np.int64)),
            pa.array([block] * len(slices), pa.int64()),
            pa.array([pack(keys[a:b], True) for a, b in slices], pa.binary()),
            pa.array([pack(counts[a:b].astype(np.int64)) for a, b in slices], pa.binary()),
        ],
        names=["part", "block", "keys", "counts"],
    )


MERGED = "part long, keys binary, counts binary, blocks array<long>, places array<binary>"


def merge(sent: DataFrame, name: str) -> DataFrame:
    """One stored row for each partition: merged keys and counts, and where the keys of
    every block are among them."""

    def merged(table: pa.Table) -> pa.Table:
        sent_keys = [unpack(k, U, True) for k in table["keys"].to_pylist()]
        counts = [unpack(c, np.int64) for c in table["counts"].to_pylist()]
        keys, sums = distinct_sums(np.concatenate(sent_keys), np.concatenate(counts))
        places = [pack(np.searchsorted(keys, k).astype(np.uint32), True) for k in sent_keys]
        return pa.table(
            {
                "part": table["part"][:1],
                "keys": pa.array([pack(keys, True)], pa.binary()),
                "counts": pa.array([pack(sums)], pa.binary()),
                "blocks": pa.array([table["block"].to_pylist()], pa.list_(pa.int64())),
                "places": pa.array([places], pa.list_(pa.binary())),
            }
        )

    return stored(sent.groupBy("part").applyInArrow(merged, MERGED), name)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


ANSWER = "block long, kind int, part long, answer binary"


def answer_rows(row: dict, values: np.ndarray, kind: int) -> pa.RecordBatch:
    n = len(row["blocks"])
    answers = [pack(values[unpack(p, np.uint32, True)]) for p in row["places"]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row["blocks"], pa.int64()),
            pa.array([kind] * n, pa.int32()),
            pa.array([row["part"]] * n, pa.int64()),
            pa.array(answers, pa.binary()),
        ],
        names=["block", "kind", "part", "answer"],
    )


@dataclass
class Levels:
    """Word counts, highest first, and the first number of each; what the unigram model needs."""

    counts: np.ndarray
    starts: np.ndarray
    parts: int
    total: int
    types: int
    texts: int
    discount: np.ndarray
    unknown: float

    def count(self, numbers: np.ndarray) -> np.ndarray:
        """Training count of each number; of `BEGIN` the number of texts, of `UNKNOWN` 0."""
        at = np.searchsorted(self.starts, numbers, side="right") - 1
        known = (numbers != UNKNOWN) & (at >= 0)
        found = np.zeros(len(numbers), np.int64)
        found[known] = self.counts[at[known]]
        found[numbers == BEGIN] = self.texts
        return found

    def probability(self, numbers: np.ndarray) -> np.ndarray:
        """Discounted unigram probability; all unknown words are one outcome."""
        count = self.count(numbers)
        small = self.discount[np.minimum(count, len(self.discount) - 1)]
        return np.where(count > 0, small * count / max(self.total, 1), self.unknown)


def good_turing(singles: list[int]) -> np.ndarray:
    """Katz discounts by count from how many keys occur 1, 2, ... times; index 0 and the last are 1.

    A ratio that small or odd data leave outside (0, 1) is replaced by 1 - 1 / (2 r).
    """
    k = LARGEST_DISCOUNTED
    n = np.array([0, *singles[: k + 1]], float)
    discount = np.ones(k + 2)
    rest = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        usable = n[r] > 0 and rest < 1
        ratio = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if usable else 0.0
        discount[r] = ratio if 0 < ratio < 1 else 1 - 1 / (2 * r)
    return discount


def level_sizes(words: DataFrame) -> DataFrame:
    """``part, times, n``: how many words of each partition occur how often in the training texts."""

    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            times, n = np.unique(unpack(row["counts"], np.int64), return_counts=True)
            part = pa.array([row["part"]] * len(times), pa.int64())
            yield pa.RecordBatch.from_arrays([part, pa.array(times), pa.array(n)], names=["part", "times", "n"])

    found = words.select("part", "counts").mapInArrow(sizes, "part long, times long, n long")
    return stored(found.where("times > 0"), "katz-levels")


def with_places(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of ``words``, each with ``times, before``: how many words of a level are in
    earlier partitions. A level is at most one narrow row for each partition."""
    earlier = Window.partitionBy("times").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    by_part = (
        sizes.select("part", "times", before)
        .groupBy("part")
        .agg(F.array_sort(F.collect_list(F.struct("times", "before"))).alias("level"))
        .select("part", F.col("level.times").alias("times"), F.col("level.before").alias("before"))
    )
    return words.drop("keys").join(by_part, "part", "left")


def count_levels(sizes: DataFrame, parts: int, texts: int) -> Levels:
    """Number the words by falling count, without gaps. The driver gets one row for each count
    that occurs, of which there are fewer than the square root of twice the corpus's tokens."""
    found = sizes.groupBy("times").agg(F.sum("n").alias("n")).orderBy(F.desc("times")).collect()
    counts = np.array([r["times"] for r in found], np.int64)
    n = np.array([r["n"] for r in found], np.int64)
    starts = 1 + np.concatenate(([0], np.cumsum(n)))
    if starts[-1] >= UNKNOWN:
        raise ValueError("more distinct words than numbers")
    total = int((counts * n).sum())
    by_count = dict(zip(counts.tolist(), n.tolist(), strict=True))
    discount = good_turing([by_count.get(r, 0) for r in range(1, LARGEST_DISCOUNTED + 2)])
    kept = (discount[np.minimum(counts, len(discount) - 1)] * counts * n).sum() / max(total, 1)
    if len(counts) and kept >= 1:
        discount = discount * total / (total + 1)
        kept = total / (total + 1)
    return Levels(counts, starts[:-1], parts, total, int(n.sum()), texts, discount, float(1 - kept))


def word_numbers(row: dict, levels: Levels) -> np.ndarray:
    """Numbers of a partition's words; words outside the training texts are unknown."""
    counts = unpack(row["counts"], np.int64)
    order = np.argsort(-counts, kind="stable")
    ranked = counts[order]
    first = np.searchsorted(-ranked, -ranked, side="left")
    known = ranked > 0
    level = np.searchsorted(-levels.counts, -ranked[known])
    before = np.array(row["before"] or [], np.int64)[np.searchsorted(row["times"] or [], ranked[known])]
    numbers = np.full(len(counts), UNKNOWN, np.int64)
    numbers[order[known]] = levels.starts[level] + before + (np.arange(len(ranked)) - first)[known]
    return numbers.astype(np.uint32)


def part_of_words(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Contiguous ranges of the hash space."""
    return ((hashes >> U(32)) * U(parts)) >> U(32)


def part_of_pairs(pairs: np.ndarray, parts: int) -> np.ndarray:
    """By history; pairs of the most frequent histories by both words."""
    history, word = pairs >> U(32), pairs & U(UNKNOWN)
    mixed = history + np.where(history < SPREAD, word, U(0)) * U(0x9E3779B1)
    return ((mixed * U(0x9E3779B97F4A7C15)) >> U(32)) % U(parts)


def block_pairs(row: dict, answers: dict[int, bytes], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pair of each token with its predecessor, tokens by text, and each token's word number."""
    hashes, places, counts = block_words(row)
    owner = part_of_words(hashes, parts).astype(np.int64)
    found = [unpack(answers[p], np.uint32) for p in np.unique(owner).tolist()]
    numbers = np.concatenate(found).astype(U)[places] if found else np.zeros(0, U)
    history = np.concatenate((np.full(1, BEGIN, U), numbers[:-1])) if len(numbers) else numbers
    history[np.cumsum(counts)[:-1]] = BEGIN
    return (history << U(32)) | numbers, counts, numbers


def distinct_pairs(pairs: np.ndarray, training: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partition, key and training count of a block's pairs, in the order in which they are sent."""
    keys, counts = distinct_sums(pairs, training.astype(np.int64))
    owner = part_of_pairs(keys, parts)
    order = np.argsort(owner, kind="stable")
    return owner[order], keys[order], counts[order]


@dataclass
class Model:
    """What scoring broadcasts: count levels, discounts, weights of the spread histories."""

    levels: Levels
    discount: np.ndarray
    spread: dict[int, tuple[float, float]]

    def shared(self, spark: SparkSession) -> Broadcast:
        """Plain values only, so that executors need no class to load them."""
        return spark.sparkContext.broadcast((vars(self.levels), self.discount, self.spread))


def model_of(shared: Broadcast) -> Model:
    levels, discount, spread = shared.value
    return Model(Levels(**levels), discount, spread)


def pair_terms(keys: np.ndarray, counts: np.ndarray, model: Model) -> tuple[np.ndarray, ...]:
    """History, word, its unigram probability, and discounted probability where seen."""
    history, word = (keys >> U(32)).astype(np.int64), (keys & U(UNKNOWN)).astype(np.int64)
    lower = model.levels.probability(word)
    seen = counts > 0
    times = np.maximum(model.levels.count(history), 1)
    kept = np.where(seen, model.discount[np.minimum(counts, len(model.discount) - 1)] * counts / times, 0.0)
    return history, times, lower, kept, seen


def history_sums(keys: np.ndarray, counts: np.ndarray, model: Model) -> tuple[np.ndarray, ...]:
    """For each history here: discounted and unigram probability of the words seen after it."""
    history, _, lower, kept, seen = pair_terms(keys, counts, model)
    starts = np.flatnonzero(np.r_[True, history[1:] != history[:-1]])
    return history[starts], np.add.reduceat(kept, starts), np.add.reduceat(np.where(seen, lower, 0.0), starts), starts


def backoff_weights(keys: np.ndarray, counts: np.ndarray, model: Model) -> tuple[np.ndarray, ...]:
    """Histories, where each begins, the factor of its seen probabilities and its backoff weight.

    The weight spreads what discounting freed over the words not seen after the history.
    Where no count is small enough to be discounted, all are scaled by n / (n + 1).
    """
    histories, kept, lower, starts = history_sums(keys, counts, model)
    for i in np.flatnonzero(histories < SPREAD).tolist():
        kept[i], lower[i] = model.spread.get(int(histories[i]), (0.0, 0.0))
    times = model.levels.count(histories)
    scale = np.where(kept >= 1 - 1e-12, times / (times + 1.0), 1.0)
    weight = np.where(kept > 0, (1 - kept * scale) / np.maximum(1 - lower, 1e-300), 1.0)
    return histories, starts, scale, weight


def log_probabilities(keys: np.ndarray, counts: np.ndarray, model: Model) -> np.ndarray:
    """log10 P(word | history): discounted where seen, else backed off to the unigram."""
    _, starts, scale, weight = backoff_weights(keys, counts, model)
    own = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(keys)]))
    _, _, lower, kept, seen = pair_terms(keys, counts, model)
    return np.log10(np.where(seen, kept * scale[own], weight[own] * lower))


def katz_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Trains on the rows that are not held out and scores all. Tokens are the lower-cased
    words of the whole text and an end token; a null or empty text is the end token alone.
    All words outside the training texts are one outcome, as in the base score. With no
    training row nothing is known, and every token has probability 1. A null id is not
    held out; repeated rows count and are scored each; an empty table gives an empty result.
    """
    blocks = text_blocks(docs, block_bytes)
    sizes = blocks.select(F.explode(F.arrays_zip("held", "tokens")).alias("t")).agg(
        F.sum("t.tokens"), F.sum((~F.col("t.held")).cast("long"))
    ).first()
    tokens, texts = sizes[0] or 0, sizes[1] or 0
    parts = max(4, math.ceil(tokens / TOKENS_PER_PARTITION))

    def send_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            hashes, places, counts = block_words(row)
            training = np.repeat(~np.array(row["held"]), counts)
            sums = np.bincount(places[training], minlength=len(hashes))
            yield sent_rows(part_of_words(hashes, parts), row["block"], hashes, sums)

    words = merge(blocks.mapInArrow(send_words, SENT), "katz-words")
    level_rows = level_sizes(words)
    levels = count_levels(level_rows, parts, texts)
    shared_levels = docs.sparkSession.sparkContext.broadcast(vars(levels))

    def number_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield answer_rows(row, word_numbers(row, Levels(**shared_levels.value)), 0)

    numbers = with_places(words, level_rows).mapInArrow(number_words, ANSWER)

    def send_pairs(block: pa.Table, answers: pa.Table) -> pa.Table:
        got = dict(zip(answers["part"].to_pylist(), answers["answer"].to_pylist(), strict=True))
        row = next(rows_of(block.to_batches()))
        pairs, counts, _ = block_pairs(row, got, parts)
        sent = distinct_pairs(pairs, np.repeat(~np.array(row["held"]), counts), parts)
        return pa.Table.from_batches([sent_rows(sent[0], row["block"], *sent[1:])])

    pairs = merge(blocks.groupBy("block").cogroup(numbers.groupBy("block")).applyInArrow(send_pairs, SENT), "katz-pairs")
    model = fit(pairs, levels)
    shared = model.shared(docs.sparkSession)

    def score_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            found = log_probabilities(unpack(row["keys"], U, True), unpack(row["counts"], np.int64), model_of(shared))
            yield answer_rows(row, found.astype(np.float32), 1)

    answers = numbers.unionByName(pairs.mapInArrow(score_pairs, ANSWER))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        return scored(block, answers, model_of(shared).levels)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)


def scored(block: pa.Table, answers: pa.Table, levels: Levels) -> pa.Table:
    """The scores of a block's texts from the answers to its words and pairs."""
    got: tuple[dict, dict] = ({}, {})
    for kind, part, answer in zip(*(answers[c].to_pylist() for c in ("kind", "part", "answer")), strict=True):
        got[kind][part] = answer
    row = next(rows_of(block.to_batches()))
    pairs, counts, numbers = block_pairs(row, got[0], levels.parts)
    owner, keys, _ = distinct_pairs(pairs, np.zeros(len(pairs)), levels.parts)
    found = np.concatenate([unpack(got[1][p], np.float32) for p in np.unique(owner).tolist()])
    order = np.argsort(keys)
    each = found[order][np.searchsorted(keys[order], pairs)].astype(np.float64)
    known = levels.count(numbers.astype(np.int64))
    base = np.log10((known + 1) / (levels.total + levels.types + 1))
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    return pa.table(
        {
            "doc_id": block["doc_ids"].combine_chunks().flatten(),
            "held_out": pa.array(row["held"], pa.bool_()),
            "n_tokens": pa.array(counts),
            "n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(len(counts), levels.total, np.int64)),
            "base_score": pa.array(np.add.reduceat(base, starts)),
            "score": pa.array(np.add.reduceat(each, starts)),
        }
    )


def fit(pairs: DataFrame, levels: Levels) -> Model:
    """Discounts from all pair counts, and the sums of the spread histories.

    The driver gets one row for each discounted count and for each of ``SPREAD`` histories.
    """
    top = LARGEST_DISCOUNTED + 1

    def singles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            counts = unpack(row["counts"], np.int64)
            n = np.bincount(counts[counts <= top], minlength=top + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(top + 1)), pa.array(n)], names=["count", "n"])

    found = pairs.select("counts").mapInArrow(singles, "count long, n long").groupBy("count").agg(F.sum("n")).collect()
    by_count = dict(tuple(r) for r in found)
    model = Model(levels, good_turing([by_count.get(r, 0) for r in range(1, top + 1)]), {})
    shared = model.shared(pairs.sparkSession)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys, counts = unpack(row["keys"], U, True), unpack(row["counts"], np.int64)
            here = keys < (U(SPREAD) << U(32))
            if here.any():
                history, kept, lower, _ = history_sums(keys[here], counts[here], model_of(shared))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(history), pa.array(kept), pa.array(lower)], names=["history", "kept", "lower"]
                )

    partial = pairs.select("keys", "counts").mapInArrow(sums, "history long, kept double, lower double")
    whole = partial.groupBy("history").agg(F.sum("kept").alias("kept"), F.sum("lower").alias("lower")).collect()
    model.spread = {r["history"]: (r["kept"], r["lower"]) for r in whole}
    stored(weight_table(pairs, model), "katz-weights")
    return model


def weight_table(pairs: DataFrame, model: Model) -> DataFrame:
    """``part, histories, scales, weights`` (packed): the backoff weights beside the counts."""
    shared = model.shared(pairs.sparkSession)

    def weights(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            history, _, scale, weight = backoff_weights(
                unpack(row["keys"], U, True), unpack(row["counts"], np.int64), model_of(shared)
            )
            packed = [pack(history, True), pack(scale), pack(weight.astype(np.float32))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]]), *[pa.array([p], pa.binary()) for p in packed]],
                names=["part", "histories", "scales", "weights"],
            )

    return pairs.select("part", "keys", "counts").mapInArrow(
        weights, "part long, histories binary, scales binary, weights binary"
    )
