"""Language identification of whole, possibly mixed texts.

The script of a word narrows its candidates to the languages that use it. Character
n-grams score every word for each candidate; Viterbi decoding with a penalty for each
switch then labels the words, so a text falls into spans of one language.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullspark.llm.common import as_rows, row_text

UNDETERMINED = "und"
# First and last code point of the blocks that make up a script.
SCRIPTS = [
    ("latin", [(0x0041, 0x024F), (0x1E00, 0x1EFF)]),
    ("greek", [(0x0370, 0x03FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x0400, 0x052F)]),
    ("armenian", [(0x0530, 0x058F)]),
    ("hebrew", [(0x0590, 0x05FF)]),
    ("arabic", [(0x0600, 0x06FF), (0x0750, 0x077F)]),
    ("devanagari", [(0x0900, 0x097F)]),
    ("bengali", [(0x0980, 0x09FF)]),
    ("tamil", [(0x0B80, 0x0BFF)]),
    ("thai", [(0x0E00, 0x0E7F)]),
    ("georgian", [(0x10A0, 0x10FF)]),
    ("kana", [(0x3040, 0x30FF)]),
    ("han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)]),
    ("hangul", [(0x1100, 0x11FF), (0xAC00, 0xD7AF)]),
]
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SAMPLE_DOCS = 2000
SMOOTHING = 0.5
# N-grams of a word overlap, so their evidence counts in part.
EVIDENCE = 0.5
SWITCH_PENALTY = 8.0
SCRIPT_SHARE = 0.01
OUTSIDE = -60.0
CHUNK_CHARS = 4 << 20
# Words scored at once; their n-grams take some hundred bytes a character.
SCORED_WORDS = 1 << 13


@dataclass
class Model:
    """Log probabilities of hashed n-grams, ``BUCKETS`` by language, and who uses which script."""

    languages: list[str]
    table: np.ndarray
    uses: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def script_numbers(points: np.ndarray) -> np.ndarray:
    """Script of each code point; ``len(SCRIPTS)`` if none has it."""
    out = np.full(len(points), len(SCRIPTS), np.int16)
    for i, (_, blocks) in enumerate(SCRIPTS):
        for first, last in blocks:
            out[(points >= first) & (points <= last)] = i
    return out


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram buckets of all words, where each word's begin, and each word's script."""
    joined = "".join([f"\x02{w.lower()}\x03" for w in words])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begins = np.flatnonzero(points == 2)
    word = np.cumsum(points == 2) - 1
    buckets, owners = [], []
    gram = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for order in ORDERS:
            last = len(points) - order + 1
            gram = gram[:last] * np.uint64(0x9E3779B97F4A7C15) + points[order - 1 :][:last] + np.uint64(order)
            same = word[:last] == word[order - 1 :][:last]
            mixed = gram ^ (gram >> np.uint64(29))
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((mixed >> np.uint64(48)).astype(np.int64)[same])
            owners.append(word[:last][same])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(len(words)))
    return np.concatenate(buckets)[order], starts, script_numbers(points[begins + 1])


def _counted(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts, and letters by script, of some texts."""
    grams, scripts = np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)
    for text in texts:
        words = WORD.findall(text)
        if words:
            buckets, _, script = word_features(words)
            grams += np.bincount(buckets, minlength=BUCKETS)
            scripts += np.bincount(script, weights=[len(w) for w in words], minlength=len(scripts)).astype(np.int64)
    return grams, scripts


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from about ``sample_docs`` whole texts of each language: those whose id hashes
    low enough for that number. The driver gets one row per n-gram bucket and language.
    """
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = labelled.groupBy("lang").count().orderBy("lang").collect()
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    luck = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_docs / r["count"]))])
    sample = labelled.where(luck < share[F.col("lang")]).select("lang", row_text().alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                grams, scripts = totals.setdefault(
                    lang.as_py(), [np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)]
                )
                more = _counted([text.as_py()])
                grams += more[0]
                scripts += more[1]
        for lang, both in totals.items():
            for kind, counts in enumerate(both):
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(at), pa.string()),
                        pa.array(np.full(len(at), kind)),
                        pa.array(at),
                        pa.array(counts[at]),
                    ],
                    names=["lang", "kind", "at", "n"],
                )

    rows = sample.mapInArrow(count, "lang string, kind long, at long, n long")
    found = rows.groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toPandas()
    grams, scripts = np.zeros((BUCKETS, len(languages))), np.zeros((len(SCRIPTS) + 1, len(languages)))
    column = found["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(np.int64)
    for kind, target in ((0, grams), (1, scripts)):
        of_kind = (found["kind"] == kind).to_numpy()
        target[found["at"].to_numpy()[of_kind], column[of_kind]] = found["n"].to_numpy()[of_kind]
    table = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
    return Model(languages, table, scripts > SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log evidence of each word for each language, at most 0; far below outside its script."""
    parts = [_part_scores(words[i : i + SCORED_WORDS], model) for i in range(0, len(words), SCORED_WORDS)]
    return np.concatenate(parts)


def _part_scores(words: list[str], model: Model) -> np.ndarray:
    buckets, starts, script = word_features(words)
    scores = np.add.reduceat(model.table[buckets], starts, axis=0) * np.float32(EVIDENCE)
    uses = model.uses[script]
    scores[~uses & uses.any(axis=1, keepdims=True)] += np.float32(OUTSIDE)
    return scores - scores.max(axis=1, keepdims=True)


def viterbi(scores: np.ndarray, numbers: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word; all texts advance together, the longest first.

    ``numbers`` has the row of ``scores`` of each word, text after text.
    """
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[order], lengths[order]
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
    kinds = scores.shape[1]
    back = np.empty((len(numbers), kinds), np.int16)
    stay = np.arange(kinds, dtype=np.int16)
    state = np.zeros((len(sizes), kinds), np.float32)
    for t, n in enumerate(live):
        ahead = state[:n] - state[:n].max(axis=1, keepdims=True)
        leader = ahead.argmax(axis=1).astype(np.int16)
        back[starts[:n] + t] = np.where(ahead < -penalty, leader[:, None], stay)
        state[:n] = np.maximum(ahead, -penalty) + scores[numbers[starts[:n] + t]]
    labels = np.empty(len(numbers), np.int16)
    now = state.argmax(axis=1).astype(np.int16)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        labels[starts[:n] + t] = now[:n]
        now[:n] = back[starts[:n] + t, now[:n]]
    return labels


def label_texts(texts: list[str], model: Model, penalty: float = SWITCH_PENALTY) -> list[tuple[str, float, list]]:
    """Language, share of letters in it, and spans ``(start, end, language)`` of each text.

    Texts without a letter, or all without a learned language, are undetermined.
    """
    distinct: dict[str, int] = {}
    words, starts, ends, counts = array("i"), array("i"), array("i"), array("q")
    for text in texts:
        before = len(words)
        for m in WORD.finditer(text):
            words.append(distinct.setdefault(m.group(), len(distinct)))
            starts.append(m.start())
            ends.append(m.end())
        counts.append(len(words) - before)
    out: list[tuple[str, float, list]] = [(UNDETERMINED, 0.0, [])] * len(texts)
    if not model.languages or not words:
        return out
    numbers, first, last = (np.frombuffer(x, np.int32) for x in (words, starts, ends))
    lengths = np.frombuffer(counts, np.int64)
    has = np.flatnonzero(lengths)
    labels = viterbi(word_scores(list(distinct), model), numbers, lengths[has], penalty)
    at = 0
    for i in has.tolist():
        here = slice(at, at + lengths[i])
        own, begin, end = labels[here], first[here], last[here]
        at += lengths[i]
        letters = np.bincount(own, weights=end - begin, minlength=len(model.languages))
        best = int(letters.argmax())
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
        spans = [
            (a, b, model.languages[c])
            for a, b, c in zip(begin[cuts[:-1]].tolist(), end[cuts[1:] - 1].tolist(), own[cuts[:-1]].tolist(), strict=True)
        ]
        out[i] = (model.languages[best], float(letters[best] / letters.sum()), spans)
    return out


SPANS = "array<struct<start:int,end:int,lang:string>>"


def _labelled(texts: pa.Array, model: Model, penalty: float) -> Iterator[tuple[int, list[tuple[str, float, list]]]]:
    """Where some texts begin, and what ``label_texts`` finds in them, until all are done."""
    held, first, size = [], 0, 0
    for i, text in enumerate(texts):
        held.append(text.as_py())
        size += len(held[-1])
        if size >= CHUNK_CHARS or i + 1 == len(texts):
            yield first, label_texts(held, model, penalty)
            held, first, size = [], i + 1, 0


def predict(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows of ``docs (doc_id, text_hash, text)`` with ``lang_pred, score, spans`` for the text."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        for batch in batches:
            for first, done in _labelled(batch.column("text"), model, penalty):
                spans = [[{"start": a, "end": b, "lang": c} for a, b, c in d[2]] for d in done]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(done)),
                        batch.column("text_hash").slice(first, len(done)),
                        pa.array([d[0] for d in done], pa.string()),
                        pa.array([d[1] for d in done], pa.float64()),
                        pa.array(spans, span_type),
                    ],
                    names=["doc_id", "text_hash", "lang_pred", "score", "spans"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64(row_text()).alias("text_hash"), row_text().alias("text"))
    return rows.mapInArrow(label, f"doc_id {kind}, text_hash long, lang_pred string, score double, spans {SPANS}")


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans, text_hash`` for every row.

    Learns from ``lang`` of rows that are not held out. ``score`` is the share of letters in
    words labelled with the predicted language; ``spans`` are code points of the text, end
    exclusive. A text that is null, empty or without a letter is `und` with score 0, and so
    is every text if nothing can be learned. A word in a script that no language uses
    follows its neighbours. A null id is not held out; repeated rows are labelled alike; an
    empty table gives an empty result.
    """
    found = predict(docs, train(docs, sample_docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans", "text_hash")


def main_language(
    docs: DataFrame, text: Column, least_score: float = 0.5, sample_docs: int = SAMPLE_DOCS, penalty: float = SWITCH_PENALTY
) -> Column:
    """Whether ``text`` has a main language, by a model trained on ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(train(docs, sample_docs)))

    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(**shared.value)
        for texts in columns:
            kept = []
            for _, done in _labelled(texts, model, penalty):
                kept += [lang != UNDETERMINED and score >= least_score for lang, score, _ in done]
            yield pa.array(kept, pa.bool_())

    return F.arrow_udf(judge, "boolean")(text)


def with_language(docs: DataFrame, least_score: float = 0.5, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs`` that have a main language: letters, and at least ``least_score``
    of them in words of one language. Whether a row has one follows from its text, so rows
    are filtered where they are read; none is shuffled."""
    rows = as_rows(docs)
    return rows.where(main_language(docs, row_text("row.text"), least_score, sample_docs)).select("row.*")
