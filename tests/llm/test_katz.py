"""The distributed bigram model against one written plainly over dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lullspark.llm import katz

SCHEMA = "doc_id long, text string, score string, block int"


def plain_katz(docs):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["\n"] for i, t in docs}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    train = [words[i] for i in words if not held[i]]
    uni = Counter(w for t in train for w in t)
    bi = Counter(p for t in train for p in zip(["<s>", *t[:-1]], t))
    total, types = sum(uni.values()), len(uni)

    def discounts(counts):
        n = Counter(counts.values())
        k = 5
        rest = (k + 1) * n[k + 1] / n[1] if n[1] else 1
        out = {}
        for r in range(1, k + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0
            out[r] = d if 0 < d < 1 else 1 - 1 / (2 * r)
        return out

    d1, d2 = discounts(uni), discounts(bi)
    kept = sum(d1.get(c, 1) * c for c in uni.values()) / total
    assert kept < 1
    lower = {w: d1.get(c, 1) * c / total for w, c in uni.items()}
    histories = Counter()
    follows = {}
    for (h, w), c in bi.items():
        histories[h] += c
        follows.setdefault(h, {})[w] = c

    def probability(h, w):
        base = lower.get(w, 1 - kept)
        if h not in follows:
            return base
        n = histories[h]
        seen = {x: d2.get(c, 1) * c / n for x, c in follows[h].items()}
        scale = n / (n + 1) if sum(seen.values()) >= 1 - 1e-12 else 1
        if w in seen:
            return seen[w] * scale
        return (1 - sum(seen.values()) * scale) / (1 - sum(lower[x] for x in seen)) * base

    out = {}
    for i, t in words.items():
        out[i] = (
            held[i],
            len(t),
            sum(w in uni for w in t),
            total,
            sum(math.log10((uni[w] + 1) / (total + types + 1)) for w in t),
            sum(math.log10(probability(h, w)) for h, w in zip(["<s>", *t[:-1]], t)),
        )
    checks = [sum(probability(h, w) for w in [*uni, "never seen"]) for h in ["<s>", *list(follows)[:20], "never seen"]]
    assert all(abs(c - 1) < 1e-9 for c in checks)
    return out


def documents(n=120):
    rng = random.Random(5)
    vocabulary = [f"W{i}é" if i % 9 == 0 else f"w{i}" for i in range(60)]
    docs = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 40])
        docs.append((i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=size))))
    docs += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "w1 " * 3000), (n + 4, f"new{n}  words\x0bonly")]
    return docs


@pytest.mark.parametrize("block_bytes", [300, 1 << 20])
def test_scores_equal_plain_model(spark, block_bytes):
    docs = documents()
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA).repartition(3)
    want = plain_katz(docs)
    got = {r[0]: tuple(r)[1:] for r in katz.katz_scores(frame, block_bytes).collect()}
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert got[i][:4] == row[:4]
        assert got[i][4:] == pytest.approx(row[4:], rel=1e-5)


def test_spread_histories_and_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(katz, "TOKENS_PER_PARTITION", 300)
    docs = documents(60)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    want = plain_katz(docs)
    for r in katz.katz_scores(frame, 2000).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]][5], rel=1e-5)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b a", "x", 1), (1, "a b a", "x", 1), (None, "a b", "x", 1)]
    got = katz.katz_scores(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 3), (1, 4), (1, 4)]
    assert katz.katz_scores(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_held_out_rows(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = katz.katz_scores(spark.createDataFrame([(held, "a b", "x", 1)], SCHEMA)).collect()
    assert (row["n_known"], row["train_tokens"], row["score"]) == (0, 0, 0.0)


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (katz.unpack(katz.pack(values, True), np.uint64, True) == values).all()
    assert len(katz.unpack(katz.pack(values[:0], True), np.uint64, True)) == 0


def test_unusual_counts_keep_discounts_valid():
    for singles in ([0] * 6, [3, 0, 0, 0, 0, 0], [1, 9, 9, 9, 9, 9], [1000, 400, 200, 120, 80, 60]):
        discount = katz.good_turing(singles)
        assert ((discount[1:6] > 0) & (discount[1:6] < 1)).all()


def test_words_are_numbered_by_falling_count_without_gaps(spark):
    rng = np.random.default_rng(2)
    counts = [rng.zipf(1.3, size).clip(0, 5000) * (rng.random(size) < 0.8) for size in (50, 1, 200, 0, 30)]
    rows = [(p, b"", katz.pack(c.astype(np.int64)), [], []) for p, c in enumerate(counts)]
    words = spark.createDataFrame(rows, katz.MERGED)
    sizes = katz.level_sizes(words)
    levels = katz.count_levels(sizes, len(rows), 1)
    found = [
        (n, c)
        for r in katz.with_places(words, sizes).collect()
        for n, c in zip(katz.word_numbers(r.asDict(), levels).tolist(), counts[r["part"]].tolist())
    ]
    assert all(n == katz.UNKNOWN for n, c in found if not c)
    numbered = sorted((n, c) for n, c in found if c)
    assert [n for n, _ in numbered] == list(range(1, len(numbered) + 1))
    assert [c for _, c in numbered] == sorted((c for _, c in numbered), reverse=True)
    assert levels.count(np.array([n for n, _ in numbered])).tolist() == [c for _, c in numbered]
