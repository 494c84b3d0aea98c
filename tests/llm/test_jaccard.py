"""Links of the five-word Jaccard search against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import final_plan
from lullspark.llm import jaccard, simhash
from lullspark.llm.components import components


def near_copies():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    boiler = rng.choices(vocabulary, k=60)
    texts = ["", None, "one two", "One  two", "one three"]
    for n in (20, 60, 150):
        for _ in range(8):
            words = rng.choices(vocabulary, k=n)
            texts.append(" ".join(words))
            for edits in (1, 1, 2, 3, 5):
                copy = list(words)
                for _ in range(edits):
                    copy[rng.randrange(n)] = rng.choice(vocabulary)
                texts.append(" ".join(copy))
            texts.append(" ".join(words + words[: n // 5]))
    texts += [" ".join(boiler + rng.choices(vocabulary, k=k)) for k in range(1, 40)]
    return texts


def classes(texts):
    sets = [set(jaccard.shingle_set(t or "").tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_links_connect_what_all_pairs_connect(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    root = {r["node"]: r["root"] for r in components(jaccard.similar_texts(docs)).collect()}
    got, want = {}, {}
    for i, w in enumerate(classes(texts)):
        got.setdefault(root.get(hashes[i], hashes[i]), set()).add(i)
        want.setdefault(w, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert len(want) < len(texts) - 50


def test_stage_keeps_one_of_near_copies_that_fingerprints_miss(spark):
    texts = near_copies()[5:]
    prints = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    roots = classes(texts)
    missed = [i for i, r in enumerate(roots) if r != i and np.bitwise_count(prints[i] ^ prints[np.arange(len(prints)) != i]).min() > 3]
    assert missed
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert not kept & set(missed)
    assert kept <= set(roots)


def test_sets_are_read_by_one_worker_and_without_copies(spark):
    rows = [(i, f"a b c d e f g {i}") for i in range(50)] + [(100 + i, "one text in many copies here") for i in range(50)]
    docs = spark.createDataFrame([*rows, (None, "of no id"), (None, None)], "doc_id long, text string")
    named = docs.select(F.col("doc_id").alias("id"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    wanted = named.where("id is null or id in (3, 7, 120)").localCheckpoint()
    found = jaccard._read_sets(wanted, docs)
    got = sorted((str(r["id"]), [x % 2**64 for x in r["shingles"]]) for r in found.collect())
    texts = {"3": [rows[3][1]], "7": [rows[7][1]], "120": [rows[70][1]], "None": ["of no id", ""]}
    assert got == sorted((i, jaccard.shingle_set(t).tolist()) for i, ts in texts.items() for t in ts)
    plan = final_plan(found)
    assert plan.count("MapInArrow") == 1


def one_group(n):
    """Copies of one text with 0 to 7 words of their own; half have too many to be similar to it."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(0, 150, 10), rng.choice((1, 2, 3, 5, 6, 7))):
            words[at] = f"own{i}_{at}"
        texts.append(" ".join(words))
    return texts


def test_pairs_of_a_group_grow_with_its_size_only(spark, monkeypatch):
    seen = []

    def counted(pairs, named, whole=jaccard._candidates):
        seen[-1].append(pairs.count())
        return whole(pairs, named)

    monkeypatch.setattr(jaccard, "_candidates", counted)
    for n in (60, 240):
        seen.append([])
        texts = one_group(n)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
        root = {r["node"]: r["root"] for r in components(jaccard.similar_texts(docs)).collect()}
        got, want = {}, {}
        for i, w in enumerate(classes(texts)):
            got.setdefault(root.get(hashes[i], hashes[i]), set()).add(i)
            want.setdefault(w, set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        assert n // 3 < len(want) < n
    small, large = map(sum, seen)
    assert 0 < small
    assert large < 6 * small


@pytest.mark.parametrize("seed", range(3))
def test_first_common_shingle_bounds_the_other_size(seed):
    rng = np.random.default_rng(seed)
    values = np.unique(rng.integers(0, 2**64, 400, np.uint64))
    late = np.sort(rng.choice(values, 150, replace=False))
    common = (late, rng.permutation(len(late)).astype(np.int32))
    place = {v: (1, r) for v, r in zip(late.tolist(), common[1].tolist(), strict=True)}
    similar = 0
    for _ in range(300):
        a = np.sort(rng.choice(values, rng.integers(1, 120), replace=False))
        kept = rng.random(len(a)) < rng.uniform(0.8, 1)
        b = np.unique(np.concatenate([a[kept], rng.choice(values, rng.integers(0, 12))]))
        x, y = jaccard.in_order(a, common).tolist(), jaccard.in_order(b, common).tolist()
        assert x == sorted(a.tolist(), key=lambda v: place.get(v, (0, v)))
        both = set(x) & set(y)
        if 9 * len(both) < 4 * (len(x) + len(y)):
            continue
        similar += 1
        most = [(5 * len(s) - 9 * min(map(s.index, both))) // 4 for s in (x, y)]
        assert len(y) <= most[0]
        assert len(x) <= most[1]
    assert similar > 50
