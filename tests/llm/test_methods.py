"""The methods themselves: plain versions, guarantees and round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lullspark.llm import components, decontaminate, exact_dedup, language_id, mixing, secrets_scan, sharding, simhash
from lullspark.llm import url_filter, warc


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.random.default_rng(2).integers(0, 1 << 63, 20_000).astype(np.uint64)
    for n in (1, 2, 7, 8, 50):
        now, grown = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert ((grown == now) | (grown == n)).all()
        assert abs((grown == n).mean() - 1 / (n + 1)) < 0.02
        assert np.bincount(now, minlength=n).min() > 0.8 * len(keys) / n


def test_slots_have_no_gap(spark):
    rows = spark.range(5000).select((F.col("id") % 4000).alias("doc_id"), F.lit("t").alias("text"))
    found = sharding.shard_documents(rows, chunks=7).groupBy("shard").agg(
        F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m"), F.min("slot").alias("z")
    )
    assert all(r["n"] == r["d"] == r["m"] + 1 and r["z"] == 0 for r in found.collect())


def test_bloom_filter_lets_all_listed_keys_pass_and_the_join_removes_the_rest(spark):
    listed = spark.range(0, 4000, 2).select(F.concat(F.lit("k"), "id").alias("key"))
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    for bits, most in ((16, 40), (2, 2000)):
        passed = url_filter.possible_hits(keys, listed, bits)
        assert passed.join(listed, "key").count() == 2000
        assert 2000 <= passed.count() <= 2000 + most


def test_spread_bundles_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 50) * 10) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = warc.write_archives(pages, str(tmp_path / "w"), frame_bytes=3000, bundle_bytes=20_000)
    assert index.select("bundle").distinct().count() > 3 and index.agg(F.max("frame")).first()[0] > 2
    wanted = index.where(F.col("record_id").isin("urn:page:7", "urn:page:299"))
    got = {r["record_id"]: bytes(r["record"]) for r in warc.fetch_records(wanted).collect()}
    assert got["urn:page:299"] == warc.warc_record(*rows[299], None)
    ((_, length, fields, block),) = warc.parse_records(got["urn:page:7"])
    assert length == len(got["urn:page:7"]) and block.endswith(rows[7][2].encode())
    assert warc.read_archives(index).count() == 300


def test_equal_texts_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, "hot" * 30 if i % 3 else f"t{i % 40}") for i in range(3000)]
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        got = exact_dedup.exact_duplicates(frame).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    text = dict(rows)
    for r in got:
        own = groups[text[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), max(own) == r["doc_id"])
        assert r["text_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert sum(r["kept"] for r in got) == len(groups)


def test_fingerprint_bit_by_bit():
    text = "The the a B c\u00a0d \t é É a b c"
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(" ") == 0
    assert simhash.fingerprint("One Two") == xxhash.xxh64_intdigest(b"one two", 42)


def linked_classes(values):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_meeting_in_the_middle_finds_all_links(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    values = [np.uint64(0), np.uint64(7), np.uint64(15), np.uint64((1 << 64) - 1), *base]
    for v in base:
        for flips in (1, 2, 3, 3, 4, 6):
            mask = sum(1 << int(b) for b in rng.choice(64, flips, replace=False))
            values.append(v ^ np.uint64(mask))
    values = np.unique(np.array(values, np.uint64))
    want = linked_classes(values)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long")
    root = {r["node"]: r["root"] for r in components.components(simhash.near_links(frame, len(values))).collect()}
    signed = values.view(np.int64).tolist()
    found = {}
    for s, w in zip(signed, want, strict=True):
        found.setdefault(root.get(s, s), set()).add(w)
    assert all(len(v) == 1 for v in found.values()) and len(found) == len(set(want))


@pytest.mark.parametrize("bits", [12, 20])
def test_cells_give_every_variant_back(bits):
    values = np.array([0, 5, (1 << 64) - 1, 123456789], np.uint64)
    entries = sum(len(e) for _, e in simhash.cells(values, bits))
    ones = [int(v).bit_count() for v in values]
    assert entries == sum(65 + n * (n - 1) // 2 for n in ones)
    pairs = [simhash.cell_links(c >> (bits - 12), e) for c, e in simhash.cells(values[:2], bits)]
    assert {(int(a), int(b)) for p, q in pairs for a, b in zip(p, q, strict=True)} <= {(0, 5), (5, 0)}
    assert any(len(p) for p, _ in pairs)


def near_copies(rng, count):
    """Distinct fingerprints that differ from one of them in a few random bits each."""
    middle = rng.integers(0, 1 << 63, 1).astype(np.uint64)[0]
    masks = (rng.random((count, 64)) < 0.05) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    return np.unique(middle ^ masks.astype(np.uint64))


@pytest.mark.parametrize(("bits", "rows"), [(6, 22), (11, 67)])
def test_a_fingerprint_goes_once_to_each_group_of_its_variants(spark, bits, rows):
    rng = np.random.default_rng(5)
    values = np.array([0, 7, 1 << 63, (1 << 64) - 1, *rng.integers(0, 1 << 63, 40).tolist()], np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long")
    got = [tuple(r) for r in simhash.dealt(frame, bits).collect()]
    assert len(got) == len(set(got)) == rows * len(values)
    for v in values:
        flat, flips = simhash.variants(v[None])
        groups = {g for g, f in got if f == int(v.view(np.int64))}
        assert set(simhash.leading(flat, bits).tolist()) <= groups
        found = [simhash.variants(v[None], bits, g) for g in groups]
        assert sorted(x for f, _ in found for x in f.tolist()) == sorted(flat.tolist())
        assert sorted(x for _, f in found for x in f.tolist()) == sorted(flips.tolist())


def test_near_links_shuffle_fingerprints_and_no_variants(spark):
    values = np.random.default_rng(6).integers(0, 1 << 62, 500)
    frame = spark.createDataFrame([(int(v),) for v in values], "fingerprint long")
    links = simhash.near_links(frame, len(values))
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "binary" not in plan
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression [grp#" in line]
    assert len(dealt) == 1 and "Generate explode" in plan


def test_groups_in_parts_and_many_near_copies(spark):
    rng = np.random.default_rng(7)
    values = np.unique(np.concatenate([near_copies(rng, 400), rng.integers(0, 1 << 63, 100).astype(np.uint64)]))
    for group in np.unique(simhash.leading(values, 6))[:8].tolist():
        (whole,), parts = simhash.group_links(values, group, 6), list(simhash.group_links(values, group, 6, 500))
        assert len(parts) > 1 and {*map(tuple, whole.tolist())} == {tuple(x) for p in parts for x in p.tolist()}
    want, signed = linked_classes(values), values.view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    # As many as need 256 groups.
    links = simhash.near_links(frame, 1_000_000).collect()
    assert all((a ^ b).bit_count() <= 3 for a, b in np.array([[r.a, r.b] for r in links]).view(np.uint64).tolist())
    root = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links)).collect()}
    found = {(root.get(s, s), w) for s, w in zip(signed, want, strict=True)}
    assert len(found) == len({r for r, _ in found}) == len(set(want)) < len(values)


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(None, text), (7, text), (7, text), (7, None), (9, ""), (None, " \t"), (None, "alone"), (4, text + " end"), (2, "two words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    prints = np.array([simhash.fingerprint(t or "") for _, t in rows], np.uint64)
    classes = linked_classes(prints)
    least = {c: min((i for (i, _), d in zip(rows, classes, strict=True) if c == d and i is not None), default=None) for c in classes}
    want = [(i, f"{int(p):016x}", least[c]) for (i, _), p, c in zip(rows, prints, classes, strict=True)]
    assert sorted(map(repr, map(tuple, simhash.near_duplicates(frame).collect()))) == sorted(map(repr, want))


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 300), (401, 400)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(80)}, 400: 400, 401: 400}


def plain_hits(words, windows):
    hit = set()
    for w in windows:
        for i in range(len(words) - len(w) + 1):
            if tuple(words[i : i + len(w)]) == w:
                hit |= set(range(i, i + len(w)))
    return hit


def runs(words, length=13):
    size = min(length, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def test_windows_are_distinct_and_know_their_items():
    items = [("x", [b"a"] * 15), ("y", [b"b", b"a"]), (None, [b"b", b"a"]), ("z", []), ("y", [b"b", b"a"])]
    found = decontaminate.item_windows(items)
    counts = np.array([5, 2])
    assert [(found.places(w, counts), found.names(w)) for w in range(2)] == [
        ([(b"a", i) for i in range(13)], ["x"]), ([(b"b", 0), (b"a", 1)], ["y"])
    ]
    assert len(found.begins) == 2 and found.by_rarest(counts) == {b"a": [0], b"b": [1]}
    assert found.by_rarest(np.array([5, 0])) == {b"a": [0]}
    assert decontaminate.item_windows([("z", [])]).by_rarest(np.zeros(0, np.int64)) == {}


@pytest.mark.parametrize("batch_bytes", [1 << 20, 60])
def test_phrases_against_brute_force(spark, batch_bytes):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcd", k=rng.choice([0, 3, 30, 90]))) for _ in range(80)]
    tests = [(i, " ".join(rng.choices("ABCD", k=k))) for i, k in enumerate([1, 2, 3, 5, 14, 20])]
    tests = tests[2:] + [(9, texts[5][10:60])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(tests, "item_id long, text string")
    index = decontaminate.build_index(frame, block_bytes=200)
    windows = {i: runs(decontaminate.words_of(t)) for i, t in tests}
    for r in decontaminate.phrase_hits(index, items, batch_bytes=batch_bytes).collect():
        words = decontaminate.words_of(texts[r["doc_id"]])
        want = plain_hits(words, set().union(*windows.values()))
        assert {p for s in r["hits"] for p in range(s["start"], s["end"])} == want
        assert set(r["items"]) == {str(i) for i, w in windows.items() if plain_hits(words, w)}


def test_proximity(spark):
    rows = [(1, "a x b"), (2, "b x x a"), (3, "a b a"), (4, "a"), (5, "b c")]
    index = decontaminate.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(tuple(r) for r in decontaminate.proximity_hits(index, ["A", "b"], 3).collect())
    assert got == [(1, 0), (3, 0), (3, 1)]


def test_mix_meets_targets_and_refills(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 4}" if i % 3 else "s0") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame, weights=(8, 1, 1, 1)).toPandas()
    again = mixing.mix(frame.repartition(5), weights=(8, 1, 1, 1)).toPandas()
    key = ["doc_id"]
    assert got.sort_values(key)["taken"].tolist() == again.sort_values(key)["taken"].tolist()
    by_source = got.groupby("source")
    assert (by_source["taken"].sum() - by_source["target"].first()).abs().max() <= 0.5
    assert by_source["target"].first().sum() == pytest.approx(1.5 * got["size"].sum())
    copies = mixing.mixed_documents(frame, weights=(8, 1, 1, 1)).groupBy("doc_id").count().toPandas()
    assert copies["count"].sum() == got["copies"].sum()


def test_markov_models_tell_random_from_ordinary(spark):
    rng = random.Random(6)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(60)]
    names = ["connectionManager", "internationalization", "responsibilities", "configuration_value"]
    docs = [(i, f"the {rng.choice(names)} has token = \"{h}\" here {rng.choice(names)}") for i, h in enumerate(hexes)]
    docs += [(100 + i, " ".join([*rng.choices(names, k=8), str(rng.randrange(10**15, 10**16))])) for i in range(60)]
    frame = spark.createDataFrame([*docs, (999, "key 93b1f0a7c25d84e6 or internationalizations")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets_scan.find_secrets(frame).collect()}
    assert got[999]["spans"] == "markov:4:20"
    assert not any(r["n_markov"] for i, r in got.items() if i != 999)


def best_path(scores, penalty):
    state, back = list(scores[0]), []
    for row in scores[1:]:
        step = [max(range(len(state)), key=lambda j: (state[j] - penalty * (j != k), j == k)) for k in range(len(row))]
        state = [state[j] - penalty * (j != k) + row[k] for k, j in enumerate(step)]
        back.append(step)
    return max(state)


def test_viterbi_is_optimal():
    rng = np.random.default_rng(8)
    scores = -rng.random((50, 3)).astype(np.float32) * 4
    lengths = np.array([7, 1, 30, 12])
    numbers = rng.integers(0, 50, lengths.sum())
    labels = language_id.viterbi(scores, numbers, lengths, 2.0)
    at = 0
    for n in lengths:
        own, path = scores[numbers[at : at + n]], labels[at : at + n]
        value = own[np.arange(n), path].sum() - 2.0 * (path[1:] != path[:-1]).sum()
        assert value == pytest.approx(best_path(own.tolist(), 2.0), abs=1e-4)
        at += n


def test_mixed_text_falls_into_spans(spark):
    words = {"de": "der hund und die katze gehen nicht ueber schöne wege", "en": "the dog with this house which should have been there"}
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(words[la].split(), k=30)), la) for i in range(80) for la in [("de", "en")[i % 2]]]
    mixed = words["de"] + " " + words["en"] + " " + "привет"
    frame = spark.createDataFrame([*rows, (5000, mixed, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(frame).collect()}
    spans = [(mixed[s["start"] : s["end"]], s["lang"]) for s in got[5000]["spans"]]
    assert spans[0] == (words["de"], "de") and spans[1][1] == "en" and len(spans) == 2
    held = [(got[i]["lang_pred"], la) for i, _, la in rows if got[i]["held_out"]]
    assert len(held) > 10 and all(a == b for a, b in held)


def test_mixed_documents_meet_the_budget_where_ids_repeat(spark):
    rows = [(None, f"one two {i}", "a") for i in range(100)] + [(1, "same words here", "b")] * 40
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    settings = {"weights": (3, 1), "share": 0.5}
    want = mixing.mix(frame, **settings).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    found = mixing.mixed_documents(frame, **settings)
    got = found.groupBy("source").count().collect()
    assert {r["source"]: r["n"] for r in want} == {r["source"]: r["count"] for r in got} == {"a": 53, "b": 18}
    assert found.where("source = 'a'").distinct().count() == 53
