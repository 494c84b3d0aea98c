"""Secret scans with DataFrame functions only: fixed patterns plus character models.

Patterns find what looks like an assigned secret, an access key or a long hexadecimal
string. Two first-order Markov models over characters, one of such values and one of
ordinary identifiers and numbers, add any other long string that is likelier under the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullspark.llm.common import row_text

# The patterns, the group that is the secret, its least length.
PATTERNS = [
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
# Their runs of the least length or more. A run takes all it can, so these find the same.
QUICK = {"assign": PATTERNS[0][1], "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
SCANNED = {"assign": PATTERNS[0][1], "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
# Plain numbers are ordinary too: a card number is no secret for its digits alone.
IDENTIFIER = r"(?<![A-Za-z0-9_])(?:[A-Za-z][A-Za-z0-9_]{5,}|[0-9]{6,}(?![A-Za-z0-9_]))"
SPAN = "array<struct<start:int,end:int,text:string>>"
SAMPLE_DOCS = 4000
SAMPLE_CHARS = 4096
BLOCK = 256
LEAST = -(1 << 31) + 1
SMOOTHING = 0.5
LEAST_RATIO = 12.0


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_blocks(values: Column, block: int = BLOCK) -> Column:
    """An array cut into arrays of ``block`` elements. Adding to an array copies it, so what
    runs along an array is done block by block, and once more along the blocks."""

    def cut(v: Column) -> Column:
        last = F.greatest(F.floor((F.size(v) - 1) / block).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * block + 1, F.lit(block)))

    return once(values, cut)


def running_max(values: Column) -> Column:
    """For each element of an array of ints the largest one up to it."""
    ints = "array<int>"
    none = F.struct(F.lit(LEAST).alias("top"), F.array().cast(ints).alias("run"))

    def along(acc: Column, v: Column) -> Column:
        top = F.greatest(acc["top"], v)
        return F.struct(top.alias("top"), F.concat(acc["run"], F.array(top)).alias("run"))

    def join(acc: Column, part: Column) -> Column:
        lifted = F.transform(part["run"], lambda v: F.greatest(v, acc["top"]))
        return F.struct(
            F.greatest(acc["top"], part["top"]).alias("top"), F.concat(acc["runs"], F.array(lifted)).alias("runs")
        )

    parts = F.transform(in_blocks(values), lambda b: F.aggregate(b, none, along))
    whole = F.struct(F.lit(LEAST).alias("top"), F.array().cast(f"array<{ints}>").alias("runs"))
    return F.flatten(F.aggregate(parts, whole, join)["runs"])


def match_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """``start, end, text`` of all matches, in code points; ``text`` is the group's.

    Matches and the gaps between them alternate, so their lengths add up to positions,
    first within blocks of matches, then from block to block.
    """
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.char_length(piece["gap"])
        end = start + F.char_length(piece["match"])
        span = F.struct(start.alias("start"), end.alias("end"), piece["value"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def join(acc: Column, part: Column) -> Column:
        moved = F.transform(
            part["spans"],
            lambda s: F.struct(
                (s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["text"].alias("text")
            ),
        )
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["spans"], F.array(moved)).alias("spans"))

    matched = F.filter(pieces, lambda p: p["match"].isNotNull())
    parts = F.transform(in_blocks(matched), lambda b: F.aggregate(b, none, step))
    whole = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    return F.flatten(F.aggregate(parts, whole, join)["spans"])


def _where_found(text: Column, quick: str, spans: Column) -> Column:
    return F.when(text.rlike(quick), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one fixed pattern, without those whose secret is too short."""
    group, least = next((g, n) for k, _, g, n in PATTERNS if k == kind)
    spans = F.filter(match_spans(text, SCANNED[kind], group), lambda s: F.char_length(s["text"]) >= least)
    return _where_found(text, QUICK[kind], spans)


def _pair_counts(strings: DataFrame, sample_chars: int) -> DataFrame:
    """``label, pair, n``: how often each ordered pair of characters occurs."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.char_length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2))
    )
    long_enough = strings.where(F.char_length("s").between(2, sample_chars))
    return long_enough.select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(
        F.count(F.lit(1)).alias("n")
    )


def train_ratios(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> list[float]:
    """Log-likelihood ratio of each ordered pair of ``ALPHABET``, random over ordinary.

    The patterns label the samples: values that they find are random strings, words
    beside them ordinary identifiers. Counts come from about ``sample_docs`` texts of
    each kind, those whose id and text hash low enough for that number, and in them from
    strings of up to ``sample_chars`` characters; with none, a model is uniform. The driver gets one row per pair of characters seen.
    """
    hit = F.lit(False)
    for quick in QUICK.values():
        hit |= F.col("text").rlike(quick)
    rows = docs.select("doc_id", row_text().alias("text")).withColumn("label", hit)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    luck = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = {k: min(1.0, sample_docs / sizes.get(k, 1)) for k in (True, False)}
    chosen = rows.where(luck < F.when(F.col("label"), share[True]).otherwise(share[False]))
    values = F.transform(F.concat(*[base_spans(F.col("text"), k) for k in QUICK]), lambda s: s["text"])
    words = F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))
    both = chosen.select("label", F.explode(F.when(F.col("label"), values).otherwise(words)).alias("s"))
    counts = {(r["label"], r["pair"]): r["n"] for r in _pair_counts(both.distinct(), sample_chars).collect()}
    return pair_ratios(counts)


def pair_ratios(counts: dict[tuple[bool, str], int]) -> list[float]:
    """Smoothed transition probabilities of both models, as log ratios in row order."""
    import math

    table = []
    for a in ALPHABET:
        rows = {k: [counts.get((k, a + b), 0) + SMOOTHING for b in ALPHABET] for k in (True, False)}
        for x, y in zip(rows[True], rows[False], strict=True):
            table.append(math.log(x / sum(rows[True])) - math.log(y / sum(rows[False])))
    return table


def markov_ratio(text: Column, ratios: list[float]) -> Column:
    """Summed log-likelihood ratio of a string over ``ALPHABET``."""
    width = len(ALPHABET)
    codes = [ALPHABET.find(chr(i)) for i in range(128)]
    table = F.split(F.lit(",".join(f"{r:.5f}" for r in ratios)), ",").cast("array<double>")
    code = F.split(F.lit(",".join(map(str, codes))), ",").cast("array<int>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, char: Column) -> Column:
        now = F.get(code, F.ascii(char))
        gain = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.get(table, acc["last"] * width + now))
        return F.struct(now.alias("last"), (acc["sum"] + gain).alias("sum"))

    return F.aggregate(F.split(text, ""), start, step)["sum"]


def _shown(spans: Column) -> Column:
    """`kind:start:end` of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in [*QUICK, "markov"]])
    each = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(each, ",")


def _apart(strings: str, base: str) -> Column:
    """Those of ``strings`` that meet no span of ``base``, both in order of start.

    In the common order, a string is met by an earlier span if the largest end so far is
    beyond its start, by a later one if the smallest start from there on is before its end.
    """
    candidates = F.transform(
        strings,
        lambda s: F.struct(s["start"].alias("start"), F.lit(len(QUICK)).alias("kind"), s["end"].alias("end"), s["text"].alias("text")),
    )
    spans = F.transform(
        base,
        lambda b: F.struct(
            b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit(None).cast("string").alias("text")
        ),
    )

    def placed(marks: Column) -> Column:
        ends = running_max(F.transform(marks, lambda m: F.when(m["kind"] < len(QUICK), m["end"]).otherwise(F.lit(LEAST))))
        starts = running_max(
            F.reverse(F.transform(marks, lambda m: F.when(m["kind"] < len(QUICK), -m["start"]).otherwise(F.lit(LEAST))))
        )
        return F.arrays_zip(marks.alias("mark"), ends.alias("ended"), F.reverse(starts).alias("begins"))

    known = once(F.array_sort(F.concat(candidates, spans)), placed)
    free = F.filter(
        known,
        lambda k: (k["mark"]["kind"] == len(QUICK)) & (k["ended"] <= k["mark"]["start"]) & (-k["begins"] >= k["mark"]["end"]),
    )
    return F.when(F.size(strings) == 0, F.array().cast(SPAN)).otherwise(
        F.transform(free, lambda k: F.struct(k["mark"]["start"].alias("start"), k["mark"]["end"].alias("end"), k["mark"]["text"].alias("text")))
    )


def find_secrets(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov`` for every row.

    Positions are code points, the end exclusive. The character models add strings of 16
    or more characters whose ratio reaches ``least_ratio`` and that meet no span of a
    pattern. A null text is empty; an empty text has no span and the digest of the empty
    string; equal rows are reported alike; an empty table gives an empty result. There
    is no shuffle beside the bounded training sample.
    """
    ratios = train_ratios(docs, sample_docs)
    text = F.col("_text")
    found = docs.select("doc_id", row_text().alias("_text")).select(
        "doc_id",
        *[base_spans(text, kind).alias(f"_{kind}") for kind in QUICK],
        _where_found(text, CANDIDATE, match_spans(text, CANDIDATE)).alias("_long"),
    )

    def of_kind(column: str, kind: int) -> Column:
        return F.transform(
            column, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))
        )

    base = F.array_sort(F.concat(*[of_kind(f"_{k}", i) for i, k in enumerate(QUICK)]))
    random = F.filter("_long", lambda c: markov_ratio(c["text"], ratios) >= least_ratio)
    counted = found.withColumn("_base", base).withColumn("_random", random).withColumn("_likely", _apart("_random", "_base"))
    return counted.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in QUICK],
        F.sha2(_shown(F.col("_base")), 256).alias("base_sha256"),
        _shown(F.array_sort(F.concat("_base", of_kind("_likely", len(QUICK))))).alias("spans"),
        F.size("_likely").cast("long").alias("n_markov"),
    )
