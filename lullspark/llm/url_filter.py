"""URL filters: a blocked Bloom filter in front of an exact join.

The list holds rules (host and path prefix) and single canonical URLs under one kind of
key. A URL has one key for each rule shape in use (labels of its host, characters of
its path) and one for its canonical form. A split-block Bloom filter, itself a table
with one row per 512-bit block, stops almost all keys that are not listed; the exact
join on the key removes its false positives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullspark.llm.common import ascii_lower

BITS_PER_KEY = 16
BLOCK_BITS = 512
WORDS = 8
# Query parameters that do not change the page; plain names of common trackers.
TRACKING = "(utm_[a-z]+|ref|gclid|fbclid)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without `www.`, `m.` and default port, path without index page and last
    slash, remaining parameters in order; null if there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)")))
    shown = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, shown))


def _block_masks(blocks: int) -> list[Column]:
    """The block of ``key`` and one bit in each of its eight 64-bit words."""
    bit = "shiftleft(1L, cast(shiftrightunsigned(xxhash64(key, 1), {}) & 63 as int))"
    words = [F.expr(bit.format(6 * i)) for i in range(WORDS)]
    return [F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *[w.alias(f"m{i}") for i, w in enumerate(words)]]


def bloom_filter(listed: DataFrame, bits_per_key: int = BITS_PER_KEY) -> tuple[DataFrame, int]:
    """The filter of the column ``key`` as a table ``block, w0..w7``, and its number of blocks.

    Masks of a block combine by a bitwise or before and after one shuffle. The table has
    at most one row per key; whether it is broadcast or shuffled follows from its size.
    """
    blocks = max(1, math.ceil(listed.count() * bits_per_key / BLOCK_BITS))
    masks = listed.select(*_block_masks(blocks))
    return masks.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def possible_hits(keys: DataFrame, listed: DataFrame, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """The rows of ``keys`` whose ``key`` passes the filter: all that are listed, few others."""
    bloom, blocks = bloom_filter(listed, bits_per_key)
    inside = F.lit(True)
    for i in range(WORDS):
        inside &= F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}")
    return keys.select("*", *_block_masks(blocks)).join(bloom, "block").where(inside).select(*keys.columns)


def url_list(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``key, rule, rule_verdict`` from ``rule, verdict`` and listed ``url`` rows.

    Of equal rules the one that allows stays. A URL without a host is not listed.
    """
    by_rule = rules.where("rule is not null").groupBy("rule").agg(F.min("verdict").alias("rule_verdict"))
    single = urls.select(canonical_url(F.col("url")).alias("_url")).where("_url is not null").distinct()
    return by_rule.select(F.concat(F.lit("r:"), "rule").alias("key"), "rule", "rule_verdict").unionByName(
        single.select(
            F.concat(F.lit("u:"), "_url").alias("key"),
            F.lit(None).cast("string").alias("rule"),
            F.lit(None).cast("string").alias("rule_verdict"),
        )
    )


def url_keys(pages: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """``page_id, url, key``: a key for each shape that the URL is long enough for."""
    host, path = F.col("_host"), F.col("_path")
    labels = F.split(host, r"\.")
    keys = [F.concat(F.lit("u:"), canonical_url(F.col("url")))]
    for count, length in shapes:
        suffix = F.array_join(F.slice(labels, F.greatest(F.size(labels) - count + 1, F.lit(1)), count), ".")
        fits = (F.size(labels) >= count) & (F.char_length(path) >= length)
        keys.append(F.when(fits, F.concat(F.lit("r:"), suffix, F.substring(path, 1, length))))
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("_host"), path_of(F.col("url")).alias("_path"))
    return parsed.where("_host <> ''").select(
        "page_id", "url", F.explode(F.array_compact(F.array(*keys))).alias("key")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, urls: DataFrame, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for every row of ``pages``.

    A rule ``host/path`` fits its host and all subdomains if the path starts with the
    rule's. The longest rule that fits decides (equal length: the longer host). Else a
    URL whose canonical form is listed is blocked, and any other allowed. Rules take
    part through the number of labels and the path length they have; those shapes,
    which a URL's length bounds, are all that the driver gets to see. A null URL, or one
    without ``://``, has an empty host and path and is allowed; repeated rows are
    judged alike.
    """
    slash = F.instr("rule", "/")
    shapes = [
        (r["labels"], r["length"])
        for r in rules.where("rule like '%/%'")
        .select(
            F.size(F.split(F.substring_index("rule", "/", 1), r"\.")).alias("labels"),
            (F.char_length("rule") - slash + 1).alias("length"),
        )
        .distinct()
        .collect()
    ]
    listed = url_list(rules.where("rule like '%/%'"), urls)
    keys = url_keys(pages.select("page_id", "url").distinct(), sorted(shapes))
    hits = possible_hits(keys, listed, bits_per_key).join(listed, "key")
    by_length = F.struct(F.char_length("rule"), F.instr("rule", "/"), "rule")
    found = hits.groupBy("page_id", "url").agg(
        F.max_by("rule", F.when(F.col("rule").isNotNull(), by_length)).alias("rule"),
        F.max_by("rule_verdict", F.when(F.col("rule").isNotNull(), by_length)).alias("rule_verdict"),
        F.bool_or(F.col("rule").isNull()).alias("listed"),
    )
    rows = pages.select("page_id", "url").alias("p")
    same = F.col("p.page_id").eqNullSafe(F.col("f.page_id")) & F.col("p.url").eqNullSafe(F.col("f.url"))
    is_listed = F.coalesce("f.listed", F.lit(False))
    return rows.join(found.alias("f"), same, "left").select(
        "p.page_id",
        host_of(F.col("p.url")).alias("host"),
        path_of(F.col("p.url")).alias("path"),
        "f.rule",
        F.coalesce("f.rule_verdict", F.when(is_listed, "block").otherwise("allow")).alias("verdict"),
        is_listed.alias("listed"),
    )
