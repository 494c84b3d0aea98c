"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Within its source the rows are ranged by the key's
leading digits and sorted by the whole key; word counts are summed up in two levels,
so a source of any size is spread over many tasks. Each source is cut where its
budget ends; a budget above the source's size repeats whole epochs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullspark.llm.common import WORD, as_rows, numbered, row_text, stored

WEIGHTS = (5, 2, 1)
# Hexadecimal digits of the key that make a range: 4096 ranges for each source.
RANGE_DIGITS = 3
# Chunks in which equal ids at a cut are numbered.
CHUNKS = 256
GROUP = ["_named", "_name"]


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target words of each source, from ``_named, _name, source_size``.

    Sources by code point, null last, take the weights in turn. Targets follow the
    weights up to ``most`` times the source's size; what exceeds that is shared anew
    among the others. The level reached is found in one pass: sorted by the level at
    which they fill up, the first source that does not fill fixes it. The windows
    without a key run over one row per source.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.desc("_named"), "_name")) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))))
    filled = Window.orderBy("_full", F.desc("_named"), "_name").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("_weight", weight)
        .withColumn("_most", F.col("source_size") * F.lit(float(most)))
        .withColumn("_full", F.col("_most") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_rest", F.col("_all") - F.coalesce(F.sum("_most").over(filled), F.lit(0.0)))
        .withColumn(
            "_others",
            F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(filled), F.lit(0.0)),
        )
        .withColumn("_level", F.col("_rest") / F.col("_others"))
    )
    unfilled = F.when(F.col("_level") <= F.col("_full"), F.col("_level"))
    place_filled = F.struct("_full", ~F.col("_named"), "_name")
    fixed = F.min_by(unfilled, F.when(unfilled.isNotNull(), place_filled))
    reached = ranked.withColumn("_reached", fixed.over(everything))
    target = F.least("_most", F.coalesce(F.col("_reached"), F.lit(float("inf"))) * F.col("_weight"))
    return reached.select(*GROUP, "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, copies``, one row per document.

    ``taken`` counts the words that the mix takes of a document over all epochs; the
    document at the cut gives only the words that are left, so a source meets its
    rounded target exactly. ``copies`` is the same in whole documents (the one at the
    cut counts if at least half of it fits). Order within a source is that of
    ``md5(doc_id)``, so reruns agree; equal ids are ordered by size. A null text has
    size 0 and is never taken; a null source is a source of its own, after all
    others; an empty table gives an empty result.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = stored(
        docs.select(
            "doc_id",
            "source",
            F.col("source").isNotNull().alias("_named"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_name"),
            word_count(row_text()).alias("size"),
            key.alias("_key"),
        ),
        "mix",
    ).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    ranges = rows.groupBy(*GROUP, "_range").agg(F.sum("size").alias("_words"))
    sizes = ranges.groupBy(*GROUP).agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    earlier = Window.partitionBy(*GROUP).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("_start", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).join(targets, GROUP)
    within = (
        Window.partitionBy(*GROUP, "_range").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    cut = (
        placed.join(starts.drop("_words"), [*GROUP, "_range"])
        .withColumn("_epochs", epochs)
        .withColumn("_left", budget - F.col("_epochs") * F.col("source_size") - F.col("_start") - F.col("_before"))
        .withColumn("_part", F.least("size", F.greatest(F.lit(0), "_left")))
    )
    half = (F.col("size") > 0) & (F.col("_part") * 2 >= F.col("size"))
    return cut.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("_epochs") * F.col("size") + F.col("_part")).alias("taken"),
        F.when(F.col("size") > 0, F.col("_epochs") + half.cast("long")).otherwise(0).alias("copies"),
    )


def mixed_documents(docs: DataFrame, **settings: float) -> DataFrame:
    """The rows of ``docs``, each as often as ``copies`` says, with their columns.

    Documents with the same id are told apart by source and size. Among those equal in
    all three, the copies go in the order of their texts' hashes; their numbers differ by
    one at most, and only in the group that a source's cut falls into.
    """
    group = ["doc_id", "source", "size"]
    copies = stored(
        mix(docs, **settings)
        .groupBy(*group)
        .agg(F.min("copies").alias("least"), (F.sum("copies") - F.min("copies") * F.count(F.lit(1))).alias("more"))
        .where("least > 0 OR more > 0"),
        "mix-copies",
    )
    d = as_rows(docs).withColumn("words", word_count(row_text("row.text"))).alias("d")
    c = copies.alias("c")
    same = (
        F.col("d.row.doc_id").eqNullSafe(F.col("c.doc_id"))
        & F.col("d.row.source").eqNullSafe(F.col("c.source"))
        & (F.col("d.words") == F.col("c.size"))
    )

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        several = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
        return several.select("row.*")

    whole = repeated(d.join(c.where("more = 0"), same), F.col("c.least"))
    if not copies.where("more > 0").limit(1).count():
        return whole
    cut = d.join(c.where("more > 0"), same).select(
        "d.row",
        "c.least",
        "c.more",
        F.xxhash64("c.doc_id", "c.source", "c.size").alias("alike"),
        F.xxhash64(row_text("d.row.text")).alias("hash"),
    )
    chunked = cut.withColumn("chunk", F.pmod("hash", F.lit(CHUNKS)))
    placed = numbered(chunked, ["alike"], "chunk", ["hash"], "place")
    extra = (F.col("place") < F.col("more")).cast("long")
    return whole.unionByName(repeated(placed, F.col("least") + extra))
