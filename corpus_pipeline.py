"""From raw documents to shards of a training mix, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept;
all but the last return the columns of ``docs``. ``run`` writes every stage to the shared
folder and reads it back, so a later stage never recomputes an earlier one. No stage
drops rows for their size or frequency; null ids, sources and languages are kept as they
are, null and empty texts go with the first stage, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullspark.llm import decontaminate, jaccard, language_id, mixing, sharding, simhash
from lullspark.llm.common import stored, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or without one language for half of them."""
    return language_id.with_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates: fingerprints within three
    bits, or five-word shingles with a Jaccard similarity of 0.8 or more."""
    return simhash.one_of_each(docs, similar=jaccard.similar_texts(docs))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents of which at least one word in twenty is in a benchmark passage."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0, 1 or 2 times, always whole."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the column ``shard``; copies of a document share one."""
    return sharding.with_shard(docs)


STAGES = [
    ("language_id", languages),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", contamination),
    ("source_mixing", mixture),
    ("sharding", shards),
]

# The first stage decodes languages word by word with a trained model, which SQL cannot.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
