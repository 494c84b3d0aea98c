"""The operators of this subpackage on the driver's tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullspark.llm import (
    centroids,
    decontaminate,
    exact_dedup,
    katz,
    language_id,
    merkle,
    mixing,
    neighbours,
    secrets_scan,
    sharding,
    simhash,
    warc,
)
from lullspark.llm.common import table
from lullspark.llm.url_filter import host_of, judge_urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The rules of the URL query, and the host labels of reported pages.
RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]
REPORTED = r"(^|\.)(spam-farm|cheap-pills)\."


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rules and every canonical URL of a reported host, against all pages."""
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    reported = pages.where(host_of(F.col("url")).rlike(REPORTED)).select("url")
    return judge_urls(pages, rules, reported)


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("hits", "items", "text_hash")


@query
def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query
def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"))


@query
def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.find_secrets(table(spark, sf_dir, "documents"))


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents")).drop("spans", "text_hash")


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("url")


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id divisible by 20 against all other rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(vectors.where(F.col("vec_id") % 20 == 0), vectors)


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("n_exact")


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
