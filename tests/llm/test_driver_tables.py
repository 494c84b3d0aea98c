"""The queries on the smallest driver tables: against their SQL, held-out accuracy, the pipeline."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from lullspark.llm.oracle import ORACLE

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables absent")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        duck.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = entry_point.queries()[name](spark, SF_DIR)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == want


def test_language_accuracy(spark):
    found = entry_point.queries()["op7_language"](spark, SF_DIR).toPandas().set_index("doc_id")
    lang = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    held = found[found["held_out"]]
    assert (held["lang_pred"] == lang.loc[held.index, "lang"]).mean() > 0.95


def test_model_beats_base_on_held_out_texts(spark):
    found = entry_point.queries()["op4_katz"](spark, SF_DIR).toPandas()
    held = found[found["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_pipeline_runs_its_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == [*docs.columns, "shard"]
    assert "pipeline" in entry_point.queries()
    texts = dict(docs.select("doc_id", "text").collect())
    rows = out.collect()
    assert 0 < len(rows) and all(texts[r["doc_id"]] == r["text"] for r in rows)
