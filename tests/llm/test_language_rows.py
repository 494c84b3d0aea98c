"""Rows with a main language are filtered where they are read, in little memory."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from conftest import final_plan
from lullspark.llm import language_id

ENGLISH = "the house and the garden with water where they think that this will work "
GERMAN = "das haus und der garten mit wasser wo sie denken dass dieses gehen wird "
SCHEMA = "doc_id long, text string, lang string, source string, row string"


def documents(spark):
    rows = [(i, (ENGLISH if i % 2 else GERMAN) * 5, "en" if i % 2 else "de", "s", "r") for i in range(80)]
    odd = [(None, ENGLISH, "en"), (None, ENGLISH, "en"), (7, None, None), (8, "", "en"), (9, "12 34", "de"), (9, GERMAN, None)]
    rows += [(*d, None, None) for d in [*odd, (100, ENGLISH + GERMAN, None), (100, ENGLISH + GERMAN, None)]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_rows_are_kept_or_rejected_by_their_text(spark):
    docs = documents(spark)
    # Over half of the letters of the mixed text are English.
    for least in (0.5, 0.9):
        found = language_id.identify(docs).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
        kept = language_id.with_language(docs, least)
        assert kept.columns == docs.columns
        ids = sorted(str(r["doc_id"]) for r in kept.collect())
        assert ids == sorted(str(r["doc_id"]) for r in found.collect())
        assert ids.count("100") == (2 if least == 0.5 else 0) and ids.count("None") == 2
    assert language_id.with_language(docs.limit(0)).count() == 0


def test_no_row_is_shuffled(spark):
    docs = documents(spark).localCheckpoint()
    plan = final_plan(language_id.with_language(docs))
    assert "Exchange" not in plan and "Join" not in plan


def test_labelling_takes_little_memory():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(30_000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(300)]
    table = np.random.default_rng(3).normal(-9, 1, (language_id.BUCKETS, 4)).astype(np.float32)
    model = language_id.Model(list("abcd"), table, np.ones((len(language_id.SCRIPTS) + 1, 4), bool))
    tracemalloc.start()
    language_id.label_texts(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * sum(map(len, texts)), peak
