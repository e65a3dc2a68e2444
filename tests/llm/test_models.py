"""Held-out accuracy of the models that are trained here, on the test tables."""

import os

import pytest
from pyspark.sql import functions as F

from readloom.llm import langid, urls

DATA = "/root/testdata"


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.01"), reason="no test tables here")
def test_languages_of_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.learn(docs), keep=["doc_id", "lang"]).where(langid.held_out("row.doc_id") & F.col("row.lang").isNotNull())
    n, right = found.agg(F.count("*"), F.count(F.when(F.col("row.lang") == F.col("lang_pred"), 1))).first()
    assert n > 300 and right >= 0.98 * n


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/check_s"), reason="no test tables here")
def test_trees_beat_the_more_frequent_verdict_on_held_out_urls(spark):
    n, right, most = urls.held_out(spark.read.parquet(f"{DATA}/check_s/pages.parquet"))
    assert n > 500 and right > most


def test_language_samples_are_bounded_whatever_the_ids(spark):
    rows = [("same", "en" if k % 2 else "de", f"{'the and ing' if k % 2 else 'der und sch'} {k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "id string, lang string, text string")
    one, two = (langid.fit(docs.repartition(n), 20, 30) for n in (1, 7))
    assert one.pairs.keys() == two.pairs.keys() and all((one.pairs[k] == two.pairs[k]).all() for k in one.pairs)
