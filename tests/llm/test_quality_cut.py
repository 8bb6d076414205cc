"""The fitted cut of the quality rules."""

import random

import pytest

import corpus_pipeline
from riskloom.llm import quality_rules

SF = "/root/testdata/sf0.01"


def test_clean_texts_of_every_language_are_kept(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    ratio, cut = quality_rules.fit(docs, labels)
    rows = {x["doc_id"]: x for x in quality_rules.judge(docs, ratio, cut).collect()}
    assert all(rows[i]["kept"] for i in (498, 551, 636, 719, 910, 950))
    # Between -0.5 and -1 there is no text; junk lies below.
    assert all(x["kept"] == (x["ratio"] > -0.75) for x in rows.values() if not x["base_failed"])
    kept = {x["doc_id"] for x in corpus_pipeline.quality(spark, docs, SF).select("doc_id").collect()}
    assert kept == {i for i, x in rows.items() if x["kept"]}


def test_cut_of_trusted_and_untrusted_rows():
    assert quality_rules.best_cut({(-200, False): 3, (-50, True): 1, (10, True): 90}) == pytest.approx(-1.245)
    assert quality_rules.best_cut({(-50, True): 1, (10, True): 90}) == -0.5
    assert quality_rules.best_cut({(-50, False): 1}) == float("-inf")
