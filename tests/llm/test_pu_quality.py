"""Positive-unlabelled learning: the prior, held-out accuracy, awkward rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeward.llm import quality
from lakeward.llm.queries import QUERIES

from llm_cases import AWKWARD, docs_of  # noqa: F401

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_prior_and_scores_on_known_mixtures(prior):
    rng = np.random.default_rng(int(prior * 10))

    def good(n):
        return rng.normal(1.5, 1, (n, quality.FEATURES))

    def bad(n):
        return rng.normal(-1.5, 1, (n, quality.FEATURES))

    n_good = int(2000 * prior)
    unlabelled = np.concatenate([good(n_good), bad(2000 - n_good)])
    model = quality.train(good(1000), unlabelled)
    assert abs(model.prior - prior) < 0.08
    assert (model.score(good(300)) >= 0.5).mean() > 0.97
    assert (model.score(bad(300)) < 0.5).mean() > 0.97


def test_held_out_accuracy_on_the_table(spark):
    out = QUERIES["op3_quality"](spark, FOLDER)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    truth = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    rows = out.join(truth.where("quality is not null"), "doc_id").where("held_out").collect()
    assert len(rows) > 1000
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == 0 for r in bad) / len(bad) > 0.9
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_awkward_rows(docs_of, spark):  # noqa: F811
    docs = docs_of([*AWKWARD, *((100 + i, f"good text number {i}, as usual.") for i in range(40))]).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(100 + i, 1 if i % 2 else None) for i in range(40)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(AWKWARD) + 40
    assert all(0 <= r.score <= 1 and np.isfinite(r.score) for r in rows)
    scores = {r.doc_id: r.score for r in rows}
    assert scores[1] == scores[2]


def test_no_labels_and_empty_tables(docs_of, spark):  # noqa: F811
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs_of([(1, "text")]), labels)
    assert [r.score for r in quality.score(docs_of([(1, "text")]), model).collect()] == [0.5]
    assert quality.score(docs_of([]), quality.fit(docs_of([]), labels)).count() == 0
