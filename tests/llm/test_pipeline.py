"""The pipeline against its stages done plainly, one after another."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeward.llm import language, pieces
from lakeward.llm.queries import QUERIES

from llm_cases import AWKWARD, SMALL, docs_of  # noqa: F401
from test_decontaminate import plain_leaks
from test_shingles import plain_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given = {r.doc_id: r.text for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "simhash_near_dedup", "decontamination", "pii", "sentencepiece"]

    first = steps["language_id"](spark, docs, SMALL)
    network = language.fit(docs.where(~language.held_out()))
    answers = dict(zip(given, network.predict([t.encode() for t in given.values()])))
    texts = {i: t for i, t in given.items() if answers[i][0] != "und" and answers[i][1] >= language.LEAST_SCORE}
    assert {r.doc_id: r.text for r in first.collect()} == texts and first.columns == COLUMNS

    second = steps["simhash_near_dedup"](spark, first, SMALL)
    component = plain_components(list(texts.items()))
    texts = {i: t for i, t in texts.items() if component[i] == i}
    assert {r.doc_id: r.text for r in second.collect()} == texts and second.columns == COLUMNS

    third = steps["decontamination"](spark, second, SMALL)
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    leaking = {doc for doc, _ in plain_leaks(list(texts.items()), items)}
    assert leaking
    texts = {i: t for i, t in texts.items() if i not in leaking}
    assert {r.doc_id: r.text for r in third.collect()} == texts and third.columns == COLUMNS

    fourth = steps["pii"](spark, third, SMALL)
    pseudonyms = {r.doc_id: r.text for r in QUERIES["op10_pii"](spark, SMALL).collect()}
    texts = {i: pseudonyms[i] for i in texts}
    rows = fourth.collect()
    assert {r.doc_id: r.text for r in rows} == texts and fourth.columns == COLUMNS
    assert all(r.n_chars == len(r.text) for r in rows)

    last = steps["sentencepiece"](spark, fourth, SMALL)
    codec = pieces.Codec(pieces.Vocabulary.load(pieces.vocabulary_path()))
    rows = last.collect()
    assert {r.doc_id: codec.decode(r.ids).decode() for r in rows} == texts and all(r.exact for r in rows)

    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.columns == [*COLUMNS, "ids", "exact"]
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, rows))


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")], AWKWARD])
def test_awkward_documents_in_every_stage(spark, docs_of, rows):  # noqa: F811
    docs = docs_of(rows).withColumn("score", F.lit(1)).withColumn("key", F.lit("x"))
    for _, step in corpus_pipeline.STAGES:
        before, docs = docs, step(spark, docs, SMALL)
        assert docs.count() <= before.count()
    assert docs.columns == [*COLUMNS, "score", "key", "ids", "exact"]
    kept = {r.doc_id for r in docs.collect()}
    assert kept == ({4, 5, 7, 9, 11, 12, None} if len(rows) > 2 else set())


def test_oracle_is_none_and_run_is_registered():
    import __spark_entry__ as entry

    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    numbers = [int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in entry.queries()) if m]
    assert sorted(numbers) == list(range(1, 14))
