"""The byte network: windows lose nothing, folding equals convolution, held-out accuracy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lakeward.llm import language
from lakeward.llm.queries import QUERIES

from llm_cases import AWKWARD, docs_of  # noqa: F401


def test_windows_hold_every_run_of_bytes():
    for size in (1, 3, 4, 5, 255, 256, 257, 253 * 2 + 3, 1000, 5000):
        text = np.random.default_rng(size).integers(1, 255, size).astype(np.uint8)
        rows, sizes = language.windows(text)
        held = {r[i : i + 4].tobytes() for r, n in zip(rows, sizes) for i in range(max(1, n - 3))}
        assert {text[i : i + 4].tobytes() for i in range(max(0, size - 3))} <= held
        assert rows.shape[1] == language.WINDOW and (sizes >= 1).all()


def test_pooled_responses_equal_a_plain_convolution():
    rng = np.random.default_rng(0)
    tables = rng.normal(size=(4, 256, 5)).astype(np.float32)
    net = language.Network(["a"], tables, np.zeros(5, np.float32), np.zeros((5, 1)), np.zeros(1))
    rows = rng.integers(0, 256, (37, language.WINDOW)).astype(np.uint8)
    wide = np.pad(rows, ((0, 0), (0, 3)))
    plain = np.zeros((37, 5))
    for w in range(37):
        for f in range(5):
            plain[w, f] = max(sum(tables[k, wide[w, p + k], f] for k in range(4)) for p in range(language.WINDOW))
    assert np.allclose(net.pooled(rows), np.maximum(plain, 0), atol=1e-5)


def test_training_is_repeatable_and_learns():
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.choice(list(b"abcd "), (60, 256)), rng.choice(list(b"wxyz "), (60, 256))]).astype(np.uint8)
    labels = np.repeat([0, 1], 60)
    one, two = (language.train(rows, labels, ["p", "q"]) for _ in range(2))
    assert all(np.array_equal(a, b) for a, b in ((one.tables, two.tables), (one.dense, two.dense)))
    assert one.predict([b"ab cd ad", b"ZZ xw", None, b"", b"12 !", "漢".encode()])[:2] == one.predict([b"ab cd ad", b"ZZ xw"])
    assert [a for a, _ in one.predict([b"ab cd ad", b"ZZ xw", None, b"", b"12 !"])] == ["p", "q", "und", "und", "und"]


def test_held_out_accuracy_on_the_table(spark):
    folder = "/root/testdata/sf0.01"
    out = QUERIES["op2_language"](spark, folder)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    kept = [r for r in rows if r.held_out]
    assert 150 < len(kept) < 350
    assert sum(r.lang == r.lang_pred for r in kept) / len(kept) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows_and_labels(docs_of):  # noqa: F811
    docs = docs_of([*AWKWARD, (20, "null label here", None)]).withColumn("score", F.lit("x"))
    network = language.fit(docs)
    assert network.languages == ["en"]
    rows = language.identify(docs, network).collect()
    assert len(rows) == len(AWKWARD) + 1
    by_id = {r.doc_id: r for r in rows}
    assert {by_id[i].lang_pred for i in (1, 2, 3, 8)} == {"und"}
    assert {by_id[i].lang_pred for i in (4, 7, 9, 11, 20)} == {"en"}


def test_empty_tables_and_nothing_learned(docs_of):  # noqa: F811
    none = language.fit(docs_of([]))
    assert none.languages == []
    assert language.identify(docs_of([]), none).count() == 0
    assert [r.lang_pred for r in language.identify(docs_of([(1, "some text")]), none).collect()] == ["und"]
