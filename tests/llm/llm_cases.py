"""Awkward rows for every operator on documents, and fixtures that make frames of them."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents frame of ``(doc_id, text)`` or ``(doc_id, text, lang)`` rows."""

    def make(rows):
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1]))
            for r in rows
        ]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")



@pytest.fixture(scope="session")
def plan_of_frame():
    return lambda frame: frame._jdf.queryExecution().executedPlan().toString()


LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "ONE Two"),
    (7, "ñandú é ß 漢字 🦖"), (8, "123 ... !!!"), (9, LONG), (10, LONG), (10, LONG),
    (None, "no id at all here"), (None, None), (11, "a" * 2000), (12, "▁x ▁"),
]
