"""Token files: the library's ids, exact round trips, random access."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lakeward.llm import grammar
from lakeward.llm.queries import QUERIES
from lakeward.session import fresh_path

from llm_cases import AWKWARD, SMALL, docs_of  # noqa: F401

DEFINITION = grammar.tokenizer_definition()
LIBRARY = Tokenizer.from_str(DEFINITION)
ENCODER = grammar.Encoder(DEFINITION)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def ids_of(texts):
    return [np.frombuffer(b, ENCODER.kind).tolist() for b in ENCODER.encode(texts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'é1漢 .\n\t\r  🦖s<|>")), max_size=30), max_size=4))
def test_words_give_the_ids_of_the_whole_text(texts):
    assert ENCODER.by_word
    assert ids_of(texts) == [library_ids(t) for t in texts]


def test_special_strings_and_full_memory(monkeypatch):
    texts = ["<|endoftext|> a <|endoftext|>b", "x  y", None, "", " ", "new words every time"]
    expected = [library_ids(t) for t in texts]
    assert ids_of(texts) == expected
    monkeypatch.setattr(grammar, "REMEMBERED", 0)
    assert [np.frombuffer(b, ENCODER.kind).tolist() for b in grammar.Encoder(DEFINITION).encode(texts)] == expected


SEQUENCES = {
    "one symbol": [5] * 1000,
    "periodic": [1, 2, 3] * 500,
    "random": np.random.default_rng(0).integers(0, 50, 5000),
    "words": np.random.default_rng(1).zipf(1.5, 20_000) % 900,
    "short": [1],
    "empty": [],
    "fibonacci": [1, 2] + [0] * 0,
}


@pytest.mark.parametrize("name", sorted(SEQUENCES))
@pytest.mark.parametrize("symbols", [1000, 1003, 1 << 16])
def test_round_trip_and_random_access(name, symbols):
    ids = np.array(SEQUENCES[name], np.uint16)
    g = grammar.repair(ids, 1000, symbols)
    assert len(g.left) <= symbols - 1000
    assert np.array_equal(g.expand(g.sequence), ids)
    assert g.lengths(g.sequence).sum() == len(ids)
    for k in range(len(g.left)):  # every rule expands to its length, and is used
        assert len(g.expand(np.array([1000 + k], np.uint32))) == g.length[k]
    rng = np.random.default_rng(3)
    for a, b in np.sort(rng.integers(0, len(ids) + 1, (30, 2)), axis=1):
        assert np.array_equal(g.slice(a, b), ids[a:b])


def test_repeats_shrink():
    ids = np.array(SEQUENCES["periodic"], np.uint16)
    assert len(grammar.repair(ids, 1000).sequence) < len(ids) / 20


def expected_rows(texts):
    out, start = [], 0
    for doc, text in texts:
        ids = [*library_ids(text), 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_library(spark):
    out = QUERIES["op7_grammar"](spark, SMALL)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, out.collect())) == expected_rows(texts)


@pytest.mark.parametrize("block_ids", [1, 500, 1 << 21])
def test_awkward_rows_blocks_and_access(spark, docs_of, block_ids):  # noqa: F811
    path = fresh_path(spark, "ids")
    rows = [(i, t) for i, t in AWKWARD if i not in (None, 10)]
    grammar.write(docs_of(rows), path, DEFINITION, block_ids=block_ids)
    assert sorted(map(tuple, grammar.read(spark, path).collect())) == expected_rows(sorted(rows))
    whole = [i for _, t in sorted(rows) for i in [*library_ids(t), 0]]
    for a, b in ((0, 0), (0, 5), (3, 700), (len(whole) - 4, len(whole)), (0, len(whole))):
        assert grammar.read_ids(spark, path, a, b) == whole[a:b]


def test_repeated_and_missing_ids_and_empty_tables(spark, docs_of):  # noqa: F811
    path = fresh_path(spark, "ids")
    grammar.write(docs_of(AWKWARD), path, DEFINITION)
    rows = grammar.read(spark, path).orderBy("start").collect()
    assert len(rows) == len(AWKWARD)
    assert [r.doc_id for r in rows][-2:] == [None, None]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    grammar.write(docs_of([]), path, DEFINITION)
    assert grammar.read(spark, path).count() == 0
    assert grammar.read_ids(spark, path, 0, 10) == []
