"""Retrieval against exhaustive BM25, leaks against n-gram overlap of all passages."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from lakeward.llm import decontaminate as d
from lakeward.llm.queries import QUERIES

from llm_cases import AWKWARD, SMALL, docs_of  # noqa: F401


def index_of(items):
    words = [d.words_of(i.question) + d.words_of(i.answer) for i in items]
    frequency = Counter(w for ws in words for w in set(ws))
    return d.Index(items, frequency, len(items), sum(map(len, words)) / len(words))


def shares(items, passage):
    """BM25 share of every item for a passage, term by term."""
    words = [d.words_of(i.question) + d.words_of(i.answer) for i in items]
    n, mean = len(items), sum(map(len, words)) / len(words)
    out = {}
    for item, ws in zip(items, words):
        got = whole = 0.0
        for w, c in Counter(ws).items():
            df = sum(w in set(o) for o in words)
            weight = np.log(1 + (n - df + 0.5) / (df + 0.5)) * c * (d.K1 + 1) / (c + d.K1 * (1 - d.B + d.B * len(ws) / mean))
            whole += weight
            got += weight * (w in passage)
        out[item.item_id] = got / whole
    return out


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.7])
def test_wand_retrieves_all_above_the_threshold_and_nothing_else(threshold):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [d.Item(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25))), None) for k in range(70)]
    index = index_of(items)
    for _ in range(40):
        passage = set(rng.sample(vocabulary, rng.randint(1, 30)))
        terms = sorted(index.terms[w] for w in passage if w in index.terms)
        got = {index.items[n].item_id: s for n, s in index.retrieve(terms, np.arange(index.blocks), threshold)}
        expected = {i: s for i, s in shares(items, passage).items() if s >= threshold}
        assert got.keys() == expected.keys()
        assert all(abs(got[i] - expected[i]) < 1e-6 for i in got)


def plain_leaks(texts, items):
    """(doc, item) where the document holds enough of the item's n-grams; items in one passage."""
    out = set()
    for doc, text in texts:
        held = d.grams(d.words_of(text))
        for item, question in items:
            wanted = d.grams(d.words_of(question))
            if wanted and len(wanted & held) / len(wanted) >= d.OVERLAP:
                out.add((doc, item))
    return out


def test_query_equals_overlap_by_definition(spark):
    got = QUERIES["op6_decontaminate"](spark, SMALL).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert {(r.doc_id, r.item_id) for r in got} == plain_leaks(texts, items)
    assert got and all(r.score >= d.THRESHOLD and r.question_overlap >= d.OVERLAP for r in got)


QUESTION = "what is the name of the tallest mountain in the northern part of the old kingdom"
ANSWER = "the mountain is called karvendel peak after its first climber"


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, answer string")


def test_question_and_answer_both_count(spark, docs_of):  # noqa: F811
    items = items_frame(spark, [(1, QUESTION, ANSWER), (2, "an item that nobody ever quoted anywhere at all", None), (3, None, None), (None, "x y", None), (4, "", "!!")])
    filler = " ".join(f"filler{i}" for i in range(500))
    docs = docs_of(
        [
            (110, f"{filler} {QUESTION.upper()}?! {ANSWER} {filler}"),
            (111, f"{filler} {QUESTION} {filler}"),
            (112, f"{ANSWER} {filler}"),
            (113, "### ".join(f"{QUESTION} {ANSWER}".split())),
            (114, " ".join(reversed(f"{QUESTION} {ANSWER}".split()))),
            *AWKWARD,
        ]
    )
    found = d.find_leaks(docs, items, answer_col="answer").collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(110, 1), (113, 1)}
    assert all(r.answer_overlap == 1.0 for r in found)
    only = d.find_leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in only} == {(110, 1), (111, 1), (113, 1)}
    kept = d.clean_rows(docs, items, answer_col="answer")
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 2


@pytest.mark.parametrize("passages", [1, 3, 512])
def test_item_across_any_passage_border(spark, docs_of, monkeypatch, passages):  # noqa: F811
    monkeypatch.setattr(d, "_PASSAGES", passages)
    items = items_frame(spark, [(1, QUESTION, None)])
    rows = [(k, " ".join([f"a{i}" for i in range(k)] + [QUESTION] + [f"b{i}" for i in range(300)])) for k in range(0, 400, 7)]
    found = d.find_leaks(docs_of(rows), items).collect()
    assert len(found) == len(rows) and all(r.first_word <= r.doc_id for r in found)


def test_shards_give_the_same_result(spark, monkeypatch):
    folder = SMALL
    whole = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontaminate"](spark, folder).collect()}
    monkeypatch.setattr(d, "SHARD", 7)
    cut = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontaminate"](spark, folder).collect()}
    assert cut == whole


def test_short_items_and_empty_tables(spark, docs_of):  # noqa: F811
    items = items_frame(spark, [(1, "Karvendel peak", None)])
    found = d.find_leaks(docs_of([(1, "the karvendel PEAK!"), (2, "peak karvendel"), (3, "karvendel")]), items).collect()
    assert [r.doc_id for r in found] == [1]
    assert d.find_leaks(docs_of([]), items).count() == 0
    assert d.find_leaks(docs_of([(1, "x")]), items_frame(spark, [])).count() == 0
    assert d.clean_rows(docs_of([(1, "x")]), items_frame(spark, [])).count() == 1


def test_item_quoted_without_its_rare_words(spark, docs_of):  # noqa: F811
    """24 common and 6 rare words without the last 4: overlap 0.846, under half of the weight."""
    common, rare = [f"common{i}" for i in range(24)], [f"rare{i}" for i in range(6)]
    rows = [(1, " ".join(common + rare), None)] + [(k, " ".join(common), None) for k in range(2, 200)]
    items = items_frame(spark, rows)
    found = d.find_leaks(docs_of([(1, " ".join((common + rare)[:-4])), (2, " ".join(common + rare))]), items).where("item_id = 1")
    got = {r.doc_id: r for r in found.collect()}
    assert got.keys() == {1, 2} and got[1].question_overlap >= d.OVERLAP and got[1].score < 0.5 and got[2].score == 1.0


@pytest.mark.parametrize("seed", range(6))
def test_no_overlap_is_lost_below_the_threshold(seed):
    """Cuts, gaps and replaced words in items of common and rare words, with and without an answer."""
    rng = random.Random(seed)

    def draw(n):
        return " ".join([f"c{rng.randrange(12)}" for _ in range(n - n // 6)] + [f"r{rng.randrange(5000)}" for _ in range(n // 6)])

    items = [d.Item(k, draw(rng.randint(1, 45)), draw(rng.randint(1, 30)) if k % 3 == 0 else None) for k in range(120)]
    words = [d.words_of(i.question) + d.words_of(i.answer) for i in items]
    frequency = Counter(w for ws in words for w in set(ws))
    index = d.Index(items, frequency, len(items), sum(map(len, words)) / len(words), d.THRESHOLD, d.OVERLAP)
    low = 0
    for item in items:
        for _ in range(8):
            parts = []
            for text in (item.question, item.answer):
                ws = d.words_of(text)
                if rng.random() < 0.5:
                    cut = rng.randint(0, len(ws) // 5)
                    ws = ws[cut:] if rng.random() < 0.5 else ws[: len(ws) - cut]
                elif ws:
                    ws[rng.randrange(len(ws))] = "other"
                parts += ws
            held = d.grams(parts)
            expected = set()
            for other in items:
                shares_held = [
                    index._held(d.grams(d.words_of(t)), held, parts) for t in (other.question, other.answer)
                ]
                if all(s is None or s >= d.OVERLAP for s in shares_held):
                    expected.add(other.item_id)
            got = {i: score for i, score, *_ in index.leaks(" ".join(parts), d.THRESHOLD, d.OVERLAP)}
            assert got.keys() == expected
            low += sum(score < d.THRESHOLD for score in got.values())
    assert low


def test_least_share_against_all_sets_of_missing_grams():
    from itertools import combinations

    rng = random.Random(5)
    for _ in range(60):
        ws = rng.choices("abcdefghijkl", k=rng.randint(5, 14))
        weights = {w: rng.random() for w in ws}
        wanted = d.grams(ws)
        bound = d.least_share(weights, [wanted, set()], 0.7)
        for n in range(len(wanted) + 1):
            if (len(wanted) - n) / len(wanted) >= 0.7:
                for gone in combinations(wanted, n):
                    held = {w for g in wanted - set(gone) for w in g}
                    assert sum(weights[w] for w in held) / sum(weights.values()) >= bound - 1e-9


def test_block_maxima_bound_the_shards(spark, monkeypatch):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    monkeypatch.setattr(d, "INDEX_BYTES", 20_000)
    shards = list(d.build_indexes(items))
    assert len(shards) > 1 and all(s.block_max.nbytes <= 20_000 or len(s.items) == 1 for s in shards)
