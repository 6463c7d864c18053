"""Best segmentations against trying every piece at every place; exact round trips."""

from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lakeward.llm import pieces
from lakeward.llm.queries import QUERIES

from llm_cases import AWKWARD, SMALL, docs_of  # noqa: F401

CODEC = pieces.Codec(pieces.Vocabulary.load(pieces.vocabulary_path()))


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text), codec.kind).tolist()


def plain(vocabulary, text):
    """Ids of the best segmentation, by trying every piece at every place of the whole text."""
    scores = {p: (s, i) for p, i, s in vocabulary.pieces}
    fallback = min(s for s, _ in scores.values()) - pieces.PENALTY
    text = "▁" + text.replace("▁", "\x00").replace(" ", "▁")
    best = [(0.0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):  # longest first: ties stay with it
            piece = text[start:end]
            if piece in scores:
                score, ids = scores[piece][0], [scores[piece][1]]
            elif end - start == 1:
                score, ids = fallback, [vocabulary.byte_ids[b] for b in piece.replace("\x00", "▁").encode()]
            else:
                continue
            total = best[start][0] + score
            if best[end] is None or total > best[end][0]:
                best[end] = (total, best[start][1] + ids)
    return best[-1][1]


TEXTS = ["a  b", "   ", " lead", "trail ", "the and attion to", "ñ 🦖\n\t漢字", "▁x ▁", "x" * 30, "À é", "in in  in   in    "]


@pytest.mark.parametrize("text", TEXTS)
def test_best_segmentation(text):
    assert ids_of(CODEC, text) == plain(CODEC.vocabulary, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcABC  ▁é漢🦖\n.")), max_size=25))
def test_best_segmentation_of_any_text(text):
    if text:
        assert ids_of(CODEC, text) == plain(CODEC.vocabulary, text)
    assert CODEC.decode(ids_of(CODEC, text)) == text.encode()


@pytest.mark.parametrize("seed", range(8))
def test_small_vocabularies_with_ties_and_pieces_over_words(seed):
    rng = random.Random(seed)
    size = 256
    kinds = {"".join(rng.choices("ab▁", k=rng.randint(1, 4))) for _ in range(12)}
    made = tuple((p, size + n, float(-rng.randint(1, 4))) for n, p in enumerate(sorted(kinds)))
    vocabulary = pieces.Vocabulary(made, tuple(range(256)), size + len(made))
    codec = pieces.Codec(vocabulary)
    for _ in range(30):
        text = "".join(rng.choices("ab c", k=rng.randint(1, 14)))
        assert ids_of(codec, text) == plain(vocabulary, text)
        assert codec.decode(ids_of(codec, text)) == text.encode()


def test_whole_text_and_remembered_words_agree():
    text = " ".join(random.Random(1).choices(["the", "and", "thtion", "ñ", "", "x."], k=400))
    assert CODEC.encode(text) == CODEC._whole(text)


def test_library_decodes_the_ids():
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path())
    for text in ("the and attion to", "ñ 🦖", "Erinst resh. x"):
        assert library.decode(ids_of(CODEC, text)) == text


def test_query_and_decoding_of_the_table(spark):
    out = QUERIES["op8_pieces"](spark, SMALL)
    assert out.columns == ["doc_id", "n_pieces", "ids", "exact"]
    rows = out.collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r.exact and r.n_pieces == len(r.ids) for r in rows)
    back = pieces.decode(out, CODEC.vocabulary).collect()
    assert {r.doc_id: r.text for r in back} == texts
    short = min((r for r in rows if r.n_pieces > 20), key=lambda r: r.n_pieces)
    assert list(short.ids) == plain(CODEC.vocabulary, texts[short.doc_id])


def test_awkward_rows_and_kept_columns(docs_of):  # noqa: F811
    docs = docs_of(AWKWARD).withColumn("a b", F.lit(1.5))
    out = pieces.encode(docs, CODEC.vocabulary, keep=["source", "a b"])
    assert out.columns == ["doc_id", "source", "a b", "ids", "exact"]
    rows = out.collect()
    assert len(rows) == len(AWKWARD) and all(r.exact for r in rows)
    assert {len(r.ids) for r in rows if r.doc_id in (1, 2)} == {0}
    back = {(r.doc_id, r.text) for r in pieces.decode(out, CODEC.vocabulary).collect()}
    assert back == {(i, t or "") for i, t in AWKWARD}
    assert pieces.encode(docs_of([]), CODEC.vocabulary).count() == 0
