"""Repeated strings against looking up every string; the sort against sorted()."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lakeward.llm import suffixes as s
from lakeward.llm.queries import QUERIES

from llm_cases import AWKWARD, SMALL, docs_of  # noqa: F401


def plain(texts, length):
    """(bytes, removed, spans, hash of the rest) per text, from a count of all strings."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def solved(frame, **options):
    out = s.remove_repeats(frame, **options)
    return [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in out.collect()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=40) | st.text("ab\0", max_size=60).map(str.encode), min_size=1, max_size=30))
def test_blind_trie_sorts(strings):
    order, shared = s.blind_trie_sort(strings)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
    ordered = sorted(strings)
    assert shared == [-1, *(s.common(a, b) for a, b in zip(ordered, ordered[1:]))]
    for a, b in zip(ordered, ordered[1:]):
        k = s.common(a, b)
        assert a[:k] == b[:k] and a[k : k + 1] != b[k : k + 1] or a == b == a[:k]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab\0", max_size=70)), min_size=1, max_size=25))
def test_deep_shallow_sort(rows):
    strings = [b"same" + t.encode() for _, t in rows]
    groups = np.array([g for g, _ in rows])
    order, shared = s.deep_shallow_sort(strings, groups, 4)
    assert [(groups[i], strings[i]) for i in order] == sorted(zip(groups, strings))
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        assert shared[k] == (s.common(strings[a], strings[b]) if groups[a] == groups[b] else -1)


@pytest.mark.parametrize("size", [399, 400, 401, 1000, 5000])
@pytest.mark.parametrize("letters", [1, 2, 200])
def test_anchors_own_all_windows_and_depend_on_content_alone(size, letters, monkeypatch):
    rng = np.random.default_rng(size + letters)
    text = rng.integers(0, letters, size).astype(np.uint8).tobytes()
    keys, places, lasts = s.anchors(text)
    if size < 400:
        return
    assert lasts[-1] == size - 400 and (np.diff(lasts) > 0).all() and (np.diff(places) > 0).all()
    first = np.concatenate([[0], lasts[:-1] + 1])
    assert (places >= first).all() and (places + s.GRAM <= lasts + 400).all() and (places <= first + 400 - s.GRAM).all()
    for p in rng.integers(0, size - 399, 5):
        window = text[p : p + 400]
        key, place, _ = s.anchors(window)
        n = np.searchsorted(lasts, p)
        assert keys[n] == key[0] and places[n] == place[0] + p
    monkeypatch.setattr(s, "_CHUNK", 97)
    assert all(np.array_equal(a, b) for a, b in zip(s.anchors(text), (keys, places, lasts)))


def make_texts(seed, length):
    """Texts with shared passages around the length, near and exact copies, periodic runs, odd bytes."""
    rng = random.Random(seed)

    def fresh(n):
        return "".join(rng.choices("abcdefgh é\0\n", k=n))

    passages = [fresh(n) for n in (length - 1, length, length + 1, 2 * length, 5 * length)]
    texts = [fresh(rng.randint(0, 4 * length)) for _ in range(10)]
    for p in passages:
        for _ in range(3):
            texts.append(fresh(rng.randint(0, length)) + p + fresh(rng.randint(0, length)))
    base = fresh(6 * length)
    for _ in range(6):
        at = rng.randrange(len(base))
        texts.append(base[:at] + rng.choice("XYZ") + base[at + 1 :])
    texts += [base, base, "x" * (3 * length), "xy" * length, fresh(7) * length, passages[3] * 2, None, "", "x" * length]
    texts += ["z" + passages[2] + passages[3], passages[2] + passages[3]]
    return texts


@pytest.mark.parametrize("seed, length, gram", [(1, 40, 8), (2, 40, 8), (3, 100, 16), (4, 400, 64)])
@pytest.mark.parametrize("hot", [2000, 2])
def test_equals_looking_up_every_string(docs_of, seed, length, gram, hot):  # noqa: F811
    texts = make_texts(seed, length)
    got = solved(docs_of(list(enumerate(texts))), length=length, gram=gram, hot=hot)
    assert [v for _, v in sorted(got)] == plain(texts, length)


def test_batches_of_grams(docs_of, monkeypatch):  # noqa: F811
    texts = make_texts(9, 60)
    monkeypatch.setattr(s, "_BATCH", 3)
    got = solved(docs_of(list(enumerate(texts))), length=60, gram=10)
    assert [v for _, v in sorted(got)] == plain(texts, 60)


def test_awkward_rows(docs_of):  # noqa: F811
    got = solved(docs_of(AWKWARD))
    expected = plain([t for _, t in AWKWARD], 400)
    assert sorted(map(repr, got)) == sorted(repr((i, e)) for (i, _), e in zip(AWKWARD, expected))
    assert solved(docs_of([])) == []
    ids = [(None, "ab" * 300), (None, "ab" * 300), (5, "ab" * 300 + "c"), (5, "q" * 10)]
    got = solved(docs_of(ids))
    assert sorted(map(repr, got)) == sorted(repr((i, e)) for (i, _), e in zip(ids, plain([t for _, t in ids], 400)))


def test_query_on_the_table(spark):
    out = QUERIES["op5_suffixes"](spark, SMALL)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = sorted((r.doc_id, tuple(r)[1:]) for r in out.collect())
    expected = plain([t for _, t in texts], 400)
    assert got == [(i, e) for (i, _), e in zip(texts, expected)]
    assert sum(e[1] for e in expected) > 0


def test_spans_cut_the_text(spark, docs_of):  # noqa: F811
    texts = make_texts(5, 60)
    rows = s.remove_repeats(docs_of(list(enumerate(texts))), length=60, gram=10).collect()
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        edges = [0, *(x for ab in zip(r.starts, r.stops) for x in ab), len(text)]
        kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
        assert hashlib.sha256(kept).hexdigest() == r.kept_sha256 and len(text) - len(kept) == r.n_removed
