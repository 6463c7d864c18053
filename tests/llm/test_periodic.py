"""Periodic runs against a plain version that tries every period at every place."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeward.llm import periodic
from lakeward.llm.queries import QUERIES

from llm_cases import AWKWARD, SMALL, docs_of, small_docs  # noqa: F401


def plain_runs(words, least=24, exponent=3):
    """All runs by definition: for each period, maximal stretches, the smallest period of each kept."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, exponent * q):
                part = words[i : i + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def coded(words):
    numbers = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)


def plain_planted(doc_id, text):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def plain_row(doc_id, text):
    words = plain_planted(doc_id, text)
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] * 10**12 // r[2], r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


def sequences():
    rng = random.Random(11)
    yield [], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 5000
    for alphabet in (1, 2, 3, 5, 50, 1000):
        for _ in range(30):
            words = []
            for _ in range(rng.randint(1, 6)):
                block = [rng.randrange(alphabet) for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 8, 11, 12, 13, 17, 24, 40, 47, 48, 95]))]
                if rng.random() < 0.4:  # a period that is itself periodic in part
                    block = block + [block[0]] * rng.randint(1, 60)
                times = rng.uniform(1, 9)
                words += (block * 10)[: int(len(block) * times)]
                words += [rng.randrange(alphabet) for _ in range(rng.randint(0, 30))]
            yield (words,)
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    yield (list(fib[-1]), list(fib[-1]) * 3, list("aab" * 30 + "ab" * 40 + "aab" * 30))


@pytest.mark.parametrize("together", [False, True])
def test_finds_exactly_the_runs(together):
    texts = [list(map(str, words)) for group in sequences() for words in group]
    arrays = [coded(t) for t in texts]
    got = periodic.find(arrays) if together else [periodic.find([a])[0] for a in arrays]
    assert sum(map(len, got)) > 200
    for words, array, runs in zip(texts, arrays, got):
        if len(words) < 1500:
            assert runs == plain_runs(array.tolist()), words
    assert got[4] == [(0, 5000, 1)]


def test_other_limits():
    words = list("abcdefgh" * 5)
    assert periodic.find([coded(words)], 30, 4) == [[(0, 40, 8)]] and periodic.find([coded(words)], 30, 6) == [[]]
    with pytest.raises(ValueError):
        periodic.find([], 10, 3)


def test_query_matches_the_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_runs"](spark, SMALL).collect()}
    short = [r for r in docs if len((r.text or "").split()) < 700]
    assert len(got) == len(docs) and len(short) > 150
    for r in short:
        assert got[r.doc_id] == plain_row(r.doc_id, r.text)
    assert any(row[1] for row in got.values())


def test_awkward_rows(spark, docs_of):
    rows = [r for r in AWKWARD if r[0] != 9] + [(20, "x " * 30), (None, "x " * 30), (10, "a b " * 40)]
    rows += [(h, "w1 w2 w3 w4 w5 w6") for h in range(30, 60)]
    frame = docs_of(rows).withColumn("runs", F.lit(1)).withColumn("best", F.lit(2)).withColumn("_words", F.lit(3))
    got = periodic.digests(periodic.find_runs(periodic.with_planted_runs(frame))).collect()
    long = {10, 9}
    expected = [plain_row(i, t) for i, t in rows if i not in long]
    assert sorted(map(repr, (tuple(r) for r in got if r.doc_id not in long))) == sorted(map(repr, expected))
    assert len(got) == len(rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)


def test_empty_table(docs_of):
    assert periodic.digests(periodic.find_runs(docs_of([]))).count() == 0


def test_texts_and_spans(docs_of):
    row = periodic.find_runs(docs_of([(1, "start " + "one two\tthree  " * 9 + "end")])).first()
    assert [tuple(r) for r in row.runs] == [(1, 27, 3)] and row.n_words == 29
    assert row.collapsed == "start one two three end"


def test_a_very_long_text_is_linear(docs_of):
    words = [f"w{i % 6000}" for i in range(400_000)]
    row = periodic.find_runs(docs_of([(1, " ".join(words)), (2, "a " * 300_000)])).collect()
    assert [tuple(x) for x in row[0].runs] == [(0, 400_000, 6000)]
    assert [tuple(x) for x in row[1].runs] == [(0, 300_000, 1)]
