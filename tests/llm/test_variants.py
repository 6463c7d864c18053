"""Spelling variants against a plain version that compares all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeward.llm import variants
from lakeward.llm.queries import QUERIES

from llm_cases import AWKWARD, SMALL, docs_of, plan_of_frame, small_docs  # noqa: F401


def plain_near(a, b):
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_groups(counts, least_length=6, least_count=5, ratio=5):
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    near = {
        w: [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(size, []) if plain_near(w, v)]
        for w in words
    }
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return counts


def groups_of(spark, counts, **limits):
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {tuple(r) for r in variants.group_variants(frame, **limits).collect()}


def test_query_matches_the_plain_version(spark, small_docs):
    rows = [tuple(r) for r in small_docs.select("doc_id", "text").collect()]
    expected = plain_groups(plain_counts(rows))
    got = [tuple(r) for r in QUERIES["op12_variants"](spark, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert any(r[1] for r in got) and any(r[4] > 1 for r in got)


def test_counts_match_the_plain_version(docs_of):
    rows = [(i, t) for i, t in AWKWARD] + [(k, "Árbol ARBOLES árbolesÀ×÷x ſtrange ﬁsh-tail déjà-vu") for k in range(400)]
    got = {r.word: r.n for r in variants.count_words(docs_of(rows), change=variants.drop_letters).collect()}
    assert got == {w: n for w, n in plain_counts(rows).items() if len(w) >= 6}


def test_random_words_rows_of_equal_letters_and_chains(spark):
    rng = random.Random(12)
    counts = {}
    for alphabet, size in (("ab", 9), ("abcé", 8), ("aÿ", 14)):
        for _ in range(250):
            word = "".join(rng.choice(alphabet) for _ in range(rng.randint(5, size)))
            counts[word] = rng.choice([1, 4, 5, 6, 7, 25, 26, 130, 700, 4000, 20_000])
    for k in range(1, 9):  # a chain of forms, each five times commoner
        counts["q" * (8 + k)] = 5**k
    got = groups_of(spark, counts)
    assert got == plain_groups(counts)
    assert ("q" * 9, "q" * 10, "q" * 16, 5, 1, 25) in got
    other = groups_of(spark, counts, least_length=8, least_count=7, ratio=2)
    assert other == plain_groups(counts, 8, 7, 2)


def test_long_words_meet_across_the_written_out_limit(spark):
    rng = random.Random(4)
    counts = {}
    for size in (62, 63, 64, 65, 66, 67, 300):
        for base in ("".join(rng.choice("abc") for _ in range(size)), "a" * size):
            counts[base] = rng.randint(5, 10_000)
            for _ in range(4):
                at = rng.randrange(size)
                counts[base[:at] + base[at + 1 :]] = rng.randint(5, 10_000)
                counts[base[:at] + "x" + base[at + 1 :]] = rng.randint(5, 10_000)
                counts[base[:at] + rng.choice("abx") + base[at:]] = rng.randint(5, 10_000)
    assert groups_of(spark, counts) == plain_groups(counts)


def test_a_very_long_word(spark):
    word = "ab" * 30_000
    counts = {word: 100, word[:-1]: 10, word + "c": 9, "c" + word[1:]: 3}
    got = {(len(r[0]), r[1] == word, r[4]) for r in groups_of(spark, counts)}
    assert got == {(60_000, False, 2), (59_999, True, 1), (60_001, True, 1)}


def test_the_largest_range_holds_every_letter(spark):
    letters = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
    counts = {f"word{c}ending": 10 + i for i, c in enumerate(letters)} | {"wordending": 5}
    assert groups_of(spark, counts) == plain_groups(counts)


def test_nulls_repeats_and_empty_tables(spark, docs_of):
    rows = [(None, 7), ("letters", None), ("letters", 3), ("letters", 4), ("letter", 70), ("", 9)]
    frame = spark.createDataFrame(rows, "word string, n long").withColumn("rank", F.lit(1)).withColumn("form", F.lit("x"))
    assert {tuple(r) for r in variants.group_variants(frame).collect()} == {
        ("letters", "letter", "letter", 7, 1, 70), ("letter", None, "letter", 70, 1, None),
    }
    assert variants.group_variants(variants.count_words(docs_of([]))).count() == 0
    assert variants.group_variants(variants.count_words(docs_of([(1, None), (2, "")]))).count() == 0
    with pytest.raises(ValueError):
        variants.group_variants(frame, ratio=1)


def test_plan_sorts_rotations_once(spark, plan_of_frame):
    frame = spark.createDataFrame([("letters", 9, 1)], "word string, n long, rank long")
    plan = plan_of_frame(variants._neighbours(frame))
    assert "rangepartitioning(range" in plan and "hashpartitioning(range" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
