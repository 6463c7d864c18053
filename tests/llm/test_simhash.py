"""SimHash against a plain version: bits by definition, links by comparing all pairs."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from lakeward.llm import simhash
from lakeward.llm.components import connected_components

from llm_cases import AWKWARD, docs_of, small_docs  # noqa: F401


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    grams = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(values, distance=2):
    """Smallest id reachable; values are (id, fingerprint)."""
    group = {i: i for i, _ in values}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in values:
        for j, b in values:
            if bin(a ^ b).count("1") <= distance:
                x, y = top(i), top(j)
                group[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in values}


def test_matches_the_plain_version_on_the_table(small_docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(small_docs).collect()}
    texts = [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect()]
    values = [(i, plain_fingerprint(t)) for i, t in texts]
    expected = plain_components(values)
    assert len(got) == len(texts)
    for i, fp in values:
        assert got[i].fingerprint == f"{fp:016x}"
        assert got[i].component_id == expected[i]


def test_awkward_rows(docs_of):
    found = simhash.near_duplicates(docs_of(AWKWARD)).collect()
    assert len(found) == len(AWKWARD)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert {by_id[i].fingerprint for i in (1, 2, 3)} == {"0" * 16}
    assert {by_id[i].component_id for i in (1, 2, 3)} == {1}
    assert by_id[5].component_id == by_id[6].component_id == 5
    assert by_id[10].component_id == 9
    for i, text in AWKWARD:
        if i is not None:
            assert by_id[i].fingerprint == f"{plain_fingerprint(text):016x}"


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_hash_is_the_one_spark_has(spark):
    text = "añb c d"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("distance, segments", [(2, 2), (3, 2), (2, 3), (0, 1), (5, 4), (1, 2)])
def test_links_are_exactly_the_close_pairs(spark, distance, segments):
    random.seed(distance * 10 + segments)
    values = {0, (1 << 64) - 1}
    for _ in range(40):
        base = random.getrandbits(64)
        values.add(base)
        for flips in range(1, 7):
            values.add(base ^ sum(1 << b for b in random.sample(range(64), flips)))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    frame = spark.createDataFrame(signed, "fp long")
    got = {(r.fp, r.other) for r in simhash.links(frame, distance, segments).collect()}
    expected = {
        (a[0], b[0])
        for a in signed
        for b in signed
        if a < b and bin((a[0] ^ b[0]) & ((1 << 64) - 1)).count("1") <= distance
    }
    assert got == expected


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    random.seed(1)
    random.shuffle(edges)
    frame = spark.createDataFrame([*edges, (None, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(frame, "a", "b").collect()}
    expected = {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in (200, 201, 202)}
    assert got == expected
