"""The shuffle is a bijection that can be computed both ways; shards differ by at most one row."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from lakeward.llm import sharding
from lakeward.llm.queries import QUERIES

from llm_cases import AWKWARD, SMALL, docs_of, small_docs  # noqa: F401


@pytest.mark.parametrize("total", [1, 2, 3, 4, 5, 8, 15, 16, 17, 63, 64, 65, 1000, 4097])
def test_permutation(total):
    there = sharding.permute(np.arange(total), total)
    assert sorted(there) == list(range(total))
    assert list(sharding.unpermute(there, total)) == list(range(total))


def test_key_decides():
    a, b = (sharding.permute(np.arange(500), 500, key) for key in (1, 2))
    assert list(a) != list(b)
    assert list(a) == list(sharding.permute(np.arange(500), 500, 1))


def check(rows, total, shards):
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    for r in rows:
        assert sharding.row_number_at(r.shard, r.slot, total, shards) == r.row


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_whole_table(small_docs, shards):
    rows = sharding.assign(small_docs, shards=shards).collect()
    check(rows, len(rows), shards)
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    in_id_order = sorted(rows, key=lambda r: r.doc_id)
    assert [r.row for r in in_id_order] == list(range(len(rows)))


def test_awkward_rows_and_clashing_columns(docs_of):
    docs = docs_of(AWKWARD).withColumnRenamed("source", "shard").withColumnRenamed("lang", "row")
    rows = sharding.assign(docs).collect()
    assert len(rows) == len(AWKWARD)
    check(rows, len(rows), 8)
    null_text = [r for r in rows if r.doc_id == 1][0]
    assert (null_text.size, null_text.text_crc32) == (1, None)


def test_empty_table(docs_of):
    assert sharding.assign(docs_of([])).count() == 0


def test_query(spark):
    out = QUERIES["op9_sharding"](spark, SMALL)
    assert out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {r.law for r in out.select("law").collect()} == {"rows"}
