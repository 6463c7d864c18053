"""Embedding links against cosines of all pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from lakeward.llm import embeddings
from lakeward.llm.queries import QUERIES

from llm_cases import SMALL

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)


def usable(row):
    i, v, label = row
    if i is None or v is None or label is None or not len(v):
        return False
    return all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def plain(rows, threshold=embeddings.THRESHOLD):
    """(id, links, component, kept) per row, by comparing all pairs in double precision."""
    links, group = [0] * len(rows), list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a], rows[b]
            if usable(x) and usable(y) and x[2] == y[2] and len(x[1]) == len(y[1]):
                u, v = np.array(x[1], float), np.array(y[1], float)
                if u @ v / math.sqrt(u @ u) / math.sqrt(v @ v) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    group[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, row in enumerate(rows):
        if usable(row):
            least[top(k)] = min(least.get(top(k), row[0]), row[0])
    out = []
    for k, row in enumerate(rows):
        component = least[top(k)] if usable(row) else row[0]
        out.append((row[0], links[k], component, row[0] is not None and row[0] == component))
    return sorted(out, key=repr)


def near(rng, base, angle):
    other = rng.normal(size=len(base))
    other -= base * (other @ base) / (base @ base)
    other *= np.linalg.norm(base) / np.linalg.norm(other)
    return math.cos(angle) * base + math.sin(angle) * other


def sample_rows():
    rng = np.random.default_rng(7)
    rows, limit = [], math.acos(0.98)
    for label in (0, 1, 2):
        for _ in range(6):
            base = rng.normal(size=16) * rng.uniform(0.01, 50)
            rows.append((len(rows), base.astype(np.float32).tolist(), label))
            for angle in (0, 0.3, 0.6, 0.9, 0.99, 0.9999, 1.0001, 1.01, 1.2, 3):
                v = near(rng, base, limit * angle) * rng.uniform(0.5, 2)
                rows.append((len(rows), v.astype(np.float32).tolist(), label))
    vector = rows[0][1]
    n = len(rows)
    rows += [(n, vector, 0), (n + 1, vector, 1), (n + 1, vector, 1), (n + 2, vector, None), (None, vector, 0)]
    rows += [(n + 3, None, 0), (n + 4, [0.0] * 16, 0), (n + 5, [float("nan")] * 16, 0), (n + 6, [], 0)]
    rows += [(n + 7, [None] + vector[1:], 0), (n + 8, [float("inf")] * 16, 0), (n + 9, vector[:8], 0), (n + 10, vector[:8], 0)]
    return rows


@pytest.mark.parametrize("block", [4096, 20])
def test_equals_all_pairs(spark, block):
    rows = sample_rows()
    out = embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS), block=block)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain(rows)


def test_bound_holds_and_is_needed():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 24))
    tile = embeddings.Tile(a, np.ones(300, int), np.arange(300))
    product = (tile.whole @ tile.whole.T) * tile.scale[:, None] * tile.scale[None, :]
    bound = tile.length[:, None] * tile.rest[None, :] + tile.rest[:, None] * (tile.length + tile.rest)[None, :]
    unit = a / np.linalg.norm(a, axis=1, keepdims=True)
    error = np.abs(unit @ unit.T - product)
    assert (error <= bound + 1e-12).all() and error.max() > 1e-4


def test_large_dimensions_stay_exact():
    rng = np.random.default_rng(4)
    a = rng.choice([-1.0, 1.0], size=(40, 2000))
    tile = embeddings.Tile(a, np.ones(40, int), np.arange(40))
    assert tile.whole.dtype == np.float64
    i, j = embeddings.tile_links(tile, tile, 0.98)
    assert list(zip(i, j)) == [(k, k) for k in range(40)]


def test_block_returns_no_pairs():
    one = np.ones(8).tolist()
    group = pd.DataFrame({"rep": range(900), "n": 1, "vector": [np.array(one) + 1e-4 * k for k in range(900)], "block": 0, "lo": 0, "hi": 0})
    out = embeddings.block_links(group, 0.98)
    assert len(out) == 900 and set(out["links"]) == {899} and set(out["least"]) == {0}


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, QUERIES["op1_embeddings"](spark, SMALL).collect()), key=repr) == plain(rows)


def test_vectors_of_any_finite_size_link_by_cosine(spark):
    rows = [
        (1, [1e200, 1e200, 0.0], 0), (2, [2e200, 2e200, 0.0], 0), (3, [1e-200, 1e-200, 0.0], 0), (4, [3e-320, 3e-320, 0.0], 0),
        (5, [1e308, -1e308, 0.0], 0), (6, [1e-300, -1e-300, 1e-302], 0), (7, [5e-324, 0.0, 0.0], 0), (8, [1.0, 0.0, 0.0], 0),
        (9, [1e308, 1e-308, 0.0], 0), (10, [0.0, 0.0, 1.7e308], 0),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(frame).collect()}
    assert [found[i] for i in (1, 2, 3, 4)] == [(3, 1)] * 4
    assert found[5] == found[6] == (1, 5) and [found[i] for i in (7, 8, 9)] == [(2, 7)] * 3 and found[10] == (0, 10)
