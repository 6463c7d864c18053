"""SimHash fingerprints and their links by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within ``distance`` bits
agree in some segment up to a small radius, so the small Hamming ball around
each segment value is enumerated, the values are matched with a table of the
segments of all fingerprints, and the whole distance of each match is verified
in the join itself. Equal fingerprints are one entry of that table, so a group
of copies of any size is one row in it, and a hot segment value holds at most
the distinct fingerprints around it (adaptive execution splits such a join).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lakeward.llm.common import documents, map_batches, utf8
from lakeward.llm.components import connected_components
from lakeward.session import stage

WORDS = 3
SEED = 42
BITS = 64
DISTANCE = 2
SEGMENTS = 2
_CHUNK = 1 << 14  # hashes whose bits are unpacked at a time

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Majority of the bits of the hashes of all word shingles, repeats included.

    ``bytes.lower`` and ``bytes.split`` touch A-Z and the six ASCII white-space
    bytes only. Fewer words than a shingle: the whole sequence is the only one;
    no word (or null): zero.
    """
    found = text.lower().split() if text else []
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
    hashes = np.fromiter(map(_hash, shingles), np.dtype("<u8"))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (a signed 64-bit value) for every row, ids and texts null or not."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [fingerprint(t) for t in utf8(batch.column(1))]
        fps = pa.array(np.array(values, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return map_batches(documents(df, id_col, text_col), one, "doc_id long, fp long")


def _ball(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` bits out of ``bits``."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def segment_radii(distance: int, segments: int) -> list[int]:
    """Radius to search per segment; -1: not at all.

    With ``distance = radius * segments + rest``, a pair within the distance is
    within ``radius`` in one of the first ``rest + 1`` segments or within
    ``radius - 1`` in one of the others.
    """
    radius, rest = divmod(distance, segments)
    return [radius if i <= rest else radius - 1 for i in range(segments)]


def _entry(segment: int, value: Column) -> Callable[[Column], Column]:
    """A mask to the entry that it makes of a segment's value."""
    return lambda mask: F.struct(F.lit(segment).alias("seg"), value.bitwiseXOR(mask).alias("key"))


def links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """``fp, other`` with ``fp < other``: pairs of the distinct ``fps.fp`` within ``distance`` bits.

    A pair can come up once per segment. The rows made before the join are a
    fixed number per distinct fingerprint.
    """
    edges = [BITS * i // segments for i in range(segments + 1)]
    probes, entries = [], []
    for i, radius in enumerate(segment_radii(distance, segments)):
        if radius < 0:
            continue
        width = edges[i + 1] - edges[i]
        value = F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        masks = F.array(*[F.lit(m).cast("long") for m in _ball(width, radius)])
        probes.append(F.transform(masks, _entry(i, value)))
        entries.append(_entry(i, value)(F.lit(0).cast("long")))
    probe = fps.select("fp", F.explode(F.concat(*probes)).alias("p")).select("fp", "p.*")
    table = fps.select(F.col("fp").alias("other"), F.explode(F.array(*entries)).alias("e")).select("other", "e.*")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
    same = (probe["seg"] == table["seg"]) & (probe["key"] == table["key"])
    return probe.join(table, same & (F.col("fp") < F.col("other")) & close).select("fp", "other")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    distance: int = DISTANCE,
    segments: int = SEGMENTS,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``df``.

    The component is the smallest id reachable over links of at most
    ``distance`` bits. Null and empty texts have fingerprint zero and are linked
    like any other. A row without an id belongs to the component of its
    fingerprint; the component is null only where no row of it has an id.
    Repeated rows come back repeated. Stages the fingerprints, so the texts are
    read once, and runs Spark jobs while it is called.
    """
    each = stage(fingerprints(df, id_col, text_col), "fingerprints")
    classes = stage(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    reached = connected_components(links(classes.select("fp"), distance, segments), "fp", "other")
    of = classes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    of = stage(of, "roots")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    component = of.join(least, "root").select("fp", "component_id")
    return each.join(component, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
