"""Exact removal of long repeated byte strings by a sparse suffix array.

A byte goes when a string of ``length`` bytes that covers it also starts
anywhere else. Only places where that can be are sorted:

1. Every text is scanned once. The smallest hash of a short gram in each window
   of ``length`` bytes is the window's anchor; equal windows have their anchors
   at equal places, so equal windows meet under the anchor's gram. Anchors
   whose gram is nowhere else are done with.
2. The other anchors bring the bytes of the windows that they own. Under one
   gram, the suffixes that start at the anchors and the reversed prefixes that
   end there are sorted by deep-shallow sorting: a multikey sort by eight-byte
   characters to a shallow depth, then blind tries for the groups that share
   more. From both orders and their common lengths follows, for every offset of
   the window from the anchor, which windows are equal: those that are
   neighbours with enough common bytes on both sides.
3. The repeated windows of an anchor cover one run of bytes. Runs are united
   per text and cut out.

Equal texts are one text with a count: a text that occurs twice and has at
least ``length`` bytes goes as a whole, whatever the number of copies. A gram
under which there are more than ``HOT`` anchors, say in a line of half of all
texts, is not sorted in one task: its windows are dealt by their content (first
by the bytes that neighbouring windows share, to leave out those that
cannot repeat, then whole) and counted with map-side combine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakeward.llm.common import documents, map_batches, ship_package, utf8
from lakeward.session import stage

LENGTH = 400
GRAM = 64  # bytes of an anchor's gram, at most half of the length
HOT = 2_000  # anchors of a gram that are sorted together
SHALLOW = 3  # eight-byte characters of the multikey sort
GRID = 8  # the windows of a grid cell, compared first for hot grams, are this part of the length
_CHUNK = 1 << 19  # windows scanned at a time
_BITS = 20  # bits of a place within a chunk
_BATCH = 20_000  # anchors sorted at a time: whole groups

_random = np.random.default_rng(20_240_301)
_BYTES = _random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


# ---------------------------------------------------------------- anchors


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse."""
    held = _powers.get(0)
    if held is None or len(held[0]) < size:
        size = max(size, 1 << 14)
        inverse = pow(_STEP, -1, 1 << 64)
        with np.errstate(over="ignore"):
            held = tuple(
                np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
                for base in (_STEP, inverse)
            )
        _powers[0] = held
    return held


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of every run of ``gram`` bytes; equal runs, equal hashes."""
    powers, inverses = _power_table(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * powers[: len(raw)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * inverses[: len(raw) - gram + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every run of ``width`` values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash and place of every anchor, and the last window that it owns.

    Windows are named by their first byte. An anchor owns the windows after the
    last one of the anchor before it; together they own all windows.
    """
    count = len(text) - length + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = length - gram + 1
    keys, places, lasts = [], [], []
    low = np.uint64((1 << _BITS) - 1)
    for at in range(0, count, _CHUNK):
        windows = min(_CHUNK, count - at)
        raw = np.frombuffer(text, np.uint8, windows + length - 1, at)
        hashes = gram_hashes(raw, gram)
        # The place in the low bits: of equal hashes the first in the window counts.
        least = sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), width)
        where = (least & low).astype(np.int64)
        ends = np.flatnonzero(np.concatenate([where[1:] != where[:-1], [True]]))
        if places and places[-1][-1] == where[ends[0]] + at:  # goes on from the chunk before
            places[-1], keys[-1], lasts[-1] = places[-1][:-1], keys[-1][:-1], lasts[-1][:-1]
        keys.append(hashes[where[ends]].view(np.int64))
        places.append(where[ends] + at)
        lasts.append(ends + at)
    return np.concatenate(keys), np.concatenate(places), np.concatenate(lasts)


# ---------------------------------------------------------------- deep-shallow sorting


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie_sort(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the strings and common length of each with the one before it (the first: -1).

    A blind trie keeps at its nodes only the depth at which strings part and
    the byte that follows (-1: the string ends). A new string goes down by these
    bytes to some leaf, is compared with that leaf's string once, and the
    common length says where it branches off. Equal strings share a leaf.
    """
    root: list | int = 0  # a leaf is the number of a string, a node [depth, {byte: child}]
    same: dict[int, list[int]] = {0: [0]}
    for n in range(1, len(strings)):
        s = strings[n]
        node = root
        while isinstance(node, list):
            depth, children = node
            child = children.get(s[depth] if depth < len(s) else -1)
            node = next(iter(children.values())) if child is None else child
        other = strings[node]
        shared = common(s, other)
        if shared == len(s) == len(other):
            same[node].append(n)
            continue
        same[n] = [n]
        parent, edge, node = None, -1, root
        while isinstance(node, list) and node[0] < shared:
            parent, edge = node, s[node[0]]
            node = node[1][edge]
        own = s[shared] if shared < len(s) else -1
        if isinstance(node, list) and node[0] == shared:
            node[1][own] = n
        else:
            fork = [shared, {own: n, (other[shared] if shared < len(other) else -1): node}]
            if parent is None:
                root = fork
            else:
                parent[1][edge] = fork
    order, lengths = [], []
    waiting: list[tuple[list | int, int]] = [(root, -1)]
    while waiting:  # depth first, children in byte order; with the depth shared with what came before
        node, shared = waiting.pop()
        if isinstance(node, list):
            depth, children = node
            for i, byte in enumerate(sorted(children, reverse=True)):
                waiting.append((children[byte], depth if i < len(children) - 1 else shared))
        else:
            for i, n in enumerate(same[node]):
                order.append(n)
                lengths.append(shared if i == 0 else len(strings[n]))
    return order, lengths


def deep_shallow_sort(strings: list[bytes], groups: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by group and content, and common lengths of neighbours (-1 between groups).

    ``skip`` bytes at the start are alike within a group; the multikey sort
    begins after them. Of two strings one of which begins the other, the
    shorter comes first, also where the longer goes on with zero bytes.
    """
    total = len(strings)
    depth = 8 * SHALLOW
    head = np.frombuffer(b"".join(s[skip : skip + depth].ljust(depth, b"\0") for s in strings), ">u8").reshape(total, SHALLOW)
    rank = groups.astype(np.int64)
    sizes = np.array([len(s) for s in strings], np.int64) - skip
    for word in range(SHALLOW):  # multikey: ranks by the characters so far, refined by the next
        held = np.clip(sizes - 8 * word, 0, 8)
        order = np.lexsort((held, head[:, word], rank))
        new = np.zeros(total, bool)
        for key in (rank, head[:, word], held):
            new[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(total, np.int64)
        rank[order] = np.cumsum(new)
    order = np.argsort(rank, kind="stable")
    lengths = np.full(total, -1, np.int64)
    borders = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1], [True]])) if total else np.zeros(1, int)
    for a, b in zip(borders[:-1], borders[1:]):
        if b - a > 1:
            members = order[a:b]
            inner, shared = blind_trie_sort([strings[i] for i in members])
            order[a:b] = members[inner]
            lengths[a + 1 : b] = shared[1:]
        if a and groups[order[a]] == groups[order[a - 1]]:
            lengths[a] = common(strings[order[a - 1]], strings[order[a]])
    return order, lengths


def repeated_offsets(
    groups: np.ndarray, left: list[bytes], right: list[bytes], length: int, gram: int
) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest offset of a repeated window of each anchor; -1 where there is none.

    ``left`` are the bytes before each anchor, ``right`` those from it on, as
    far as the windows that it owns reach. The window at offset o holds the
    last o bytes of the one and the first ``length - o`` of the other. All
    anchors of a group have the same ``gram`` bytes.
    """
    total = len(groups)
    far, near = np.full(total, -1, np.int64), np.full(total, length, np.int64)
    if total:
        by_right, shared_right = deep_shallow_sort(right, groups, gram)
        by_left, shared_left = deep_shallow_sort([s[::-1] for s in left], groups)
        most = np.array([len(s) for s in left])
        least = length - np.array([len(s) for s in right])
        class_right, class_left = np.empty(total, np.int64), np.empty(total, np.int64)
        for o in range(int(most.max()), int(least.min()) - 1, -1):
            fits = np.flatnonzero((most >= o) & (least <= o))
            if len(fits) < 2:
                continue
            class_right[by_right] = np.cumsum(shared_right < length - o)
            class_left[by_left] = np.cumsum(shared_left < o)
            both = class_right[fits] * (total + 1) + class_left[fits]
            order = np.argsort(both)
            ordered = both[order]
            twin = np.zeros(len(fits), bool)
            equal = ordered[1:] == ordered[:-1]
            twin[1:] |= equal
            twin[:-1] |= equal
            hit = fits[order[twin]]
            far[hit] = np.maximum(far[hit], o)
            near[hit] = o
    return far, np.where(far >= 0, near, -1)


# ---------------------------------------------------------------- the job


def _scanned(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """A row per document: key of its text, size, hash, anchors."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(6)]
        for text in utf8(batch.column(1)):
            text = text or b""
            digest = hashlib.sha256(text).digest()
            for column, value in zip(columns, (digest[:16], len(text), digest.hex(), *anchors(text, length, gram))):
                column.append(value)
        kinds = [pa.binary(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            ["doc_id", "tk", "n_bytes", "sha", "keys", "places", "lasts"],
        )

    schema = "doc_id long, tk binary, n_bytes long, sha string, keys array<long>, places array<long>, lasts array<long>"
    return map_batches(docs, one, schema, 2000)


ITEM = "key long, n long, tk binary, place long, offset int, bytes binary"
RUN = "tk binary, start long, stop long"


def _items(docs: DataFrame, length: int) -> DataFrame:
    """The candidate anchors with the bytes of their windows, and runs that repeat within a text.

    Anchors of one text with one gram and equal bytes are one item, as far as
    other texts go; all of their windows repeat, so their runs are final. These
    rows have no key. ``offset`` is the anchor's place in ``bytes``.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for tk, text, found in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
            seen: dict[tuple[int, bytes], tuple] = {}
            twice = set()
            for a in found:
                held = text[a["lo"] : a["last"] + length]
                row = (a["key"], a["n"], tk, a["place"], a["place"] - a["lo"], held)
                first = seen.setdefault((a["key"], held), row)
                if first is not row:
                    for r in (row, *([first] if first[3] not in twice else [])):
                        rows.append((None, None, tk, r[3] - r[4], len(held), b""))
                    twice.add(first[3])
            rows += seen.values()
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
        columns = zip(*rows) if rows else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)], ["key", "n", "tk", "place", "offset", "bytes"]
        )

    return map_batches(docs.select("tk", "text", "found"), one, ITEM, 500)


def _sorted_runs(items: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of repeated windows under each gram, a task holding whole grams of at most ``HOT`` anchors."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        left, right = [r[4][: r[3]] for r in rows], [r[4][r[3] :] for r in rows]
        # The grams themselves, as two may have one hash.
        grams = [(r[0], s[:gram]) for r, s in zip(rows, right)]
        number = {g: i for i, g in enumerate(sorted(set(grams)))}
        groups = np.array([number[g] for g in grams], np.int64)
        far, near = repeated_offsets(groups, left, right, length, gram)
        hit = np.flatnonzero(far >= 0)
        place = np.array([r[2] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][1] for i in hit], pa.binary()),
                pa.array(place[hit] - far[hit]),
                pa.array(place[hit] - near[hit] + length),
            ],
            ["tk", "start", "stop"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(5)))
            if len(held) >= _BATCH:
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut:
                    yield solve(held[:cut])
                    held = held[cut:]
        if held:
            yield solve(held)

    dealt = items.select("key", "tk", "place", "offset", "bytes").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, RUN)


def _hot_runs(items: DataFrame, length: int) -> DataFrame:
    """The same for grams with more anchors, by counting equal windows wherever they are."""
    grid = max(1, length // GRID)
    share = length - grid + 1  # bytes that the windows of a grid cell have in common

    def cells(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for tk, place, offset, held in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for cell in range((offset + length - len(held)) // grid, offset // grid + 1):
                at = offset - grid * cell
                out.append((tk, place, cell, hashlib.blake2b(held[at : at + share], digest_size=16).digest()))
        return _batch(out, [("tk", pa.binary()), ("place", pa.int64()), ("cell", pa.int32()), ("h", pa.binary())])

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for tk, place, offset, held, wanted in zip(*(batch.column(i).to_pylist() for i in range(5))):
            for cell in wanted:
                for o in range(max(grid * cell, offset + length - len(held)), min(grid * cell + grid - 1, offset) + 1):
                    whole = held[offset - o : offset - o + length]
                    out.append((tk, place, o, hashlib.blake2b(whole, digest_size=16).digest()))
        return _batch(out, [("tk", pa.binary()), ("place", pa.int64()), ("o", pa.int32()), ("h", pa.binary())])

    def repeated(rows: DataFrame) -> DataFrame:
        often = stage(rows.groupBy("h").count().where("count > 1").select("h"), "often")
        return rows.join(often, "h")  # of two plain shuffles, so a hot value's side is split

    plain = items.select("tk", "place", "offset", "bytes")
    found = map_batches(plain, cells, "tk binary, place long, cell int, h binary", 2000)
    wanted = repeated(stage(found, "cells")).groupBy("tk", "place").agg(F.collect_list("cell").alias("cells"))
    whole = map_batches(plain.join(wanted, ["tk", "place"]).select(*plain.columns, "cells"), windows, "tk binary, place long, o int, h binary", 500)
    same = repeated(stage(whole, "windows")).groupBy("tk", "place").agg(F.max("o").alias("far"), F.min("o").alias("near"))
    return same.select("tk", (F.col("place") - F.col("far")).alias("start"), (F.col("place") - F.col("near") + length).alias("stop"))


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def unite(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes; runs that touch are one."""
    out: list[list[int]] = []
    for start, stop in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _cut(docs: DataFrame) -> DataFrame:
    """``tk, n_removed, spans, kept_sha, kept`` of texts with their runs."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for tk, text, starts, stops in zip(
            batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ):
            spans = unite(list(zip(starts, stops)))
            edges = [0, *(x for span in spans for x in span), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((tk, len(text) - len(kept), [a for a, _ in spans], [b for _, b in spans], hashlib.sha256(kept).hexdigest()))
        longs = pa.list_(pa.int64())
        return _batch(out, [("tk", pa.binary()), ("n_removed", pa.int64()), ("starts", longs), ("stops", longs), ("kept_sha256", pa.string())])

    return map_batches(docs, one, "tk binary, n_removed long, starts array<long>, stops array<long>, kept_sha256 string", 2000)


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, stops`` for every row of ``df``.

    ``starts`` and ``stops`` are the byte ranges that go. A null text is the
    empty one; a text shorter than ``length`` keeps everything. Repeated rows
    are repeated texts, whatever their ids. Strings are judged on the input.
    Runs Spark jobs while it is called.
    """
    ship_package(df.sparkSession)
    docs = documents(df, id_col, text_col)
    scanned = stage(_scanned(docs, length, gram), "scanned")
    texts = stage(
        scanned.where(F.col("n_bytes") >= length)
        .withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
        .groupBy("tk")
        # Equal texts have equal anchors, so any of them will do.
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("places").alias("places"), F.first("lasts").alias("lasts")),
        "texts",
    )
    owned = texts.select(
        "tk", "rep", F.explode(F.arrays_zip("keys", "places", "lasts", F.concat(F.array(F.lit(-1).cast("long")), "lasts").alias("before"))).alias("a")
    ).select("tk", "rep", F.col("a.keys").alias("key"), F.col("a.places").alias("place"), F.col("a.lasts").alias("last"), (F.col("a.before") + 1).alias("lo"))
    owned = owned.where("key is not null")  # the list of earlier ends is one longer
    # Staged, so that the join below has two plain shuffles and a hot gram's side is split.
    often = stage(owned.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    found = (
        owned.join(often, "key").groupBy("tk", "rep")
        .agg(F.collect_list(F.struct("key", "n", "place", "lo", "last")).alias("found"))  # bounded by the text's length
    )
    keyed = docs.where(F.octet_length("text") >= length).select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("rep"),
        F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16).alias("tk"), "text",
    )
    # By text and id, so that copies are not dealt to one task to be dropped there.
    candidates = stage(keyed.join(found, ["tk", "rep"]).select("tk", "text", "found"), "candidates")
    items = stage(_items(candidates, length), "items")
    inside = items.where("key is null").select("tk", F.col("place").alias("start"), (F.col("place") + F.col("offset")).alias("stop"))
    some = items.where(F.col("key").isNotNull() & (F.col("n") <= hot))
    runs = inside.unionAll(_sorted_runs(some, length, gram)).unionAll(_hot_runs(items.where(F.col("key").isNotNull() & (F.col("n") > hot)), length))
    per_text = runs.groupBy("tk").agg(F.collect_list(F.struct("start", "stop")).alias("r")).select(
        "tk", F.col("r.start").alias("starts"), F.col("r.stop").alias("stops")
    )
    cut = _cut(candidates.select("tk", "text").join(per_text, "tk")).dropDuplicates(["tk"])
    # Staged, so that the copies of a text are split in the last join.
    once = stage(texts.select("tk", "copies").join(cut, "tk", "left"), "removed")
    nothing = hashlib.sha256(b"").hexdigest()
    all_of_it = F.coalesce(F.col("copies") > 1, F.lit(False))
    none = F.array().cast("array<long>")
    starts = F.when(all_of_it, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("starts", none))
    return scanned.select("doc_id", "tk", "n_bytes", "sha").join(once, "tk", "left").select(
        "doc_id",
        "n_bytes",
        F.when(all_of_it, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.size(starts).cast("long").alias("n_spans"),
        F.when(all_of_it, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        starts.alias("starts"),
        F.when(all_of_it, F.array("n_bytes")).otherwise(F.coalesce("stops", none)).alias("stops"),
    )
