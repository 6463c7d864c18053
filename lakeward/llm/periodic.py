"""Periodic runs of words, found through string synchronising sets.

A run is a stretch of words with smallest period ``q`` and at least ``EXPONENT``
periods and ``LEAST`` words that no neighbouring word extends.

At a scale ``t`` a position is *synchronising* if among the hashes of the ``t + 1``
windows of ``t`` words that start within ``t`` words of it, the least one starts
at the position itself or ``t`` words on; windows with a period of at most
``t / 3`` do not count. Whether a position is chosen depends on its ``2 t`` words
alone, and every ``t`` positions hold one unless the text there has a period of
at most ``t / 3``. So a run of period ``q`` with ``3 t - 1 <= 2 q`` holds a chosen
position whose copy ``q`` words on is chosen too, with the same context: pairs of
neighbouring equal contexts propose all periods of ``1.5 t`` to ``3 t`` words. Equal
contexts lie over ``t / 3`` apart (nearer ones make the text highly periodic), so
there are a few pairs per position. The scales are powers of two. Periods below
``_SMALL + 1``, which the smallest scales leave out, come from comparing the text
with itself moved by so many words; these stretches, and the runs found at smaller
scales, are the highly periodic regions of the larger ones.

A proposed period is verified word by word, so hashes decide nothing by themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakeward.llm.common import documents, ship_package, utf8

LEAST = 24
EXPONENT = 3
_SMALL = 5  # periods found by moving the text; the least scale proposes those above
_FIRST = 4  # the least scale
_CHUNK = 2 << 20  # bytes of text whose documents are searched together

_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two; order matters."""
    x = a * _MUL[0] + (b ^ (b >> np.uint64(31))) * _MUL[1]
    x ^= x >> np.uint64(29)
    x *= _MUL[2]
    return x ^ (x >> np.uint64(32))


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal stretches of true."""
    edges = np.flatnonzero(np.diff(equal.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2] - edges[::2]


def _smallest(words: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of two periods at least has no smaller period.

    A smaller one would divide ``period``, as the stretch is long enough for both.
    """
    part, rest, f = words[start : start + 2 * period], period, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            shift = period // f
            if np.array_equal(part[shift:], part[:-shift]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def _reach(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from ``a`` and ``b`` on agree, forwards (1) or, from just before them, backwards (-1)."""
    got, width = 0, 64
    while True:
        if step > 0:
            x, y = words[a + got : a + got + width], words[b + got : b + got + width]
        else:
            x, y = words[max(0, a - got - width) : max(0, a - got)][::-1], words[max(0, b - got - width) : max(0, b - got)][::-1]
        size = min(len(x), len(y))
        differ = x[:size] != y[:size]
        first = int(differ.argmax()) if size else 0
        if size and differ[first]:
            return got + first
        got += size
        if size < width:
            return got
        width *= 2


class _Search:
    """Runs in an array of word numbers; documents are parted by numbers that occur once."""

    def __init__(self, words: np.ndarray, least: int, exponent: int):
        self.words, self.least, self.exponent = words, least, exponent
        self.found: list[tuple[int, int, int]] = []  # start, length, period
        self.periodic: list[tuple[np.ndarray, np.ndarray, int]] = []  # starts and lengths of stretches by small period

    def _keep(self, start: int, length: int, period: int) -> None:
        if length >= max(self.least, self.exponent * period) and _smallest(self.words, start, period):
            self.found.append((start, length, period))

    def small_periods(self) -> None:
        for p in range(1, min(_SMALL, len(self.words) - 1) + 1):
            starts, lengths = _stretches(self.words[p:] == self.words[:-p])
            long = lengths >= 2 * p
            starts, lengths = starts[long], lengths[long] + p
            self.periodic.append((starts, lengths, p))
            for k in np.flatnonzero(lengths >= max(self.least, self.exponent * p)):
                self._keep(int(starts[k]), int(lengths[k]), p)

    def _highly_periodic(self, at: np.ndarray, scale: int) -> np.ndarray:
        """Whether the window of ``scale`` words at each position of ``at`` has a period of at most a third of it."""
        depth = np.zeros(len(self.words) + 1, np.int32)
        for starts, lengths, p in self.periodic:
            if 3 * p <= scale:
                long = lengths >= scale
                np.add.at(depth, starts[long], 1)
                np.add.at(depth, starts[long] + lengths[long] - scale + 1, -1)
        for start, length, p in self.found:
            if _SMALL < p and 3 * p <= scale <= length:
                depth[start] += 1
                depth[start + length - scale + 1] -= 1
        return np.cumsum(depth)[at] > 0

    def scale(self, at: np.ndarray, hashes: np.ndarray, scale: int) -> None:
        """Periods proposed at one scale; ``hashes`` are those of the windows at ``at``, the positions searched."""
        size = len(at)
        if size <= 2 * scale:
            return
        ids = np.where(self._highly_periodic(at, scale), np.uint64(2**64 - 1), hashes)
        least, width = ids, 1  # least hash of ``width`` windows from each position on
        while width < scale:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        last = size - 2 * scale + 1
        lowest = np.minimum(least[:last], ids[scale : scale + last])
        chosen = (lowest < np.uint64(2**64 - 1)) & ((ids[:last] == lowest) | (ids[scale : scale + last] == lowest))
        chosen = np.flatnonzero(chosen)
        context = _mix(hashes[chosen], hashes[chosen + scale])
        order = np.argsort(context, kind="stable")
        place, context = at[chosen[order]], context[order]
        low, high = max(_SMALL + 1, (3 * scale) // 2 if scale > _FIRST else 0), 3 * scale - 1
        proposals, lag = [], 1
        while lag < len(place):
            apart = place[lag:] - place[:-lag]
            near = (context[lag:] == context[:-lag]) & (apart <= high) & (apart > 0)
            if not near.any():
                break
            near &= apart >= low
            proposals.append(np.stack([apart[near], place[:-lag][near]]))
            lag += 1
        if proposals:
            self._verify(np.concatenate(proposals, axis=1))

    def _verify(self, proposals: np.ndarray) -> None:
        proposals = proposals[:, np.lexsort(proposals[::-1])]
        periods, first = np.unique(proposals[0], return_index=True)
        for q, places in zip(periods.tolist(), np.split(proposals[1], first[1:])):
            k = 0
            while k < len(places):
                i = int(places[k])
                start = i - _reach(self.words, i, i + q, -1)
                end = i + q + _reach(self.words, i, i + q, 1)
                self._keep(start, end - start, q)
                # Later places with both words in this stretch belong to it.
                k = max(k + 1, int(np.searchsorted(places, end - q)))


def find(texts: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """``start, length, period`` of the runs of each sequence of word numbers, by start, then period.

    ``least`` must be 24 or more and ``exponent`` 3 or more: below that the scales
    would leave runs out.
    """
    if least < LEAST or exponent < EXPONENT:
        raise ValueError(f"runs of under {LEAST} words or {EXPONENT} periods are not searched for")
    sizes = np.array([len(t) for t in texts], np.int64)
    # One number of its own after each text: no window of equal words crosses it.
    parted = [x for k, t in enumerate(texts) for x in (t, np.array([-1 - k], np.int64))]
    words = np.concatenate([np.empty(0, np.int64), *parted]).astype(np.int64)
    offsets = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    search = _Search(words, least, exponent)
    search.small_periods()

    at, scale, width = np.arange(len(words)), _FIRST, 1
    hashes = _mix(words.view(np.uint64), np.uint64(7) + np.zeros(len(words), np.uint64))
    while True:
        # Only texts that can hold a run of the least period of this scale.
        enough = sizes >= max(least, exponent * max(_SMALL + 1, (3 * scale) // 2 if scale > _FIRST else 0))
        stay = enough[owner[at]]
        at, hashes = at[stay], hashes[stay]
        if not len(at):
            break
        while width < scale:
            moved = np.concatenate([hashes[width:], np.zeros(min(width, len(hashes)), np.uint64)])
            hashes, width = _mix(hashes, moved), width * 2
        search.scale(at, hashes, scale)
        scale *= 2

    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in search.found:
        k = owner[start]
        out[k].append((int(start - offsets[k]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that repeat a run's first period, joined by one space."""
    if runs:
        keep, at = [], 0
        for start, end in sorted((s + q, s + n) for s, n, q in runs):
            keep += words[at:start]
            at = max(at, end)
        words = keep + words[at:]
    return b" ".join(words)


def _chunks(texts: list[bytes | None]) -> Iterator[slice]:
    """Slices of texts of about ``_CHUNK`` bytes, whole texts always."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or b"") + 64
        if size >= _CHUNK or k + 1 == len(texts):
            yield slice(start, k + 1)
            start, size = k + 1, 0


SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``df``, without a shuffle.

    Words are stretches of anything but the six ASCII white-space bytes, compared
    byte by byte. ``runs`` are ordered by start, then period; ``collapsed`` is the
    text without the words that a run repeats. Null and blank texts have no words,
    no run and an empty ``collapsed``; ids may be null or repeat, and every row
    comes back. Other columns are not read. A text is held by one task, which takes
    about 40 bytes a word; documents are searched some two megabytes at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), utf8(batch.column(1))
            for part in _chunks(texts):
                numbers: dict[bytes, int] = defaultdict(count().__next__)
                split = [t.split() if t else [] for t in texts[part]]
                coded = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in split]
                runs = find(coded, least, exponent)
                rows = [[dict(zip(("start", "length", "period"), r)) for r in of] for of in runs]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(part.start, part.stop - part.start),
                        pa.array([len(w) for w in split], pa.int64()),
                        pa.array(rows, pa.list_(_RUN)),
                        pa.array([collapse(w, r) for w, r in zip(split, runs)], pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    ship_package(df.sparkSession)
    return documents(df, id_col, text_col).mapInArrow(run, SCHEMA)


def with_planted_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` where a tenth of the documents repeat a part of themselves up to the end.

    With ``h`` the crc32 of the id as text and ``g`` a tenth of it, documents with
    ``h % 10 = 0`` and ``n > 0`` words repeat the ``p`` words from ``a`` on, where
    ``a = g % n`` and ``p = 1 + (n - a) div (3 + g % 8)``; their words are joined by
    one space. Other rows, and rows without an id or a word, stay as they are.
    """
    text, h = F.col("text"), F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10).cast("long")
    out = documents(df, id_col, text_col).withColumn("_words", F.when(h % 10 == 0, words))
    size = F.size("_words").cast("long")
    a = F.when(size > 0, g % size)
    p = F.lit(1) + F.floor((size - a) / (F.lit(3) + g % 8))
    times = F.ceil((size - a) / p).cast("int")

    def part(array: Column, start: Column, length: Column) -> Column:
        return F.slice(array, start.cast("int"), length.cast("int"))

    block = part(F.col("_words"), a + 1, p)
    tail = part(F.flatten(F.array_repeat(block, times)), F.lit(1), size - a)
    planted = F.array_join(F.concat(part(F.col("_words"), F.lit(1), a), tail), " ")
    return out.select("doc_id", F.when(size > 0, planted).otherwise(text).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row per row of ``find_runs``: the number of runs, the one of greatest exponent, and checksums.

    The greatest exponent is the greatest exact ``length / period``; of equal ones the
    run with the smallest start, then period. Without a run its four columns are null.
    """

    def better(best: Column, r: Column) -> Column:
        # Runs come by start, then period, so only a greater exponent takes over.
        wins = best["period"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
        return F.when(wins, r).otherwise(best)

    nothing = F.lit(None).cast("struct<start: long, length: long, period: long>")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    out = found.withColumn("best", F.aggregate("runs", nothing, better))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
