"""Language identification by a byte convolutional network, trained and run in numpy.

Bytes are embedded, filters of several widths slide over them, the largest
response of each filter in a window is kept, and a softmax layer names the
language. A whole text is cut into fixed-length windows that overlap by the
widest filter less one byte, so no n-gram is lost, and windows of many texts
are run as one batch. A text's probabilities are the mean over its windows,
weighted by their bytes.

Embedding and filters are folded into one table per filter position (byte to
responses), so a convolution is a few gathers and additions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakeward.llm.common import documents, filter_rows, id_remainder, map_batches, utf8
from lakeward.operators.ranking import top_per_key

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
EMBEDDING = 8
PER_LANGUAGE = 500  # bound of the training sample: documents of each language
WINDOWS_PER_DOCUMENT = 3  # and windows of each
EPOCHS = 5
BATCH = 32
UNKNOWN = "und"
LEAST_SCORE = 0.3  # a text that resembles all languages about alike is in none of them
_RUN = 16  # windows computed at a time: their responses stay in the processor's cache
_SPAN = max(WIDTHS)
_LETTER = re.compile(r"[^\W\d_]")

# Lower case for A-Z; other ASCII characters that are not letters are one byte: space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
for _b in range(128):
    if not chr(_b).isalpha():
        _FOLD[_b] = 32


def has_letter(text: bytes | None) -> bool:
    """Whether a text holds a letter of any script."""
    return bool(text) and _LETTER.search(text.decode("utf-8", "replace")) is not None


def fold(text: bytes) -> np.ndarray:
    """Folded bytes, runs of spaces as one."""
    raw = _FOLD[np.frombuffer(text, np.uint8)]
    if len(raw) < 2:
        return raw
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    return raw[keep]


def windows(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text as rows, padded with byte 0, and the bytes in each."""
    step = WINDOW - _SPAN + 1
    count = max(1, -(-(len(folded) - _SPAN + 1) // step))
    padded = np.zeros((count - 1) * step + WINDOW, np.uint8)
    padded[: len(folded)] = folded[: len(padded)]
    rows = np.lib.stride_tricks.as_strided(padded, (count, WINDOW), (step, 1))
    sizes = np.minimum(WINDOW, len(folded) - step * np.arange(count))
    return rows, np.maximum(sizes, 1)


@dataclass
class Network:
    languages: list[str]
    tables: np.ndarray  # (position in the filter, byte, filter), float32
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each window."""
        out = np.empty((len(rows), self.tables.shape[2]), np.float32)
        wide = np.pad(rows, ((0, 0), (0, _SPAN - 1)))
        total = np.empty((_RUN, WINDOW, self.tables.shape[2]), np.float32)
        part = np.empty_like(total)
        for at in range(0, len(rows), _RUN):
            some = wide[at : at + _RUN]
            n = len(some)
            np.take(self.tables[0], some[:, :WINDOW], axis=0, out=total[:n], mode="clip")
            for k in range(1, _SPAN):
                np.take(self.tables[k], some[:, k : k + WINDOW], axis=0, out=part[:n], mode="clip")
                total[:n] += part[:n]
            total[:n].max(axis=1, out=out[at : at + n])
        return np.maximum(out + self.bias, 0)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        logits = (self.pooled(rows) @ self.dense + self.offset).astype(np.float64)
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """Language and probability of each whole text; ``und`` and 0 without a letter."""
        answer: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return answer
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> None:
            if not held:
                return
            p = self.probabilities(np.concatenate([rows for _, rows, _ in held]))
            at = 0
            for i, rows, sizes in held:
                mean = np.average(p[at : at + len(rows)], axis=0, weights=sizes)
                at += len(rows)
                best = int(mean.argmax())
                answer[i] = (self.languages[best], float(min(max(mean[best], 0.0), 1.0)))
            held.clear()

        for i, text in enumerate(texts):
            if has_letter(text):
                rows, sizes = windows(fold(text))
                held.append((i, rows, sizes))
                size += len(rows)
                if size >= 4096:
                    flush()
                    size = 0
        flush()
        return answer


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 1) -> Network:
    """Fit the network on windows (rows of bytes) by Adam on the mean cross-entropy."""
    random = np.random.default_rng(seed)
    kinds = max(1, len(languages))
    total = FILTERS * len(WIDTHS)
    embed = random.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
    taps = np.zeros((_SPAN, EMBEDDING, total), np.float32)
    mask = np.zeros((_SPAN, 1, total), np.float32)
    for w, width in enumerate(WIDTHS):
        part = slice(w * FILTERS, (w + 1) * FILTERS)
        taps[:width, :, part] = random.normal(0, 1 / np.sqrt(width * EMBEDDING), (width, EMBEDDING, FILTERS))
        mask[:width, :, part] = 1
    weights = [
        embed, taps, np.zeros(total, np.float32),
        random.normal(0, 0.1, (total, kinds)).astype(np.float32), np.zeros(kinds, np.float32),
    ]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    wide = np.pad(rows, ((0, 0), (0, _SPAN - 1)))
    for _ in range(EPOCHS if len(rows) else 0):
        order = random.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            pick = order[at : at + BATCH]
            some, want = wide[pick], labels[pick]
            embed, taps, bias, dense, offset = weights
            tables = np.matmul(embed, taps)
            response = tables[0][some[:, :WINDOW]]
            for k in range(1, _SPAN):
                response += tables[k][some[:, k : k + WINDOW]]
            where = response.argmax(axis=1)
            top = np.take_along_axis(response, where[:, None, :], axis=1)[:, 0, :] + bias
            pooled = np.maximum(top, 0)
            logits = pooled @ dense + offset
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), want] -= 1
            p /= len(pick)
            back = (p @ dense.T) * (top > 0)
            d_tables = np.zeros_like(tables)
            filters = np.broadcast_to(np.arange(total), where.shape)
            for k in range(_SPAN):
                seen = np.take_along_axis(some, where + k, axis=1)
                np.add.at(d_tables[k], (seen, filters), back)
            d_tables *= mask
            slopes = [
                np.einsum("kbf,kef->be", d_tables, taps, optimize=True),
                np.matmul(embed.T, d_tables) * mask,
                back.sum(axis=0), pooled.T @ p, p.sum(axis=0),
            ]
            step += 1
            for w, g, (m, v) in zip(weights, slopes, moments):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                w -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    embed, taps, bias, dense, offset = weights
    return Network(languages, np.matmul(embed, taps).astype(np.float32), bias, dense, offset)


def fit(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    windows_per_document: int = WINDOWS_PER_DOCUMENT,
) -> Network:
    """Train on a bounded sample of the labelled rows of ``df``.

    Of each language the ``per_language`` documents with the smallest hash of
    their id give up to ``windows_per_document`` windows at even distances. The
    sample is drawn from all rows and only windows reach the driver, at most
    ``languages * per_language * windows_per_document`` of them. Rows without a
    label, an id or a letter teach nothing.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = top_per_key(rows.select("doc_id", "lang").distinct(), ["lang"], order, per_language)
    # At most per_language ids of each language: bounded by the parameter.
    sample = rows.join(F.broadcast(picked), ["doc_id", "lang"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, langs, cuts, places = [], [], [], []
        for doc, lang, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), utf8(batch.column(1))):
            if has_letter(text):
                found, _ = windows(fold(text))
                for i in np.unique(np.linspace(0, len(found) - 1, windows_per_document).astype(int)):
                    ids.append(doc), langs.append(lang), places.append(int(i)), cuts.append(found[i].tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(places, pa.int64()), pa.array(cuts, pa.binary())],
            ["doc_id", "lang", "place", "cut"],
        )

    cuts = map_batches(sample.select("doc_id", "text", "lang"), cut, "doc_id long, lang string, place long, cut binary")
    found = sorted((r.lang, r.doc_id, r.place, bytes(r.cut)) for r in cuts.collect())
    languages = sorted({r[0] for r in found})
    matrix = np.frombuffer(b"".join(r[3] for r in found), np.uint8).reshape(-1, WINDOW)
    number = {lang: i for i, lang in enumerate(languages)}
    return train(matrix, np.array([number[r[0]] for r in found], int), languages)


def identify(df: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text; one row per row of ``df``.

    ``und`` with score 0 where the text is null or has no letter (or nothing
    was learned). Only the text is read.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        answer = network.predict(utf8(batch.column(1)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([a for a, _ in answer], pa.string()), pa.array([s for _, s in answer], pa.float64())],
            ["doc_id", "lang_pred", "score"],
        )

    return map_batches(documents(df, id_col, text_col), one, "doc_id long, lang_pred string, score double")


def known_language(df: DataFrame, network: Network, least: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has a learned language with a score of at least ``least``.

    Rows with a null text, no letter, or a lower score go; all columns stay.
    """

    def keep(texts: pa.Array) -> list[bool]:
        return [lang != UNKNOWN and score >= least for lang, score in network.predict(utf8(texts))]

    return filter_rows(df, keep, text_col)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from the training; a row without an id is not."""
    return F.coalesce(id_remainder(id_col, 4) == 2, F.lit(False))
