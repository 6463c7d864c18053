"""Quality score by positive-unlabelled learning with a non-negative risk.

Trusted documents are positives; all other text, good and bad, is unlabelled.
The share of good text in it (the class prior) is estimated first, from
how a classifier of positives against unlabelled text spreads the two. Then a
small network minimises

    prior * E_P[loss(f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)])

whose second part stands for the risk on the negatives and is kept from going
below zero: where a batch makes it negative, the step goes the other way, so
that the network does not overfit the positives.

A text is described by shares of byte classes, of punctuation marks, by hashed
byte pairs and by the regularity of its words and lines; the whole text counts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakeward.llm.common import documents, id_remainder, map_batches, utf8
from lakeward.session import stage

SAMPLE = 4000  # bound of the training sample: that many positives, twice as many unlabelled
PAIRS = 256
HIDDEN = 32
EPOCHS = 40
PRIOR_EPOCHS = 10  # of the classifier behind the prior
BATCH = 256
FLOOR, CEILING = 0.05, 0.95  # of the prior
_PIECE = 1 << 20  # bytes whose pairs are hashed at a time

_MARKS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
_STATISTICS = 16
FEATURES = _STATISTICS + len(_MARKS) + PAIRS


def features(text: bytes | None) -> np.ndarray:
    """Description of a whole text; null is the empty text."""
    out = np.zeros(FEATURES, np.float32)
    text = text or b""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    if not n:
        return out
    counts = np.bincount(raw, minlength=256).astype(np.float64)
    words, lines = text.split(), [line for line in text.split(b"\n") if line.strip()]
    kinds, kept_lines = len(set(words)), len(set(lines))
    upper = sum(w.isupper() for w in words)
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    again = sum(a == b for a, b in zip(words, words[1:]))
    sentences = text.split(b". ")
    alone = sum(len(w) == 1 and w in b"|-*#" for w in words)
    shares = counts / n
    out[:_STATISTICS] = (
        np.log1p(n), np.log1p(len(words)), shares[65:91].sum(), shares[97:123].sum(),
        shares[48:58].sum(), shares[32], shares[10], shares[128:].sum(),
        n / (len(words) + 1), kinds / (len(words) + 1), kept_lines / (len(lines) + 1),
        upper / (len(words) + 1), marked / (len(words) + 1), alone / (len(words) + 1),
        again / (len(words) + 1), len(set(sentences)) / len(sentences),
    )
    at = _STATISTICS
    out[at : at + len(_MARKS)] = np.sqrt(shares[_MARKS])
    pairs = np.zeros(PAIRS)
    for start in range(0, n - 1, _PIECE):
        piece = raw[start : start + _PIECE + 1].astype(np.uint16)
        pairs += np.bincount((piece[:-1] * np.uint16(167) + piece[1:] * np.uint16(31)) % PAIRS, minlength=PAIRS)
    out[at + len(_MARKS) :] = np.sqrt(pairs / max(n - 1, 1))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -5, 5)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good text for rows of features."""
        return _sigmoid(_forward(self._scaled(x), self.weights)[0])


def _forward(x: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = weights
    hidden = np.maximum(x @ a + b, 0)
    return hidden @ c + d, hidden


def _slopes(x: np.ndarray, hidden: np.ndarray, back: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    a, b, c, d = weights
    inner = back[:, None] * c[None, :] * (hidden > 0)
    return [x.T @ inner, inner.sum(axis=0), hidden.T @ back, np.array(back.sum())]


def _optimise(x_p: np.ndarray, x_u: np.ndarray, step, seed: int, epochs: int) -> list[np.ndarray]:
    """Adam over batches of positives and unlabelled rows; ``step`` gives the slopes of a batch."""
    random = np.random.default_rng(seed)
    weights = [
        random.normal(0, 1 / np.sqrt(x_u.shape[1]), (x_u.shape[1], HIDDEN)), np.zeros(HIDDEN),
        random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(0.0),
    ]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    turn = 0
    for _ in range(epochs):
        order = random.permutation(len(x_u))
        for at in range(0, len(x_u), BATCH):
            u = x_u[order[at : at + BATCH]]
            p = x_p[random.integers(0, len(x_p), min(BATCH, len(x_p)))]
            turn += 1
            for i, (g, (m, v)) in enumerate(zip(step(p, u, weights), moments)):
                m[...] = 0.9 * m + 0.1 * g
                v[...] = 0.999 * v + 0.001 * g * g
                move = (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
                weights[i] = weights[i] - 0.002 * (move + 0.05 * weights[i])
    return weights


def _against_unlabelled(p, u, weights):
    """Slopes of the log loss of positives against unlabelled rows, both of equal weight."""
    f_p, h_p = _forward(p, weights)
    f_u, h_u = _forward(u, weights)
    one = _slopes(p, h_p, (_sigmoid(f_p) - 1) / len(p), weights)
    two = _slopes(u, h_u, _sigmoid(f_u) / len(u), weights)
    return [a + b for a, b in zip(one, two)]


def estimate_prior(x_p: np.ndarray, x_u: np.ndarray, seed: int = 1) -> float:
    """Share of good text among the unlabelled rows, by the best bin.

    A classifier of positives against unlabelled rows is fitted on one half of
    the rows. On the other half, above any border of its score lies a part of
    the positives and a part of the unlabelled rows; where only good text lies
    above, the quotient is the prior, and elsewhere it is larger. The border is
    the one whose quotient has the lowest upper confidence bound. A row is in
    the same half wherever it appears, since trusted documents are also part of
    the unlabelled text.
    """
    half_p, half_u = _half(x_p), _half(x_u)
    if min(half_p.sum(), (~half_p).sum(), half_u.sum(), (~half_u).sum()) < 4:
        return 0.5
    weights = _optimise(x_p[half_p], x_u[half_u], _against_unlabelled, seed, PRIOR_EPOCHS)
    on_p = np.sort(_forward(x_p[~half_p], weights)[0])
    on_u = np.sort(_forward(x_u[~half_u], weights)[0])
    part_p = 1 - np.arange(len(on_p)) / len(on_p)  # positives at or above each positive
    part_u = 1 - np.searchsorted(on_u, on_p) / len(on_u)
    slack = np.sqrt(np.log(40) / 2) * (len(on_u) ** -0.5 + len(on_p) ** -0.5)
    best = np.argmin((part_u + slack) / part_p)
    return float(np.clip(part_u[best] / part_p[best], FLOOR, CEILING))


def _half(x: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(row.tobytes()) & 1 for row in x], bool)


def train(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 1) -> Model:
    """Fit on rows of features; with no positives or no unlabelled rows every score is one half."""
    width = FEATURES
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.array(0.0)], 0.5)
    mean, spread = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    model = Model(mean, 1 / (spread + 1e-3), [], 0.5)
    x_p, x_u = model._scaled(positive), model._scaled(unlabelled)
    prior = estimate_prior(x_p, x_u, seed)

    def step(p, u, weights):
        f_p, h_p = _forward(p, weights)
        f_u, h_u = _forward(u, weights)
        # Sigmoid loss: loss(f) = s(-f), so loss(-f) = s(f); both have the slope s(f) s(-f), up to sign.
        s_p, s_u = _sigmoid(f_p), _sigmoid(f_u)
        flat_p, flat_u = prior * s_p * (1 - s_p) / len(p), s_u * (1 - s_u) / len(u)
        positives = _slopes(p, h_p, flat_p, weights)
        as_negative = [a - b for a, b in zip(_slopes(u, h_u, flat_u, weights), positives)]
        if s_u.mean() - prior * s_p.mean() < 0:
            return [-g for g in as_negative]
        return [a - b for a, b in zip(as_negative, positives)]

    model.prior = prior
    model.weights = _optimise(x_p, x_u, step, seed, EPOCHS)
    return model


def _described(df: DataFrame) -> DataFrame:
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(t).tobytes() for t in utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc_id", "x"])

    return map_batches(df, one, "doc_id long, x binary")


def _matrix(df: DataFrame) -> np.ndarray:
    rows = sorted((r.doc_id, bytes(r.x)) for r in _described(df).collect())
    return np.frombuffer(b"".join(x for _, x in rows), np.float32).reshape(-1, FEATURES).astype(np.float64)


def fit(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> Model:
    """Train on trusted positives (label 1) and unlabelled text, both bounded samples.

    Of the positives the ``sample`` documents with the smallest hash of their id
    are taken, of all text twice as many; the draw covers all rows, and only
    features of these documents reach the driver. Labels other than 1 teach
    nothing, and neither do rows without an id.
    """
    rows = documents(df, id_col, text_col).where("doc_id is not null")
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id"))

    def drawn(ids: DataFrame, salt: int, size: int) -> DataFrame:
        ids = stage(ids.distinct(), "ids")
        # The smallest hashes lie below twice their share of all hash values, so
        # only about twice the sample is sorted, whatever the number of rows.
        share = min(1.0, 2 * size / max(1, ids.count()))
        place = F.xxhash64("doc_id", F.lit(salt))
        low = ids.where(place < int(-(2**63) + share * 2**64)) if share < 1 else ids
        picked = low.orderBy(place, "doc_id").limit(size)
        # At most ``size`` ids: bounded by the parameter.
        return rows.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])

    ids = rows.select("doc_id")
    positive = _matrix(drawn(ids.join(good, "doc_id", "left_semi"), 1, sample))
    unlabelled = _matrix(drawn(ids, 2, 2 * sample))
    return train(positive, unlabelled)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; a null text counts as the empty one."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(1))
        scores = np.zeros(0)
        for at in range(0, len(texts), 512):
            x = np.stack([features(t) for t in texts[at : at + 512]])
            scores = np.concatenate([scores, model.score(x)])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
            ["doc_id", "score", "predicted"],
        )

    return map_batches(documents(df, id_col, text_col), one, "doc_id long, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from the training; a row without an id is not."""
    return F.coalesce(id_remainder(id_col, 3) == 1, F.lit(False))
