"""SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

The automaton holds all pieces. One pass over a text reports, for each
position, every piece that ends there (the longest through the state, the
shorter ones through its output links); each report relaxes the best score at
that position, so the best segmentation is known when the pass ends. Ties go to
the longer last piece, as the library's lattice has it. A character that is no
piece costs more than any piece and is written as its UTF-8 bytes.

A space is a piece character (U+2581) and a text starts with one. Where no piece
reaches over the start of a word, which is checked for the vocabulary, words
(with the spaces before them) are segmented on their own and remembered, up to a
fixed number of them per worker.
U+2581 itself in a text is written as bytes, so decoding gives back every text
exactly.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from lakeward.llm.common import map_batches, utf8

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
PENALTY = 10.0  # below the lowest score, for a character that is no piece
REMEMBERED = 300_000  # words kept per worker; only speed depends on it
_ROWS = 256  # texts encoded at a time
_UNIT = re.compile(" *[^ ]+| +$")  # a word with all spaces before it, or the spaces at the end


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with ids and scores, and the ids of the 256 byte pieces."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    size: int

    @staticmethod
    def load(path: str = VOCABULARY) -> Vocabulary:
        """Read a model file; only its pieces and scores are used."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        by_byte = {model.id_to_piece(i): i for i in range(size) if model.is_byte(i)}
        bytes_ = tuple(by_byte[f"<0x{b:02X}>"] for b in range(256))
        pieces = tuple(
            (model.id_to_piece(i), i, model.get_score(i))
            for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        )
        return Vocabulary(pieces, bytes_, size)


class Codec:
    """Encoder and decoder of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.kind = np.dtype("<u2" if vocabulary.size <= 1 << 16 else "<u4")
        self.automaton = ahocorasick.Automaton()
        for piece, number, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score, number))
        self.automaton.make_automaton()
        self.single = {piece for piece, _, _ in vocabulary.pieces if len(piece) == 1}
        self.fallback = min((score for _, _, score in vocabulary.pieces), default=0.0) - PENALTY
        self.literal = list(vocabulary.byte_ids[b] for b in SPACE.encode())
        self.by_word = self._words_are_apart()
        self.known: dict[str, bytes] = {}
        self.parts: list[bytes] = [b""] * vocabulary.size
        for piece, number, _ in vocabulary.pieces:
            self.parts[number] = piece.replace(SPACE, " ").encode()
        for byte, number in enumerate(vocabulary.byte_ids):
            self.parts[number] = bytes([byte])

    def _words_are_apart(self) -> bool:
        """Whether a space can only begin a piece or be one of a run of spaces."""
        return all(set(p) == {SPACE} or SPACE not in p[1:] for p, _, _ in self.vocabulary.pieces)

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text whose spaces are piece characters."""
        n = len(text)
        best = [0.0] + [-np.inf] * n
        last: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done = 0  # positions up to here have their fallback
        single, fallback = self.single, self.fallback
        for end, (length, score, number) in self.automaton.iter(text):
            while done < end:
                if text[done] not in single and best[done] + fallback > best[done + 1]:
                    best[done + 1], last[done + 1] = best[done] + fallback, (done, -1)
                done += 1
            start = end + 1 - length
            total = best[start] + score
            if total > best[end + 1]:
                best[end + 1], last[end + 1] = total, (start, number)
        while done < n:
            if text[done] not in single and best[done] + fallback > best[done + 1]:
                best[done + 1], last[done + 1] = best[done] + fallback, (done, -1)
            done += 1
        out, at = [], n
        while at:
            start, number = last[at]
            if number >= 0:
                out.append(number)
            else:
                out.extend(self.vocabulary.byte_ids[b] for b in reversed(text[start:at].encode()))
            at = start
        out.reverse()
        return out

    def _whole(self, text: str) -> bytes:
        """Ids of a text that may hold U+2581 itself, which no piece may cover."""
        parts = text.split(SPACE)
        ids = self.segment(SPACE + parts[0].replace(" ", SPACE))
        for part in parts[1:]:
            ids += self.literal
            ids += self.segment(part.replace(" ", SPACE))
        return np.array(ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        ids = self._whole(word)
        if len(self.known) < REMEMBERED:
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian integers; none for a null or empty text."""
        if not text:
            return b""
        if not self.by_word:
            return self._whole(text)
        known = self.known
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = [unit[1:] for unit in _UNIT.findall(" " + text)]
        else:
            words = text.split(" ")
        return b"".join([known.get(w) or self._word(w) for w in words])

    def decode(self, ids) -> bytes:
        """The text as UTF-8, without the space that encoding puts first."""
        parts = self.parts
        return b"".join([parts[i] for i in ids])[1:]


_codecs: dict[int, Codec] = {}


def codec_of(vocabulary: Vocabulary) -> Codec:
    """One codec per worker and vocabulary, with its remembered words."""
    number = hash((vocabulary.size, vocabulary.pieces))
    if number not in _codecs:
        _codecs.clear()
        _codecs[number] = Codec(vocabulary)
    return _codecs[number]


def _shared(df: DataFrame, vocabulary: Vocabulary):
    # A vocabulary is a few hundred kilobytes whatever the data.
    return df.sparkSession.sparkContext.broadcast(vocabulary)


def encode(
    df: DataFrame,
    vocabulary: Vocabulary,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """The id column, the columns in ``keep``, ``ids`` (array of int) and ``exact`` for every row.

    ``exact`` tells whether the ids decode to the text; a null text counts as
    the empty one and has no ids. ``keep`` may hold any column whose name is
    neither ``ids`` nor ``exact``.
    """
    shared = _shared(df, vocabulary)
    kept = [id_col, *(keep or [])]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = codec_of(shared.value)
        column = batch.column(batch.num_columns - 1)
        texts = column.to_pylist()
        encoded = [codec.encode(t) for t in texts]
        ids = np.frombuffer(b"".join(encoded), codec.kind).astype(np.int32)
        sizes = np.array([len(e) // codec.kind.itemsize for e in encoded], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        whole = ids.tolist()
        exact = [codec.decode(whole[a:b]) == (t or b"") for a, b, t in zip(ends[:-1], ends[1:], utf8(column))]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        return pa.RecordBatch.from_arrays([*columns, lists, pa.array(exact)], [*kept, "ids", "exact"])

    given = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return map_batches(given, one, f"{fields}, ids array<int>, exact boolean", _ROWS)


def decode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of rows of ids; null ids give a null text, bytes that are no UTF-8 a replacement mark."""
    shared = _shared(df, vocabulary)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = codec_of(shared.value)
        texts = [None if ids is None else codec.decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    given = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return map_batches(given, one, "doc_id long, text string", _ROWS)


def vocabulary_path() -> str:
    """Where the public vocabulary lies: the installed package, else ``VOCABULARY``."""
    try:
        import public_tokenizers
    except ImportError:
        return VOCABULARY
    return public_tokenizers.path(os.path.basename(VOCABULARY))
