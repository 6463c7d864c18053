"""Token ids in files of Re-Pair grammars, with random access.

Texts are encoded, an end id is put after each, and the ids of all documents in
id order are cut into blocks of whole documents. A block is compressed by
Re-Pair: the most frequent pairs of neighbouring symbols are replaced by new
symbols (nonterminals), again and again, until the pairs left are rare. A block
holds its rules, the expansion length of every rule, and the remaining
sequence. From the lengths follows which symbols cover any range of ids, so a
range is decoded without the rest.

A round replaces many pairs at once, the frequent ones first; where two
replacements would overlap, the left one is made.

The files are Parquet, one row per block: every task writes the blocks of its
own range of ids, and a lost task is written again. Ids start anywhere in the
whole sequence by adding three numbers: the ids in earlier shards (one row per
shard), in earlier blocks of the shard, and in earlier documents of the block.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from lakeward.llm.common import documents, ship_package

END = 0  # id after each document
BLOCK_IDS = 1 << 21  # ids of a block at least, but for the last of a shard
ROUND_RULES = 4096  # pairs replaced in a round at most
MIN_COUNT = 8  # a rarer pair costs more as a rule than it saves
MIN_GAIN = 0.01  # a round that shortens the sequence by less is the last
SYMBOLS = 1 << 16  # ids and rules together, so a symbol has 16 bits
REMEMBERED = 1_200_000  # words kept per worker; only speed depends on it
_LINES = 2_000  # words encoded as one text
_SLICE = 4 << 20  # characters encoded at a time
_SLOTS = 20  # bits of the table of a round's pairs
_AFTER_SPACE = re.compile(r"[^\S ] ")
_SPACE = re.compile(r"\s")
_ODD = re.compile(r"(?<=\s) (?=\s|\Z)")


# ---------------------------------------------------------------- encoding


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library.

    With the byte-level pattern a new token always begins at a space that
    follows no white space or is followed by other characters. There a text can
    be cut, and the library's ids of each word are remembered. Texts in which a
    space stands elsewhere go to the library whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        parts = json.loads(definition)
        cut = parts.get("pre_tokenizer") or {}
        self.by_word = (
            cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space")
            and not parts.get("normalizer")
            and parts.get("truncation") is None
            and parts.get("padding") is None
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"] for a in parts.get("added_tokens", []))
        )
        breaks = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_word = self.by_word and len(breaks) == 1
        self.line_break = breaks[0] if len(breaks) == 1 else None
        self.first: dict[str, bytes] = {}  # words at the start of a text
        self.later: dict[str, bytes] = {}  # words after a space

    def _bytes(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text; none for null."""
        out: list[bytes] = [b""] * len(texts)
        whole, cut, first = [], [], {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_word or _odd_space(text):
                whole.append(i)
                continue
            start, *words = text.split(" ")
            first[i] = start
            cut.append((i, words, list(map(self.later.get, words))))
        for i, ids in zip(whole, self._bytes([texts[i] for i in whole])):
            out[i] = ids
        missing = {w for _, words, found in cut if None in found for w, ids in zip(words, found) if ids is None}
        fresh = self._learn(self.later, missing, " ")
        starts = self._learn(self.first, {w for w in first.values() if w not in self.first}, "")
        for i, words, found in cut:
            if None in found:
                found = [fresh[w] if ids is None else ids for w, ids in zip(words, found)]
            begin = first[i]
            out[i] = (starts[begin] if begin in starts else self.first[begin]) + b"".join(found)
        return out

    def _learn(self, known: dict[str, bytes], missing: set[str], before: str) -> dict[str, bytes]:
        """Ids of words by the library; remembered while there is room.

        Words without white space are encoded as the lines of one text: a line
        break is a token of its own before a space and before a letter alike.
        """
        lines, odd = [], []
        for w in missing:
            (odd if _SPACE.search(w) else lines).append(w)
        fresh = dict(zip(odd, self._bytes([before + w for w in odd])))
        for at in range(0, len(lines), _LINES):
            part = lines[at : at + _LINES]
            # In a batch of one, as only batches can leave out the places of tokens.
            found = self.tokenizer.encode_batch_fast(["\n".join([before + w for w in part])], add_special_tokens=False)
            ids = np.array(found[0].ids, self.kind)
            ends = np.flatnonzero(ids == self.line_break).tolist()
            if len(ends) != len(part) - 1:  # a word that holds the break's id
                fresh.update(zip(part, self._bytes([before + w for w in part])))
                continue
            raw, width = ids.tobytes(), self.kind.itemsize
            fresh.update(
                (w, raw[a * width : b * width]) for w, a, b in zip(part, [0, *(e + 1 for e in ends)], [*ends, len(ids)])
            )
        if len(known) + len(fresh) <= REMEMBERED:
            known.update(fresh)
        return fresh


def _odd_space(text: str) -> bool:
    """Whether a space follows white space without being followed by another character."""
    if "  " not in text and not _AFTER_SPACE.search(text):
        return False
    return _ODD.search(text) is not None


_encoders: dict[int, Encoder] = {}


def encoder_of(definition: str) -> Encoder:
    """One encoder per worker and tokenizer, with its remembered words."""
    number = zlib.crc32(definition.encode())
    if number not in _encoders:
        _encoders.clear()
        _encoders[number] = Encoder(definition)
    return _encoders[number]


# ---------------------------------------------------------------- grammar


@dataclass
class Grammar:
    """``base + k`` stands for ``left[k], right[k]``, which expand to ``length[k]`` ids."""

    base: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    sequence: np.ndarray

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol stands for."""
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        out[rule] = self.length[symbols[rule] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of a run of symbols."""
        starts = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        flat = np.empty(starts[-1], np.uint32)
        for k in range(len(self.left)):  # rules only use earlier ones
            at = starts[k]
            for symbol in (int(self.left[k]), int(self.right[k])):
                if symbol < self.base:
                    flat[at] = symbol
                    at += 1
                else:
                    a, b = starts[symbol - self.base], starts[symbol - self.base + 1]
                    flat[at : at + b - a] = flat[a:b]
                    at += b - a
        lengths = self.lengths(symbols)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        # Plain symbols follow the expansions in one source array.
        source = np.concatenate([flat, np.arange(self.base, dtype=np.uint32)])
        rule = symbols >= self.base
        origin = symbols.astype(np.int64) + len(flat)
        origin[rule] = starts[symbols[rule].astype(np.int64) - self.base]
        return source[np.arange(total) + np.repeat(origin - (ends - lengths), lengths)]

    def slice(self, first: int, last: int) -> np.ndarray:
        """The ids ``first`` to ``last`` (not included), from the symbols that cover them alone."""
        ends = np.cumsum(self.lengths(self.sequence))
        lo, hi = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "left") + 1
        before = int(ends[lo - 1]) if lo else 0
        return self.expand(self.sequence[lo:hi])[first - before : last - before]


def repair(ids: np.ndarray, base: int, symbols: int = SYMBOLS) -> Grammar:
    """Re-Pair of a block; ids are below ``base``, which is at most ``symbols``."""
    sequence = ids.astype(np.uint32)
    left, right, length = ([np.zeros(0, np.uint32)] for _ in range(3))
    count = 0
    # Two symbols of 16 bits make a key of 32, which sorts faster.
    half, kind = (16, np.uint32) if symbols <= 1 << 16 else (32, np.uint64)
    while count < symbols - base and len(sequence) > 1:
        keys = (sequence[:-1].astype(kind) << kind(half)) | sequence[1:].astype(kind)
        ordered = np.sort(keys)
        borders = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        often = np.diff(borders)
        pick = np.flatnonzero(often >= MIN_COUNT)
        if not len(pick):
            break
        room = min(ROUND_RULES, symbols - base - count)
        pick = pick[np.argsort(-often[pick], kind="stable")[:room]]
        pairs = ordered[borders[pick]]
        # A table by hash; of pairs with one slot the most frequent is replaced now.
        slot = _slot(pairs)
        _, firsts = np.unique(slot, return_index=True)
        pairs, slot = pairs[np.sort(firsts)], slot[np.sort(firsts)]
        table = np.zeros(1 << _SLOTS, np.uint64)
        rule = np.zeros(1 << _SLOTS, np.uint32)
        table[slot], rule[slot] = pairs.astype(np.uint64) + np.uint64(1), np.arange(len(pairs), dtype=np.uint32)
        where = _slot(keys)
        places = np.flatnonzero(table[where] == keys.astype(np.uint64) + np.uint64(1))
        # In a run of overlapping places every second one is replaced.
        opens = np.concatenate([[True], np.diff(places) != 1])
        run = places[opens][np.cumsum(opens) - 1]
        places = places[(places - run) % 2 == 0]
        used, compact = np.unique(rule[where[places]], return_inverse=True)
        rules = pairs[used]
        new_left, new_right = (rules >> kind(half)).astype(np.uint32), (rules & kind((1 << half) - 1)).astype(np.uint32)
        sizes = np.concatenate(length)
        left.append(new_left), right.append(new_right)
        length.append(_length_of(new_left, base, sizes) + _length_of(new_right, base, sizes))
        sequence[places] = (base + count + compact).astype(np.uint32)
        kept = np.ones(len(sequence), bool)
        kept[places + 1] = False
        before, sequence = len(sequence), sequence[kept]
        count += len(used)
        if before - len(sequence) < MIN_GAIN * before:
            break
    return Grammar(base, *(np.concatenate(x) for x in (left, right, length)), sequence)


def _slot(pairs: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)


def _length_of(symbols: np.ndarray, base: int, sizes: np.ndarray) -> np.ndarray:
    out = np.ones(len(symbols), np.uint32)
    rule = symbols >= base
    out[rule] = sizes[symbols[rule] - base]
    return out


# ---------------------------------------------------------------- files

FILE_SCHEMA = (
    "shard int, block int, first long, n_ids long, base int, width int, doc_ids array<long>, doc_sizes array<long>, "
    "rule_left binary, rule_right binary, rule_length binary, sequence binary"
)
_FIELDS = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
        ("base", pa.int32()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())),
        ("rule_left", pa.binary()), ("rule_right", pa.binary()), ("rule_length", pa.binary()), ("sequence", pa.binary()),
    ]
)


def _block_row(shard: int, block: int, first: int, docs: list, ids: np.ndarray, base: int) -> pa.RecordBatch:
    g = repair(ids, base, max(SYMBOLS, base))
    width = 2 if base + len(g.left) <= 1 << 16 else 4
    kind = f"<u{width}"
    values = [
        shard, block, first, len(ids), base, width, [d for d, _ in docs], [n for _, n in docs],
        *(x.astype(k).tobytes() for x, k in ((g.left, kind), (g.right, kind), (g.length, "<u4"), (g.sequence, kind))),
    ]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _FIELDS)], schema=_FIELDS)


def write(
    df: DataFrame,
    path: str,
    definition: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end: int = END,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Write the ids of all documents below ``path`` in id order (nulls last; ties by text hash).

    ``definition`` is the tokenizer as JSON. A null or empty text is its end id
    alone. Repeated rows are written repeated. Overwrites what is at ``path``.
    """
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(definition)  # of fixed size, whatever the data
    order = [F.col("doc_id").asc_nulls_last(), F.col("_tie")]
    ordered = (
        documents(df, id_col, text_col)
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        tail = np.array([end], encoder.kind).tobytes()
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        docs, held, count = [], [], 0
        for doc_ids, encoded in _slices(batches, encoder):
            for doc, ids in zip(doc_ids, encoded):
                ids += tail
                held.append(ids)
                size = len(ids) // encoder.kind.itemsize
                docs.append((doc, size))
                count += size
                if count >= block_ids:
                    yield _block_row(shard, block, first, docs, np.frombuffer(b"".join(held), encoder.kind), encoder.size)
                    block, first, docs, held, count = block + 1, first + count, [], [], 0
        if docs:
            yield _block_row(shard, block, first, docs, np.frombuffer(b"".join(held), encoder.kind), encoder.size)

    ordered.mapInArrow(run, FILE_SCHEMA).write.mode("overwrite").parquet(path)


def _slices(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = size = 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= _SLICE or i + 1 == len(texts):
                yield ids[at : i + 1], encoder.encode(texts[at : i + 1])
                at, size = i + 1, 0


def grammar_of(row: dict) -> Grammar:
    """The grammar of a row of the files."""
    kind = f"<u{row['width']}"
    return Grammar(
        row["base"],
        *(
            np.frombuffer(row[c], k).astype(np.uint32)
            for c, k in (("rule_left", kind), ("rule_right", kind), ("rule_length", "<u4"), ("sequence", kind))
        ),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files.

    ``start`` counts the ids of all earlier documents; the checksum is over all
    ids of the document, end id included, as 32-bit little-endian integers.
    """
    ship_package(spark)
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard, a shard being a partition of the write: the window and
    # the broadcast are bounded by the number of partitions.
    starts = (
        blocks.groupBy("shard").agg(F.sum("n_ids").alias("_ids"))
        .select("shard", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_start"))
    )
    placed = blocks.join(F.broadcast(starts), "shard").withColumn("first", F.col("first") + F.col("_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                g = grammar_of(row)
                ids = g.expand(g.sequence).astype("<u4").tobytes()
                sizes = np.array(row["doc_sizes"], np.int64)
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends - sizes, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.select(*[f.split(" ")[0] for f in FILE_SCHEMA.split(", ")]).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def read_ids(spark: SparkSession, path: str, first: int, last: int) -> list[int]:
    """The ids ``first`` to ``last`` (not included) of the whole sequence, by random access.

    Only blocks that hold part of the range are read, and of them only the
    symbols that cover it are expanded. For ranges that fit in memory.
    """
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    out: list[int] = []
    start = 0
    for shard in sizes:
        if start < last and start + shard.n > first:
            lo, hi = first - start, last - start
            rows = blocks.where((F.col("shard") == shard.shard) & (F.col("first") < hi) & (F.col("first") + F.col("n_ids") > lo))
            for row in rows.orderBy("block").toLocalIterator():
                a, b = max(0, lo - row["first"]), min(row.n_ids, hi - row["first"])
                out += grammar_of(row.asDict()).slice(a, b).tolist()
        start += shard.n
    return out


def tokenizer_definition(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer as JSON; its file is read on the driver only."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()
