"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap.

The test items form an inverted index. Every passage of every training text is
a query: all items whose BM25 score reaches the threshold are retrieved, and a
retrieved item counts as leaked when the word n-grams of its question, and of
its answer where it has one, are found in the passage.

Scores are shares: an item's score for a passage is the sum of the BM25 weights
of the item's terms that the passage holds, divided by the sum over all its
terms, so an item that is quoted whole scores 1 and one threshold serves items
of any length. Passages are windows of words, long enough that any item lies
whole in one of them.

The threshold alone could miss a leak: an item whose few rare words are the ones
left out scores low although nearly all its n-grams are there. So every item has
its own threshold, the smaller of the given one and the least share that a passage
with enough of its n-grams can have. A word is missing only where all n-grams with
it are; spread over these, its weight makes each n-gram worth something, and the
n-grams that may be missing are worth at most what the dearest of them are. The
weights of an item with a lower threshold are raised until the given one fits it.

Retrieval never scores an item that cannot reach the threshold. Items are
sorted by length and cut into blocks; for every term the largest weight in each
block is known. A passage first adds these block maxima, and blocks below the
threshold are left out. In the others WAND walks the posting lists in item
order: with cursors sorted by item, the pivot is the first cursor at which the
sum of the lists' maxima reaches the threshold; items before it are skipped.

The index is shipped to the tasks in shards of at most ``SHARD`` items; the bytes
of their texts and of their block maxima (terms x blocks) are both bounded. A
larger benchmark is run shard by shard.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakeward.llm.common import documents, filter_rows, map_batches

K1, B = 1.2, 0.75
THRESHOLD = 0.7  # share of an item's BM25 weight that a passage must hold
GRAM = 5  # words of an n-gram in the final check
OVERLAP = 0.8  # share of an item's n-grams that the passage must hold
BLOCK = 8  # items of a block
PASSAGE = 128  # words of a passage at least
SHARD = 2_000  # items of an index shard
_PASSAGES = 512  # passages of a text that are bounded at a time
SHARD_BYTES = 64 << 20  # text of a shard, a bound for what is broadcast
INDEX_BYTES = 64 << 20  # block maxima of a shard, another

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words: letters, digits and underscores; marks and case play no part."""
    return _WORD.findall(text.lower()) if text else []


def grams(words: list[str], size: int = GRAM) -> set[tuple[str, ...]]:
    """Word n-grams; a shorter sequence is its own only one, none has none."""
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


@dataclass(frozen=True)
class Item:
    item_id: int
    question: str
    answer: str | None


def least_share(weights: dict[str, float], parts: list[set[tuple[str, ...]]], overlap: float) -> float:
    """A share of the weights that every passage with ``overlap`` of the n-grams of each part has.

    ``weights`` are those of an item's words, ``parts`` the n-grams of its question and answer.
    """
    parts = [p for p in parts if p]
    spare = [sum((len(p) - n) / len(p) >= overlap for n in range(1, len(p) + 1)) for p in parts]
    within = [Counter(word for gram in p for word in set(gram)) for p in parts]
    lost = 0.0
    placed: set[str] = set()  # a word of both parts must be missing in both, and counts in the first
    for part, may, counts in zip(parts, spare, within):
        gone = {w for w in counts if all(c[w] <= n for c, n in zip(within, spare))} - placed
        worth = sorted((sum(weights[w] / counts[w] for w in set(gram) & gone) for gram in part), reverse=True)
        lost += sum(worth[:may])
        placed |= gone
    whole = sum(weights.values())
    return max(0.0, 1 - lost / whole) if whole else 0.0


class Index:
    """Inverted index of test items with block maxima."""

    def __init__(
        self,
        items: list[Item],
        frequency: dict[str, int],
        total: int,
        mean: float,
        threshold: float = THRESHOLD,
        overlap: float | None = None,
    ):
        """``frequency``, ``total``, ``mean``: items per term, items and words per item of the whole benchmark.

        With ``overlap``, weights are raised so that no passage that holds so much of an
        item's n-grams stays below ``threshold``; without it, they are plain shares.
        """
        self.words = [words_of(i.question) + words_of(i.answer) for i in items]
        order = sorted(range(len(items)), key=lambda k: (len(self.words[k]), items[k].item_id))
        self.items = [items[k] for k in order]
        self.words = [self.words[k] for k in order]
        self.longest = max(map(len, self.words), default=0)
        self.terms: dict[str, int] = {}
        self.postings: list[tuple[list[int], list[float]]] = []
        self.questions = [grams(words_of(i.question)) for i in self.items]
        self.answers = [grams(words_of(i.answer)) for i in self.items]
        self.raised: list[float] = []  # what an item's shares are multiplied by
        for n, words in enumerate(self.words):
            weights = {}
            for word, count in Counter(words).items():
                df = frequency.get(word, 0)
                idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
                weights[word] = idf * count * (K1 + 1) / (count + K1 * (1 - B + B * len(words) / max(mean, 1e-9)))
            whole = sum(weights.values())
            least = threshold if overlap is None else least_share(weights, [self.questions[n], self.answers[n]], overlap)
            self.raised.append(max(1.0, threshold / max(least, 1e-6)))
            for word, weight in weights.items():
                t = self.terms.setdefault(word, len(self.terms))
                if t == len(self.postings):
                    self.postings.append(([], []))
                self.postings[t][0].append(n)
                self.postings[t][1].append(weight / whole * self.raised[n])
        self.blocks = -(-len(items) // BLOCK)
        # One row more: words that no item has add nothing.
        self.block_max = np.zeros((len(self.terms) + 1, max(self.blocks, 1)), np.float32)
        for t, (at, weights) in enumerate(self.postings):
            np.maximum.at(self.block_max[t], np.array(at) // BLOCK, np.array(weights, np.float32))

    def passages(self, count: int) -> list[tuple[int, int]]:
        """Word ranges of the passages of a text: any item is whole in one of them."""
        size = max(PASSAGE, 2 * self.longest)
        step = size - self.longest
        return [(at, min(at + size, count)) for at in range(0, max(1, count - self.longest + 1), max(step, 1))]

    def retrieve(self, terms: list[int], blocks: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items in ``blocks`` that reach ``threshold`` with the distinct ``terms``, and their shares, by WAND."""
        found = []
        for block in blocks:
            first, last = block * BLOCK, (block + 1) * BLOCK
            cursors = []  # [item, list, place in it]; only the part of a list within the block
            for t in terms:
                top = self.block_max[t, block]
                if top > 0:
                    at = bisect_left(self.postings[t][0], first)
                    cursors.append([self.postings[t][0][at], t, at, float(top)])
            while cursors:
                cursors.sort()
                bound, pivot = 0.0, -1
                for n, cursor in enumerate(cursors):
                    bound += cursor[3]
                    if bound >= threshold - 1e-6:
                        pivot = n
                        break
                if pivot < 0:
                    break
                item = cursors[pivot][0]
                if cursors[0][0] == item:
                    score = sum(self.postings[t][1][at] for n, t, at, _ in cursors if n == item)
                    if score >= threshold - 1e-9:
                        found.append((item, min(score / self.raised[item], 1.0)))
                    target = item + 1
                else:
                    target = item
                moved = []
                for cursor in cursors:
                    if cursor[0] < target:
                        at = bisect_left(self.postings[cursor[1]][0], target, cursor[2])
                        if at == len(self.postings[cursor[1]][0]) or self.postings[cursor[1]][0][at] >= last:
                            continue
                        cursor[0], cursor[2] = self.postings[cursor[1]][0][at], at
                    moved.append(cursor)
                cursors = moved
        return found

    def leaks(self, text: str | None, threshold: float, overlap: float) -> list[tuple[int, float, float, float | None, int]]:
        """``(item_id, score, question overlap, answer overlap, first word)`` of the best passage per leaked item."""
        words = words_of(text)
        if not words or not self.items:
            return []
        best: dict[int, tuple] = {}
        ranges = np.array(self.passages(len(words)))
        for at in range(0, len(ranges), _PASSAGES):  # a long text is a run of shorter ones
            part = ranges[at : at + _PASSAGES]
            self._leaks_of(words[part[0, 0] : part[-1, 1]], part - part[0, 0], int(part[0, 0]), threshold, overlap, best)
        return [best[i] for i in sorted(best)]

    def _leaks_of(self, words: list[str], ranges: np.ndarray, before: int, threshold: float, overlap: float, best: dict) -> None:
        """Leaks in some passages of a text, ``before`` words after its start, added to ``best``."""
        none = len(self.terms)
        ids = np.fromiter((self.terms.get(w, none) for w in words), np.int64, len(words))
        known = np.nonzero(ids < none)[0]
        if not len(known):
            return
        # Sums of block maxima up to each known word: a passage's bound is a difference of two.
        sums = np.zeros((len(known) + 1, self.block_max.shape[1]), np.float64)
        np.cumsum(self.block_max[ids[known]], axis=0, dtype=np.float64, out=sums[1:])
        lo, hi = np.searchsorted(known, ranges[:, 0]), np.searchsorted(known, ranges[:, 1])
        hopeful = ((sums[hi] - sums[lo]) >= threshold - 1e-6).any(axis=1)
        for p in np.nonzero(hopeful)[0]:
            terms = np.unique(ids[known[lo[p] : hi[p]]])
            bounds = self.block_max[terms].sum(axis=0, dtype=np.float64)
            blocks = np.nonzero(bounds >= threshold - 1e-6)[0]
            if not len(blocks):
                continue
            start, end = ranges[p]
            held = None
            for n, score in self.retrieve(terms.tolist(), blocks, threshold):
                held = grams(words[start:end]) if held is None else held
                asked = self._held(self.questions[n], held, words[start:end])
                answered = self._held(self.answers[n], held, words[start:end])
                if (asked is None or asked >= overlap) and (answered is None or answered >= overlap):
                    item = self.items[n].item_id
                    row = (item, float(score), asked, answered, before + int(start))
                    if item not in best or row[1] > best[item][1]:
                        best[item] = row

    @staticmethod
    def _held(wanted: set, held: set, words: list[str]) -> float | None:
        """Share of the n-grams held by a passage; null where there is nothing to hold."""
        if not wanted:
            return None
        size = len(next(iter(wanted)))
        if size < GRAM:  # a sequence shorter than an n-gram
            held = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        return len(wanted & held) / len(wanted)


def _item_rows(items: DataFrame, id_col: str, question_col: str, answer_col: str | None) -> DataFrame:
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    return items.select(
        F.col(id_col).cast("long").alias("item_id"), F.col(question_col).alias("question"), answer.alias("answer")
    ).where("item_id is not null and (question is not null or answer is not null)").distinct()


def build_indexes(
    items: DataFrame,
    id_col: str = "item_id",
    question_col: str = "text",
    answer_col: str | None = None,
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
):
    """One ``Index`` per shard of the benchmark, made one after another.

    Only the benchmark reaches the driver, a shard at a time. Items without a
    word or an id cannot leak; an item given twice with different texts is
    several items with one id.
    """
    rows = _item_rows(items, id_col, question_col, answer_col)
    frequency: dict[str, int] = defaultdict(int)
    total = length = 0
    shards: list[list[Item]] = [[]]
    size, known = 0, set()
    for row in rows.orderBy("item_id", "question", "answer").toLocalIterator():
        item = Item(row.item_id, row.question or "", row.answer)
        words = words_of(item.question) + words_of(item.answer)
        if not words:
            continue
        terms = set(words)
        for word in terms:
            frequency[word] += 1
        total, length = total + 1, length + len(words)
        held = len(item.question) + len(item.answer or "")
        maxima = 4 * (len(known) + len(terms - known) + 1) * (len(shards[-1]) // BLOCK + 1)
        if shards[-1] and (len(shards[-1]) >= SHARD or size + held > SHARD_BYTES or maxima > INDEX_BYTES):
            shards.append([])
            size, known = 0, set()
        shards[-1].append(item)
        size += held
        known |= terms
    for shard in shards:
        if shard:
            yield Index(shard, frequency, total, length / total, threshold, overlap)


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def find_leaks(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    question_col: str = "text",
    answer_col: str | None = None,
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
) -> DataFrame:
    """One row per document row and leaked test item; clean documents have none.

    ``score`` is the BM25 share, ``question_overlap`` and ``answer_overlap`` the
    shares of n-grams found (null where the item has none), ``first_word`` the
    first word of the passage. Null and empty texts leak nothing; an empty
    benchmark gives an empty result; repeated rows give repeated results. An item
    with a share below ``threshold`` is found too where its n-grams reach ``overlap``.
    Collects the benchmark (never the documents) while it is called.
    """
    spark, docs = df.sparkSession, documents(df, id_col, text_col)
    out = None
    for index in build_indexes(items, item_id_col, question_col, answer_col, threshold, overlap):
        shared = spark.sparkContext.broadcast(index)

        def one(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            held = shared.value
            rows = [
                (doc, *leak)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for leak in held.leaks(text, threshold, overlap)
            ]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            columns = zip(*rows) if rows else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
            )

        part = map_batches(docs, one, SCHEMA)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def clean_rows(
    df: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    question_col: str = "text",
    answer_col: str | None = None,
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
) -> DataFrame:
    """The rows of ``df`` whose text leaks no item, with all their columns and no shuffle.

    Null and empty texts leak nothing and stay.
    """
    for index in build_indexes(items, item_id_col, question_col, answer_col, threshold, overlap):
        shared = df.sparkSession.sparkContext.broadcast(index)

        def keep(texts: pa.Array, shared=shared) -> list[bool]:
            return [not shared.value.leaks(t, threshold, overlap) for t in texts.to_pylist()]

        df = filter_rows(df, keep, text_col)
    return df
