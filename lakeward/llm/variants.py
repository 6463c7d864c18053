"""Spelling variants of the words of a corpus, by sorted permuterm rotations.

A word is marked with a terminator and rotated to every place. The rotation that
starts behind a code point and ends before it, ``y$x`` for the word ``x c y``, is a
prefix range of the sorted rotations: it holds all words that have any other code
point there, and the whole rotation ``y$x`` of the word ``x y`` that lacks it. Words
of one range differ by one replaced, inserted or deleted code point, and words that
differ so share a range. A range holds at most one word per letter, and one.

So nothing is compared in pairs: rotations are sorted by range, and a scan of each
range tells every member how many others there are and which of them is commonest.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lakeward.llm.common import documents, ship_package, utf8
from lakeward.operators.ranking import number_rows
from lakeward.session import stage

LETTERS = "a-zÀ-ÿ"  # after A-Z are lower-cased
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
TERMINATOR = "$"
_WRITTEN_OUT = 64  # letters of a range up to which its rotation is written out; longer ones are digests
_HELD = 1 << 22  # code points of words that a task counts before it sends them on
_ROWS = 1 << 15  # rotations sent at a time

#: What becomes of a word of a document: ``(doc_id, word) -> word``.
Change = Callable[[int | None, str], str]


def drop_letters(doc_id: int | None, word: str) -> str:
    """One code point is deleted in one of 199 words, chosen by document and word; without an id none."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 199:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    change: Change | None = None,
) -> DataFrame:
    """``word, n``: how often each word of ``least_length`` code points or more occurs in whole texts.

    Words are maximal runs of letters, A-Z in lower case. Counted per task first, so
    a word in every document is a row per task and flush.
    """
    found = re.compile(f"[{LETTERS}]{{{least_length},}}").findall

    def flush(counts: Counter[str]) -> pa.RecordBatch:
        words = pa.array(counts.keys(), pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                # bytes.lower touches A-Z only.
                of = Counter(found(text.lower().decode())) if text else Counter()
                before = len(counts)
                for word, n in of.items():
                    if change is not None:
                        word = change(doc_id, word)
                        if len(word) < least_length:
                            continue
                    counts[word] += n
                    held += len(word) if len(word) > _WRITTEN_OUT else 0
                held += 16 * (len(counts) - before)
                if held >= _HELD:
                    yield flush(counts)
                    counts, held = Counter(), 0
        if counts:
            yield flush(counts)

    ship_package(df.sparkSession)
    words = documents(df, id_col, text_col).mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


_PRIME, _BASES = (1 << 61) - 1, (911382323, 972663749)


class _Digests:
    """Digests of the prefixes and suffixes of a long word, in time and space of its length."""

    def __init__(self, word: str):
        points = [ord(c) + 1 for c in word]
        self.sums, self.powers = [], []
        for base in _BASES:
            sums, powers = [0], [1]
            for p in points:
                sums.append((sums[-1] * base + p) % _PRIME)
                powers.append(powers[-1] * base % _PRIME)
            self.sums.append(sums)
            self.powers.append(powers)

    def rotation(self, start: int, end: int) -> str:
        """Name of the rotation ``word[end:]$word[:start]``; equal only for equal ones (122 bits)."""
        size = len(self.sums[0]) - 1
        name = f"{TERMINATOR}{TERMINATOR}{start}:{size - end}"
        for sums, powers in zip(self.sums, self.powers):
            name += f":{sums[start]:x}:{(sums[size] - sums[end] * powers[size - end]) % _PRIME:x}"
        return name


def rotations(word: str) -> Iterator[tuple[str, bool, bool]]:
    """``range, whole, first`` for every place of the word.

    ``whole``: the rotation itself, of a word without the code point that the other
    members of the range have. ``first``: the code point left out is the first of its
    like in a row, so that a pair of words that differ by a letter of a row counts once.
    """
    size = len(word)
    short, far = size - 1 <= _WRITTEN_OUT, None
    if size > _WRITTEN_OUT:
        far = _Digests(word)
    for i in range(size):
        name = word[i + 1 :] + TERMINATOR + word[:i] if short else far.rotation(i, i + 1)
        yield name, False, i == 0 or word[i - 1] != word[i]
    for i in range(size + 1):
        yield word[i:] + TERMINATOR + word[:i] if far is None else far.rotation(i, i), True, False


def _rotated(vocabulary: DataFrame) -> DataFrame:
    """Rotations of every word: ``range, whole, first, rank, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        flags: list[tuple[bool, bool, int, int]] = []

        def flush() -> pa.RecordBatch:
            whole, first, rank, n = zip(*flags)
            return pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(whole), pa.array(first), pa.array(rank, pa.int64()), pa.array(n, pa.int64())],
                ["range", "whole", "first", "rank", "n"],
            )

        for batch in batches:
            for word, rank, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for name, whole, first in rotations(word):
                    names.append(name)
                    flags.append((whole, first, rank, n))
                    if len(names) >= _ROWS:
                        yield flush()
                        names, flags = [], []
        if names:
            yield flush()

    ship_package(vocabulary.sparkSession)
    schema = "range string, whole boolean, first boolean, rank long, n long"
    return vocabulary.select("word", "rank", "n").mapInArrow(run, schema)


def _neighbours(vocabulary: DataFrame) -> DataFrame:
    """``rank, n_near, best``: how many words are near a word, and ``-n, rank`` of the commonest of them."""
    order = [F.col("range"), F.desc("n"), F.col("rank")]
    in_order = _rotated(vocabulary).repartitionByRange("range").sortWithinPartitions(*order)
    # The window finds its rows parted and sorted; a range has at most one row per letter, and one.
    members = Window.partitionBy("range").orderBy(*order[1:])
    members = members.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct((-F.col("n")).alias("minus_n"), F.col("rank").alias("rank"))
    seen = in_order.select(
        "rank", "whole", "first",
        F.count(F.lit(1)).over(members).alias("all"),
        F.count_if("whole").over(members).alias("shorter"),
        F.count_if("first").over(members).alias("longer"),
        F.first(entry).over(members).alias("top"),
        F.nth_value(entry, 2).over(members).alias("second"),
    ).where("all > 1")
    replaced = F.col("all") - F.col("shorter") - 1
    near = F.when(F.col("whole"), F.col("longer")).otherwise(
        replaced + F.when(F.col("first"), F.col("shorter")).otherwise(0)
    )
    other = F.when(F.col("top.rank") == F.col("rank"), F.col("second")).otherwise(F.col("top"))
    each = seen.select("rank", near.alias("near"), other.alias("other"))
    return each.groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("other").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``rank, root`` for every word that has a form: the last word of its chain of forms.

    Each round jumps twice as far; a form is commoner by the ratio, so chains are as
    long as the logarithm of the largest count at most.
    """
    jumps = stage(forms.select("rank", F.col("form").alias("root")), "forms")
    while True:
        ahead = jumps.select(F.col("rank").alias("_at"), F.col("root").alias("_next"))
        jumps = stage(
            jumps.join(ahead, F.col("root") == F.col("_at"), "left").select(
                "rank", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")
            ),
            "jumps",
        )
        if not jumps.where("moved").limit(1).count():
            return jumps.select("rank", "root")
        jumps = jumps.drop("moved")


def group_variants(
    counts: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the words of ``counts`` (``word, n``) that are long and common enough.

    Words are near if they differ by exactly one inserted, deleted or replaced code
    point. ``form`` is the near word with the largest ``n`` (of equals the smallest in
    code-point order) if that is ``ratio`` times the word's own at least, else null;
    ``root`` follows forms to the last, and is the word itself without a form. Null
    words and counts are left out, repeated words add up, no row gives no row. Words
    of any length are compared whole: rotations of more than 64 letters are named by
    122-bit digests, so a word of m letters costs m rows, not m texts. Stages the
    vocabulary and the forms, and runs Spark jobs while it is called.
    """
    if ratio < 2:
        raise ValueError("a form must be commoner than its variant, else chains have no end")
    words = counts.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n"))
    words = words.groupBy("word").agg(F.sum("n").alias("n"))
    words = words.where((F.length("word") >= least_length) & (F.col("n") >= least_count))
    vocabulary = stage(number_rows(words, [F.col("word").asc()], "rank"), "vocabulary")
    best = _neighbours(vocabulary)
    near = vocabulary.select("rank", "n").join(best, "rank", "left")
    form_n = -F.col("best.minus_n")
    enough = form_n >= F.lit(ratio) * F.col("n")
    near = stage(
        near.select(
            "rank",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.rank")).alias("form"),
            F.when(enough, form_n).alias("form_n"),
        ),
        "near",
    )
    roots = _roots(near.where("form IS NOT NULL"))
    named = vocabulary.select(F.col("rank").alias("_rank"), F.col("word").alias("_word"))
    out = vocabulary.join(near, "rank").join(roots, "rank", "left")
    out = out.join(named.withColumnsRenamed({"_rank": "form", "_word": "_form"}), "form", "left")
    out = out.join(named.withColumnsRenamed({"_rank": "root", "_word": "_root"}), "root", "left")
    return out.select(
        "word", F.col("_form").alias("form"), F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n"
    )
