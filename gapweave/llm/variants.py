"""Spelling variants by neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols, so that words become reduced words over a small alphabet. Words one edit apart
have reduced words at most one edit apart, and over a small alphabet all strings one edit away can be
written out. Being one edit away is mutual: each reduced word writes the part of its neighbourhood that lies below it
(itself, every deletion, every smaller symbol in every place), and the part above is written by the words there. What
is written is joined with the reduced vocabulary, and the words of the pairs found are verified on their own letters.
Reduced words travel as 64-bit hashes, taken from prefix sums, so that a neighbour costs one number whatever
its length; equal hashes can only add pairs to verify.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import ASCII_LOWER, slices, spill
from gapweave.llm.hashing import BYTE, mix, powers
from gapweave.session import shuffle_width

#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: Distinct words that a task counts before it hands them on.
HELD = 100_000
#: Texts of more characters are read run by run.
LONG = 1 << 20
_RUN = re.compile("[a-zÀ-ÿ]+")
_BASE = int(powers(2)[1])
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def letter_lost(every: int) -> Callable[[int, str], str]:
    """A rule that takes one letter from a run where ``every`` divides the crc32 of ``<id>:<run>``."""

    def rule(prefix: int, run: str) -> str:
        h = zlib.crc32(run.encode(), prefix)
        if h % every:
            return run
        k = h % len(run)
        return run[:k] + run[k + 1 :]

    return rule


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3, change: Callable[[int, str], str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of Latin letters, lower case in A-Z, of ``shortest`` letters that occur ``least`` times.

    ``change`` gives what a run counts as, from the crc32 of ``<id>:`` (a null id is an empty text) and the run. A
    null text has no words. Counts are added up in each task before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def close() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = (text or "").translate(ASCII_LOWER) if text and not text.isascii() else (text or "").lower()
                found = Counter(_RUN.findall(text) if len(text) < LONG else (m[0] for m in _RUN.finditer(text)))
                prefix = zlib.crc32(f"{key}:".encode())
                for word, n in found.items():
                    if change:
                        word = change(prefix, word)
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= HELD:
                    yield close()
        if held:
            yield close()

    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def reduce(word: str, symbols: int = SYMBOLS) -> np.ndarray:
    """The symbols of a word's letters: code points modulo their number."""
    return np.frombuffer(word.encode("latin-1"), np.uint8) % symbols


def _hash(total: np.ndarray, length: int) -> np.ndarray:
    return mix(total + np.uint64(length * 0x9E3779B97F4A7C15 % (1 << 64)))


def key(reduced: np.ndarray) -> int:
    """64 bits that stand for a reduced word."""
    return int(_hash((BYTE[reduced] * powers(len(reduced))).sum(keepdims=True), len(reduced)).view(np.int64)[0])


def below(words: list[np.ndarray], symbols: int = SYMBOLS, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(place, key): keys of each reduced word, of its deletions, and of what one smaller symbol makes of it; each once.

    Words of one length are worked on together, about ``cells`` letters at a time.
    """
    lengths = np.array([len(w) for w in words])
    owners, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in np.unique(lengths).tolist():
        alike, step = np.flatnonzero(lengths == n), max(1, cells // max(n, 1))
        p = powers(n + 1)
        for at in range(0, len(alike), step):
            mine = alike[at : at + step]
            x = np.stack([words[k] for k in mine])
            sums = np.zeros((len(mine), n + 1), np.uint64)
            np.cumsum(BYTE[x] * p[:n], axis=1, out=sums[:, 1:])
            owners.append(mine)
            keys.append(_hash(sums[:, n], n))
            shorter = sums[:, :n] + (sums[:, n:] - sums[:, 1:]) * _BACK
            row, place = np.nonzero(np.concatenate((np.ones((len(mine), 1), bool), x[:, 1:] != x[:, :-1]), axis=1)[:, :n])
            owners.append(mine[row])  # of equal letters in a row, the first is deleted
            keys.append(_hash(shorter[row, place], n - 1))
            for s in range(symbols - 1):
                row, place = np.nonzero(x > s)
                owners.append(mine[row])
                keys.append(_hash(sums[row, n] + (BYTE[s] - BYTE[x[row, place]]) * p[place], n))
    return np.concatenate(owners), np.concatenate(keys).view(np.int64)


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, a_n, b, b_n): each unordered pair of distinct words one inserted, deleted or replaced letter apart.

    ``words`` has word (distinct, letters below U+0100) and n; see the head of the module. A word of any length takes
    a few numbers for each letter.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            reduced = [reduce(w, symbols) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([key(r) for r in reduced], pa.int64()), pa.array([r.tobytes() for r in reduced], pa.binary())], ["word", "n", "k", "reduced"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            place, held = below([np.frombuffer(r, np.uint8) for r in batch.column(1).to_pylist()], symbols)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), pa.array(held)], ["x", "y"])

    table = spill(words.select("word", "n").mapInArrow(keyed, "word string, n long, k long, reduced binary"))
    # words are few bytes and their neighbourhoods much work: spread by number, not by size
    reduced = table.groupBy("reduced").agg(F.min("k").alias("k")).select("k", "reduced").repartition(shuffle_width(words.sparkSession))
    known = table.select(F.col("k").alias("y")).distinct()
    pairs = spill(reduced.mapInArrow(neighbours, "x long, y long").join(known, "y").select("x", "y").distinct())
    a = table.select(F.col("k").alias("x"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = table.select(F.col("k").alias("y"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    one_edit = (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    met = pairs.join(a, "x").join(b, "y").filter(((F.col("x") != F.col("y")) | (F.col("a") < F.col("b"))) & one_edit)
    return met.select("a", "a_n", "b", "b_n")


def _follow(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of words (word, form) lead in the end, by doubling the steps taken."""
    now = spill(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = spill(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def group(words: DataFrame, times: int = 2, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near and form_n for ``words`` (word, n), which are distinct.

    A word's form is the most frequent word one edit away (ties: the smallest in code-point order) if that is at
    least ``times`` (2 or more) as frequent as the word; root is the end of the chain of forms, the word itself if it
    has none. Frequencies grow along a chain, so chains end. n_near counts the words one edit away. No words, no rows.
    """
    if times < 2:
        raise ValueError("forms of equal frequency could lead in circles")
    pairs = spill(near_pairs(words, symbols))
    both = pairs.union(pairs.select("b", "b_n", "a", "a_n")).toDF("word", "n", "other", "other_n")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    near = spill(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n")))
    strong = F.col("other_n") >= F.col("n") * times
    forms = near.select("word", "n", "n_near", F.when(strong, F.col("other")).alias("form"), F.when(strong, F.col("other_n")).alias("form_n"))
    roots = _follow(forms.filter("form is not null"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
