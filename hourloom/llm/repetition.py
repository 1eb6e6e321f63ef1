"""Quality rules on repetition: a suffix array over words and its longest common prefixes.

The suffixes of every text are ordered by prefix doubling; equal prefixes are refined only where
they still tie. Neighbours in that order share the longest prefixes, so for a suffix the greater of
its two common prefixes is the longest repeated substring that starts there. Uniting these spans
gives every word covered by a maximal repeat: any common-prefix interval of at least MIN_WORDS words
lies within them. A text is refused if repeats cover too much of it or if one repeat is too long.

Texts are ordered in slices, several texts at once with the text as part of the first key, so no
prefix is shared across texts. Nothing is shuffled; memory is bounded by a slice or the longest text.

Defined results. A null text has no words and fails the base rule. Very short texts have no repeats.
Every row gives its own result row. Extra columns are ignored by measure and kept by keep_good.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.words import BASE, SPACE, hash_words, mix, split_words, text_slices

WINDOW = 8  # base rule
MIN_WORDS = 6  # shortest repeat that counts for the verdict
MAX_COVERED = 0.3
MAX_LONGEST = 300
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = (
    "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, "
    "n_repeat_words: bigint, n_covered: bigint, longest_repeat: bigint>"
)


def longest_repeats(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every word the length of the longest substring that starts there and occurs again in its text."""
    n = len(hashes)
    if n < 2:
        return np.zeros(n, np.int64)
    counts = np.diff(offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(offsets[1:], counts) - np.arange(n)  # words up to the end of the text
    with np.errstate(over="ignore"):
        first = mix(hashes + np.uint64(BASE) * (text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(first, kind="stable")

    def starts_of_groups(new: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """The slot where the group of each slot starts; new marks the first slot of a group."""
        return slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]

    slots = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = first[order[1:]] != first[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = starts_of_groups(new, slots)
    levels = [rank.copy()]  # equal ranks on level k: equal for 2**k words
    step = 1
    while True:
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if not len(slots):
            break
        here = order[slots]
        after = np.where(left[here] > step, rank[np.minimum(here + step, n - 1)], -1)
        by = np.lexsort((after, rank[here]))
        here, after = here[by], after[by]
        group = rank[here]
        new = np.ones(len(slots), bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        order[slots] = here
        rank[here] = starts_of_groups(new, slots)
        levels.append(rank.copy())
        step *= 2

    # common prefix of neighbours in suffix order, largest steps first
    a, b = order[:-1].copy(), order[1:].copy()
    tied = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[tied], b[tied]
    common = np.zeros(len(tied), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        x, y = np.minimum(a, n - 1), np.minimum(b, n - 1)
        equal = inside & (levels[k][x] == levels[k][y])
        move = np.where(equal, 1 << k, 0)
        common += move
        a, b = a + move, b + move
    result = np.zeros(n, np.int64)
    np.maximum.at(result, order[tied], common)
    np.maximum.at(result, order[tied + 1], common)
    return result


def covered_words(lengths: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """For each text the number of words in the united spans of at least `least` words."""
    begin = np.flatnonzero(lengths >= least)
    change = np.zeros(len(lengths) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + lengths[begin], -1)
    inside = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(np.cumsum(change[:-1]) > 0, out=inside[1:])
    return np.diff(inside[offsets])


def _measure(texts: pa.Array) -> pa.Array:
    parts = []
    for raw, offsets in text_slices(texts):
        words = split_words(raw, offsets)
        lengths = longest_repeats(hash_words(raw, words), words.offsets)

        def per_text(marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
            total = np.zeros(len(marks) + 1, np.int64)
            np.cumsum(marks, out=total[1:])
            return np.diff(total[edges])

        buffer, repeated = raw.tobytes(), []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            lines = [x for x in buffer[a:b].split(b"\n") if x.strip()]
            repeated.append(len(lines) - len(set(lines)))
        longest = np.zeros(len(offsets) - 1, np.int64)
        some = np.flatnonzero(np.diff(words.offsets))
        if len(some):
            longest[some] = np.maximum.reduceat(lengths, words.offsets[some])
        parts.append(
            [
                np.diff(words.offsets),
                per_text(~SPACE[raw] & ((raw & 0xC0) != 0x80), offsets),
                per_text(SYMBOL[raw], offsets),
                np.array(repeated, np.int64),
                covered_words(lengths, words.offsets, WINDOW),
                covered_words(lengths, words.offsets, MIN_WORDS),
                longest,
            ]
        )
    names = [x.split(":")[0].strip() for x in MEASURES[7:-1].split(",")]
    cells = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cells], names=names)


def measures(text: Column) -> Column:
    """Struct of the counts of a text."""
    return F.arrow_udf(_measure, MEASURES)(text.cast("string"))


def _verdict(df: DataFrame, of: str = "") -> tuple[Column, Column]:
    n = F.col(f"{of}n_words")
    failed = (n < 20) | (100 * F.col(f"{of}n_repeat_words") > 30 * n)
    fine = (F.col(f"{of}n_covered") <= n * MAX_COVERED) & (F.col(f"{of}longest_repeat") <= MAX_LONGEST)
    return failed, ~failed & fine


def measure(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, counts, base_failed and kept."""
    found = docs.select("doc_id", measures(F.col("text")).alias("m")).select("doc_id", "m.*")
    failed, kept = _verdict(found)
    return found.withColumns({"base_failed": failed, "kept": kept})


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass, all columns kept."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(row, measures(F.col("text")).alias("measures"))
    return marked.where(_verdict(marked, "measures.")[1]).select("row.*")
