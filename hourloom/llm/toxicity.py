"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded text.

Folding lower-cases, strips accents, maps look-alike letters of other scripts and digits used as
letters to plain a-z, and turns everything else into single spaces. i and l fold to one letter, since
1 and | stand for both; the lexicon lives in folded form, so the same folding meets itself.

The lexicon is learned from labelled rows: a word enters if it occurs in toxic rows significantly
more often than in others and next to varied words, with its log odds as weight; the second condition
leaves out the words of a text that is merely copied often. A word followed or preceded by a word with
which it mostly occurs in non-toxic rows becomes an exception phrase, whose occurrences do not count.
The sum of weights is normalised by the length of the text; a logistic regression over the normalised
sum, the greatest weight and whether there is a hit gives the score. doc_id only decides which rows
may teach; labels, language and source are never inputs of a score.

Labels are used up to LABELLED rows by hash order, so they may be broadcast. Words are counted per
row and summed map-side; significance alone decides which words and phrases are kept, and as they come
from LABELLED rows at most, they may be collected. Words of one or two letters never enter the lexicon:
in folded text they are mostly numbers and initials. Scoring works row by row and shuffles nothing.

Defined results. Null and empty texts get the score of a text without hits and length 0. Every row
gives its own result row; repeated rows score alike. Without toxic or without other labels every score
is the share of toxic labels, 0 without any. Extra columns are ignored by score and kept by
drop_toxic.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.store import saved

LABELLED = 50_000  # bound on the labelled rows used
MIN_CONTEXTS = 4  # distinct preceding words in toxic rows, told apart by 63 slots
MIN_Z = 5.0
MIN_OTHER = 9  # non-toxic rows that every exception phrase has (at least 10 rows, 9 of 10 non-toxic), and so each of its words
HELD_PHRASES = 200_000  # counted at once in a task
DEPTH, WIDTH = 4, 1 << 20  # one-byte counters of phrases: 4 MB a task
BUCKETS = 16  # by phrase, for the exact counts
SUM_TASKS = 4  # tasks that add up the counters
FOLDS, HELD_OUT = 5, 0
# fixed values: look-alike letters of Greek and Cyrillic, and signs that stand for letters
LOOKALIKES = dict(zip("αβεηικνορτυχωаеорсухіѕјԁԛԝьктмнвгӏё", "abenikvoptuxwaeopcyxisjdqwbktmhbrie"))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i"}
LOOSE_SIGNS = re.compile(r"(?<![^\s])[$@|]+(?![^\s])|[$@|]+(?=\s|$)")  # signs that end a word or stand alone
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
FEATURES = ("density", "greatest", "hit")


@lru_cache(maxsize=1)
def _table() -> tuple[bytes, dict[int, str]]:
    """Folding of ASCII bytes, and of the other code points that fold to a letter."""
    ascii_fold = bytearray(b" " * 256)
    for c in range(128):
        folded = SIGNS.get(chr(c).lower(), chr(c).lower())
        if folded.isascii() and folded.isalpha():
            ascii_fold[c] = ord(folded)
    wide = {ord(c): "" for c in INVISIBLE}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        plain = unicodedata.normalize("NFKD", chr(c))[0].lower()
        plain = SIGNS.get(plain, plain)
        if plain.isascii() and plain.isalpha():
            wide[c] = plain
    for c, plain in LOOKALIKES.items():
        for form in (c, c.upper()):
            if len(form) == 1:
                wide[ord(form)] = SIGNS.get(plain, plain)
    wide |= {c: "" for c in range(0x300, 0x370)}  # combining marks
    return bytes(ascii_fold), wide


class _Wide(dict):
    """Code points above ASCII without a folding become spaces; ASCII stays for the byte table."""

    def __missing__(self, c: int):
        self[c] = c if c < 128 else " "
        return self[c]


@lru_cache(maxsize=1)
def _wide() -> _Wide:
    return _Wide(_table()[1])


def fold(text: str | None) -> str:
    """Folded words, each between single spaces; a text without words is one space."""
    if not text:
        return " "
    if "$" in text or "@" in text or "|" in text:
        text = LOOSE_SIGNS.sub(" ", text)
    if not text.isascii():
        text = text.translate(_wide())
    plain = text.encode("ascii", "replace").translate(_table()[0])
    return f" {b' '.join(plain.split()).decode()} " if plain.strip() else " "


def labelled_sample(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(_labelled, toxic) of at most `bound` documents outside the held-out fold, by hash order."""
    fold_of = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    rows = labels.where(F.col("toxic").isNotNull() & (fold_of != HELD_OUT))
    one = rows.groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
    return one.orderBy(F.xxhash64("_labelled"), "_labelled").limit(bound)


def _teaching(docs: DataFrame, sample: DataFrame) -> DataFrame:
    same = F.col("doc_id") == F.col("_labelled")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), same).select("text", "toxic")


def learn_lexicon(teaching: DataFrame, n_toxic: int, n_other: int) -> tuple[dict[str, float], set[str]]:
    """Folded word -> weight, for words that toxic rows hold significantly more often; those too rare for exceptions."""

    def words(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            found, before = {}, ""
            for word in fold(text).split():
                if len(word) > 2 and word not in found:  # where the row has the word first
                    found[word] = 1 << (zlib.crc32(before.encode()) % 63)
                before = word
            out.append([{"word": w, "places": p} for w, p in found.items()])
        return pa.array(out, pa.list_(pa.struct([("word", pa.string()), ("places", pa.int64())])))

    udf = F.arrow_udf(words, "array<struct<word: string, places: bigint>>")
    held = teaching.select("toxic", F.inline(udf("text")))
    toxic = F.sum("toxic")
    places = F.bit_count(F.bit_or(F.when(F.col("toxic") == 1, F.col("places")).otherwise(0)))
    counts = held.groupBy("word").agg(
        toxic.alias("t"), (F.count(F.lit(1)) - toxic).alias("c"), places.alias("contexts")
    )
    odds = F.log((F.col("t") + 0.5) / (n_toxic - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (n_other - F.col("c") + 0.5))
    share = (F.col("t") + F.col("c")) / float(n_toxic + n_other)
    deviation = F.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_other))
    z = (F.col("t") / n_toxic - F.col("c") / n_other) / deviation
    kept = counts.where(F.col("contexts") >= MIN_CONTEXTS).withColumns({"weight": odds, "z": z}).where(F.col("z") >= MIN_Z)
    top = kept.select("word", "weight", "c").collect()  # words of `bound` rows at most
    return {r["word"]: r["weight"] for r in top}, {r["word"] for r in top if r["c"] < MIN_OTHER}


def phrases_of(text: str | None, terms: frozenset[str], rare: frozenset[str]) -> set[str]:
    """Folded neighbours of which one is a term and none is rare."""
    w = fold(text).split()
    return {f"{a} {b}" for a, b in zip(w, w[1:]) if (a in terms or b in terms) and a not in rare and b not in rare}


def _cells(phrases: list[str]) -> np.ndarray:
    """For each phrase its cell in each row of the counters."""
    digests = b"".join(hashlib.blake2b(p.encode(), digest_size=4 * DEPTH).digest() for p in phrases)
    return np.frombuffer(digests, "<u4").reshape(-1, DEPTH) % WIDTH


def _frequent(teaching: DataFrame, terms: frozenset[str], rare: frozenset[str]) -> np.ndarray:
    """Which cells of counters of fixed size reach MIN_OTHER: all cells of any phrase with as many non-toxic rows do.

    A task fills one table for all its rows; the tables are added up in SUM_TASKS tasks and on the driver.
    A counter stays at 255, which keeps it at MIN_OTHER and more.
    """

    def table(cells: np.ndarray, slot: int) -> pa.RecordBatch:
        packed = np.minimum(cells, 255).astype(np.uint8).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([packed], pa.binary())], names=["slot", "cells"])

    def unpacked(cells: bytes) -> np.ndarray:
        return np.frombuffer(cells, np.uint8).reshape(DEPTH, WIDTH)

    def fill(batches):
        from pyspark import TaskContext

        cells = np.zeros((DEPTH, WIDTH), np.int32)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = list(phrases_of(text, terms, rare))
                if found:
                    at = _cells(found)
                    for d in range(DEPTH):
                        np.add.at(cells[d], at[:, d], 1)
        yield table(cells, TaskContext.get().partitionId() % SUM_TASKS)

    def add(batches):
        cells, slot = np.zeros((DEPTH, WIDTH), np.int32), None
        for batch in batches:
            for slot, one in zip(batch.column("slot").to_pylist(), batch.column("cells").to_pylist()):
                cells += unpacked(one)
        if slot is not None:
            yield table(cells, slot)

    tables = teaching.where("toxic = 0").select("text").mapInArrow(fill, "slot int, cells binary")
    added = tables.repartition(SUM_TASKS, "slot").mapInArrow(add, "slot int, cells binary")
    total = np.zeros((DEPTH, WIDTH), np.int32)
    for r in added.collect():  # SUM_TASKS rows at most
        total += unpacked(bytes(r["cells"]))
    return total >= MIN_OTHER


def learn_exceptions(teaching: DataFrame, lexicon: dict[str, float], rare: set[str]) -> set[str]:
    """Phrases of a term and its neighbour that occur in at least 10 rows, nine times out of ten in non-toxic ones.

    Such a phrase has MIN_OTHER non-toxic rows, and so has each of its words: phrases with a rare term are
    left out at once. Of the others most occur a few times only, so a first pass counts phrases into
    counters of fixed size, which never count too little (collisions only add), and only phrases that may reach MIN_OTHER are
    counted exactly. The result is that of counting all.
    """
    terms, rare = frozenset(lexicon), frozenset(rare)
    packed = np.packbits(_frequent(teaching, terms, rare), axis=1)

    def tables(counts: dict[str, list[int]]) -> pa.RecordBatch:
        """The counts by bucket, a row each."""
        buckets: dict[int, list[str]] = {}
        for phrase in counts:
            buckets.setdefault(zlib.crc32(phrase.encode()) % BUCKETS, []).append(phrase)
        columns = [
            pa.array(list(buckets), pa.int32()),
            pa.array(list(buckets.values()), pa.list_(pa.string())),
            *(pa.array([[counts[p][i] for p in own] for own in buckets.values()], pa.list_(pa.int64())) for i in (0, 1)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "phrase", "t", "n"])

    def phrases(batches):
        counts: dict[str, list[int]] = {}
        frequent = np.unpackbits(packed, axis=1).astype(bool)
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                near = list(phrases_of(text, terms, rare))
                if not near:
                    continue
                likely = np.all([frequent[d][c] for d, c in enumerate(_cells(near).T)], axis=0)
                for phrase, counted in zip(near, likely.tolist()):
                    if counted:
                        count = counts.setdefault(phrase, [0, 0])
                        count[0] += toxic
                        count[1] += 1
            if len(counts) >= HELD_PHRASES:
                yield tables(counts)
                counts = {}
        yield tables(counts)

    def decide(batches):
        """The phrases to keep among those of some buckets."""
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for own, t, n in zip(*(batch.column(c).to_pylist() for c in ("phrase", "t", "n"))):
                for phrase, a, b in zip(own, t, n):
                    count = counts.setdefault(phrase, [0, 0])
                    count[0] += a
                    count[1] += b
        kept = [p for p, (t, n) in counts.items() if n >= 10 and 10 * t <= n]
        yield pa.RecordBatch.from_arrays([pa.array([kept], pa.list_(pa.string()))], names=["kept"])

    shape = "bucket int, phrase array<string>, t array<bigint>, n array<bigint>"
    held = teaching.select("text", "toxic").mapInArrow(phrases, shape)
    kept = held.repartition(BUCKETS, "bucket").mapInArrow(decide, "kept array<string>")
    return {p for r in kept.collect() for p in r["kept"]}  # phrases of `bound` rows at most


@lru_cache(maxsize=2)
def _automaton(lexicon: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in lexicon:
        found.add_word(f" {term} ", (len(term), weight))
    for phrase in exceptions:
        found.add_word(f" {phrase} ", (len(phrase), None))
    found.make_automaton()
    return found


def hits(folded: str, automaton) -> list[float]:
    """Weights of the terms that stand outside exception phrases.

    A phrase is two words, so a term lies in one if both begin or both end at the same place.
    """
    terms, begins, ends = [], set(), set()
    for end, (length, weight) in automaton.iter(folded):
        if weight is None:
            begins.add(end - length)
            ends.add(end)
        else:
            terms.append((end - length, end, weight))
    return [w for a, b, w in terms if a not in begins and b not in ends]


def _features(lexicon: dict[str, float], exceptions: set[str]):
    frozen = (tuple(sorted(lexicon.items())), tuple(sorted(exceptions)))

    def features(texts: pa.Array) -> pa.Array:
        automaton = _automaton(*frozen) if frozen[0] else None
        rows = []
        for text in texts.to_pylist():
            folded = fold(text)
            found = hits(folded, automaton) if automaton else []
            n = folded.count(" ") - 1 if folded != " " else 0
            rows.append((math.log1p(100.0 * sum(found) / max(n, 1)), max(found, default=0.0), float(bool(found))))
        cells = np.array(rows, np.float64).reshape(len(rows), len(FEATURES))
        return pa.StructArray.from_arrays([pa.array(c) for c in cells.T], names=list(FEATURES))

    return F.arrow_udf(features, f"struct<{', '.join(f'{n}: double' for n in FEATURES)}>")


def score(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted, n features."""
    sample = saved(labelled_sample(labels, bound))
    teaching = saved(_teaching(docs, sample))  # at most `bound` texts, and repeats of these ids
    n, n_toxic = teaching.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    text = F.col("text").cast("string")
    if not n or not n_toxic or n == n_toxic:
        base = docs.select("doc_id", held_out.alias("held_out"), F.lit(n_toxic / n if n else 0.0).alias("score"))
        return base.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    lexicon, rare = learn_lexicon(teaching, n_toxic, n - n_toxic)
    exceptions = learn_exceptions(teaching, lexicon, rare) if lexicon else set()
    udf = _features(lexicon, exceptions)
    told = teaching.select("toxic", udf("text").alias("f")).select("toxic", "f.*")
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(told)
    model = LogisticRegression(labelCol="toxic", featuresCol="features", regParam=1e-3, maxIter=50).fit(ready)
    read = docs.select("doc_id", held_out.alias("held_out"), udf(text).alias("f")).select("doc_id", "held_out", "f.*")
    total = F.lit(float(model.intercept))
    for name, weight in zip(FEATURES, model.coefficients.toArray()):
        total = total + F.col(name) * F.lit(float(weight))
    scored = read.withColumn("score", 1.0 / (1.0 + F.exp(-total)))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES)


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows that score below `least`, all columns kept; rows without doc_id stay."""
    toxic = score(docs, labels, **options).where(F.col("score") >= least).select(F.col("doc_id").alias("id")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.join(toxic, F.col("row.doc_id") == F.col("id"), "left_anti").select("row.*")


def op7_digest(scored: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return scored.select("doc_id", "held_out", "score", "predicted")
