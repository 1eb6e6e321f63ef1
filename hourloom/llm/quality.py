"""Quality by importance resampling: hashed n-gram models of good and raw text, Gumbel top-k.

Two bag-of-n-gram models are counted: the raw one over all documents, the target one over labelled
good documents. Tokens are runs of letters and digits, and runs of signs; their single hashes and the
hashes of neighbours fall into BUCKETS buckets. A document's weight is its log importance: the sum over
its n-grams of the log ratio of target to raw. Each weight gets seeded Gumbel noise and the k greatest
sums are kept: sampling without replacement in proportion to the importances, the exponentials of the
weights.

k is the size of the sample: the number of documents whose weight passes the cut that best separates
the labels of the fitting rows. Which documents make the k is drawn. Chances follow the importances, so
documents whose weights differ by a few units change places, and those far above or below the rest
do not. Labels are used up to LABELLED rows, chosen by a hash; all other counts cover every row.
Counting adds up inside each task and then per bucket; the model of BUCKETS numbers is what reaches
the driver. The k-th greatest sum is found by histograms over all rows, without sorting them.

Defined results. Null texts and texts without a token have no weight and are not kept. Rows tied at
the cut, such as repeated rows, are kept together. Labels that are null, repeated or of unknown
documents are ignored or counted once. Without labels nothing can be fitted and every row with a token
is kept. Extra columns are ignored by score and kept by keep_good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.store import saved
from hourloom.llm.words import BASE, LOWER, SPACE, Words, hash_words, mix, text_slices

BUCKETS = 1 << 15
LABELLED = 50_000  # bound on the labelled rows used
SEED = 3
BINS = 4096
KIND = np.full(256, 2, np.uint8)  # 0 space, 1 letters and digits, 2 signs
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
KIND[SPACE] = 0


def split_tokens(raw: np.ndarray, offsets: np.ndarray) -> Words:
    kind = KIND[raw]
    change = np.ones(len(raw), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(change)
    ends = np.append(at[1:], len(raw))
    held = kind[at] > 0
    starts = at[held]
    return Words(starts, ends[held], np.searchsorted(starts, offsets))


def ngram_buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice the bucket of every n-gram and the number of the text it belongs to; then the slice's size."""
    for raw, offsets in text_slices(texts):
        lowered = LOWER[raw]
        tokens = split_tokens(lowered, offsets)
        hashes = hash_words(lowered, tokens)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(tokens.offsets))
        with np.errstate(over="ignore"):
            both = mix(hashes[:-1] * np.uint64(BASE) + hashes[1:])
        inside = text[:-1] == text[1:]
        grams = np.concatenate([hashes, both[inside]]) & np.uint64(BUCKETS - 1)
        yield grams.astype(np.int64), np.concatenate([text, text[:-1][inside]]), len(offsets) - 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = np.asarray(batch.column(1).fill_null(False)).astype(bool)
        at = 0
        for grams, text, n in ngram_buckets(batch.column(0)):
            raw += np.bincount(grams, minlength=BUCKETS)
            target += np.bincount(grams[good[at : at + n][text]], minlength=BUCKETS)
            at += n
    held = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(held, pa.int64()), pa.array(raw[held]), pa.array(target[held])], names=["bucket", "raw", "target"]
    )


def labelled_sample(labels: DataFrame, bound: int = LABELLED, fold: int | None = None) -> DataFrame:
    """(_labelled, quality) of at most `bound` documents by hash order; those of the held-out fold are left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if fold is not None:
        rows = rows.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != fold)
    one = rows.groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("quality").alias("quality"))
    return one.orderBy(F.xxhash64("_labelled"), "_labelled").limit(bound)


def fit_ratio(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Log ratio of target to raw for each bucket, smoothed by one count per bucket."""
    good = F.broadcast(sample.where(F.col("quality") == 1).select("_labelled"))  # at most LABELLED ids
    marked = docs.select(F.col("text").cast("string").alias("text"), "doc_id").join(
        good, F.col("doc_id") == F.col("_labelled"), "left"
    )
    counted = marked.select("text", F.col("_labelled").isNotNull().alias("good")).mapInArrow(
        _counts, "bucket bigint, raw bigint, target bigint"
    )
    total = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for row in total:
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    if target.sum() == BUCKETS:
        return np.zeros(BUCKETS, np.float32)
    return (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float32)


def weigh(text: Column, ratio: np.ndarray) -> Column:
    """The log importance of a text, a sum over its n-grams; null without tokens."""

    def log_importance(texts: pa.Array) -> pa.Array:
        out = []
        for grams, owner, n in ngram_buckets(texts):
            count = np.bincount(owner, minlength=n)
            total = np.bincount(owner, ratio[grams].astype(np.float64), minlength=n)
            out.append(pa.array(total, pa.float64(), mask=count == 0))
        return pa.concat_arrays(out) if out else pa.array([], pa.float64())

    return F.arrow_udf(log_importance, "double")(text.cast("string"))


def best_cut(scored: DataFrame, sample: DataFrame) -> float | None:
    """The weight that separates good from bad labelled rows with the greatest sum of both rates."""
    found = scored.join(F.broadcast(sample), F.col("doc_id") == F.col("_labelled"))
    step = F.floor("weight").cast("bigint")
    table = found.where(F.col("weight").isNotNull()).groupBy(step.alias("step")).agg(
        F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.count(F.lit(1)).alias("n")
    )
    rows = sorted((r["step"], r["good"], r["n"] - r["good"]) for r in table.collect())  # at most one per labelled row
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return None
    best, cut, lost, caught = 0.0, None, 0, 0
    for step, g, b in rows:
        gain = caught / bad - lost / good
        if gain > best:
            best, cut = gain, float(step)
        lost, caught = lost + g, caught + b
    return cut


def threshold_of(keys: DataFrame, name: str, k: int) -> float | None:
    """The k-th greatest value, to the precision of doubles, by histograms that narrow it down."""
    low, high, n = keys.agg(F.min(name), F.max(name), F.count(name)).first()
    if k <= 0 or not n:
        return None
    if k >= n:
        return low
    above = 0  # values beyond the bin that holds the wanted one
    while True:
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            return low
        place = F.least(F.floor((F.col(name) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        inside = keys.where(F.col(name).between(low, high)).groupBy(place.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high")
        )
        for row in sorted(inside.collect(), key=lambda r: -r["bin"]):  # BINS rows
            if above + row["n"] >= k:
                if row["low"] == row["high"] or (low, high) == (row["low"], row["high"]):
                    return row["low"]
                low, high = row["low"], row["high"]
                break
            above += row["n"]


def gumbel_key(weight: Column, drawn: Column) -> Column:
    """The weight plus standard Gumbel noise made from a 64-bit hash."""
    uniform = (F.pmod(drawn, F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return weight - F.log(-F.log(uniform))


def _weighed(docs: DataFrame, ratio: np.ndarray, seed: int) -> DataFrame:
    """(row, weight, gumbel_key): whole rows as one value, the weight, and the weight with its seeded Gumbel noise."""
    text = F.col("row.text").cast("string")
    drawn = F.xxhash64(F.lit(seed), F.col("row.doc_id"), F.xxhash64(text))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.withColumn("weight", weigh(text, ratio)).withColumn("gumbel_key", gumbel_key(F.col("weight"), drawn))


def _fitted(docs: DataFrame, labels: DataFrame, fold: int | None, bound: int, seed: int) -> tuple[DataFrame, np.ndarray, float | None]:
    """(doc_id, text_hash, weight, gumbel_key) of every row, the model, and the least key that is kept."""
    sample = saved(labelled_sample(labels, bound, fold))
    ratio = fit_ratio(docs, sample)
    rows = _weighed(docs.select("doc_id", "text"), ratio, seed)
    scored = saved(
        rows.select(
            F.col("row.doc_id").alias("doc_id"), F.xxhash64(F.col("row.text").cast("string")).alias("text_hash"),
            "weight", "gumbel_key",
        )
    )
    cut = best_cut(scored, sample)
    passing = F.col("weight").isNotNull() if cut is None else F.col("weight") >= cut
    return scored, ratio, threshold_of(scored, "gumbel_key", scored.where(passing).count())


def _kept(key: str, least: float | None) -> Column:
    return F.lit(False) if least is None else F.coalesce(F.col(key) >= least, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, fold: int | None = None, bound: int = LABELLED, seed: int = SEED) -> DataFrame:
    """One row per document row: doc_id, text_hash, weight, gumbel_key, kept."""
    scored, _, least = _fitted(docs, labels, fold, bound, seed)
    return scored.withColumn("kept", _kept("gumbel_key", least))


def keep_good(docs: DataFrame, labels: DataFrame, fold: int | None = None, bound: int = LABELLED, seed: int = SEED) -> DataFrame:
    """The rows that are kept, all columns kept. Weighs the texts once more instead of shuffling them."""
    _, ratio, least = _fitted(docs, labels, fold, bound, seed)
    return _weighed(docs, ratio, seed).where(_kept("gumbel_key", least)).select("row.*")
