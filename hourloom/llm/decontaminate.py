"""Benchmark decontamination: windows of test words looked up along every training text.

Built from DataFrame functions only. The windows of the benchmark form a hash set; each document is
turned into an array of word hashes, exploded by position, and the hash of the next words is probed
against the set inside one generated stage. A hash match is verified by comparing the words.

Size: the windows are counted first. They are broadcast in blocks of at most MAX_WINDOWS, one scan
of the documents per block, so the broadcast is bounded whatever the benchmark; a usual benchmark is
one block. Only hits and one row per document are shuffled, never texts.

Defined results. A null or wordless text has no words and no hits. A benchmark row without words has
no window; one without item_id is an item named by the empty string; repeated item_ids are one item.
Repeated document rows each get their own result row. Extra columns are ignored by the scan and kept
by the removing functions. With an empty benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.store import saved

WINDOW = 10
MAX_WINDOWS = 200_000  # broadcast bound: about 300 bytes a window
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
ANY_CASE_PIECE = r"(?s)[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for null."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, win, len, win_words): each window of each item, win being its words joined by spaces."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")
    ).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("at")
    cut = items.select("item", "w", length.alias("len"), starts)
    words = F.slice("w", F.col("at"), F.col("len"))
    return cut.select("item", "len", words.alias("win_words"), F.array_join(words, " ").alias("win")).distinct()


def _hits(docs: DataFrame, block: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, text_hash, n_words, pos, len, win): verified hits, and one row with pos = n_words per document."""
    text = F.col("text").cast("string")
    read = docs.select(F.col("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("w"))
    hashed = read.withColumn("h", F.concat(F.transform("w", lambda x: F.xxhash64(x)), F.array(F.lit(0).cast("bigint"))))
    spread = hashed.select("doc_id", "text_hash", "w", "h", F.posexplode("h").alias("pos", "_first"))
    n = F.size("w")
    keys = [
        F.when(F.col("pos") + k <= n, F.xxhash64(F.lit(k), *[F.get("h", F.col("pos") + i) for i in range(k)]))
        for k in lengths
    ]
    if len(lengths) == 1:
        probe = spread.withColumn("key", keys[0])
    else:
        last = F.array(F.lit(None).cast("bigint"))  # the row of the document itself, once
        probe = spread.withColumn("key", F.explode(F.when(F.col("pos") == n, last).otherwise(F.array(*keys))))
    same = F.slice(F.col("w"), F.col("pos") + 1, F.col("len")) == F.col("win_words")
    found = probe.join(F.broadcast(block), (F.col("key") == F.col("win_key")) & same, "left")
    return found.where(F.col("win").isNotNull() | (F.col("pos") == n)).select(
        "doc_id", "text_hash", n.cast("bigint").alias("n_words"), "pos", "len", "win"
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS
) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_words, hit_words (0-based positions), items, n_items."""
    windows = saved(benchmark_windows(benchmark, window))
    hashes = F.transform("win_words", lambda x: F.xxhash64(x))
    distinct = windows.select("len", "win_words", "win").distinct().withColumn("h", hashes)
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # at most `window` values
    by_length = F.lit(None).cast("bigint")
    for k in lengths:
        key = F.xxhash64(F.lit(k), *[F.get("h", F.lit(i)) for i in range(k)])
        by_length = F.when(F.col("len") == k, key).otherwise(by_length)
    keyed = distinct.withColumn("win_key", by_length).drop("h")
    n_windows = keyed.count()
    blocks = max(1, -(-n_windows // max_windows))
    hits = None
    for b in range(blocks):
        block = keyed if blocks == 1 else keyed.where(F.pmod(F.xxhash64("win", F.lit(b"block")), F.lit(blocks)) == b)
        part = _hits(docs, block, lengths or [window])
        part = part if b == 0 else part.where(F.col("win").isNotNull())
        hits = part if hits is None else hits.unionByName(part)
    hits = saved(hits)

    key = ["doc_id", "text_hash"]
    marker = F.col("win").isNull()
    span = F.when(~marker, F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1))
    # several windows and repeated rows may hit one word: distinct positions per document
    per_doc = hits.groupBy(*key).agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(marker, 1).otherwise(0)).alias("_copies"),
        F.array_distinct(F.flatten(F.collect_set(span))).alias("hit_words"),
    )
    pairs = hits.where(~marker).select(*key, "win").distinct()
    named = windows.select("win", "item")
    if n_windows <= max_windows:
        named = F.broadcast(named) if windows.count() <= max_windows else named
    items = pairs.join(named, "win").groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    d, i = per_doc.alias("d"), items.alias("i")
    same_doc = F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")) & F.col("d.text_hash").eqNullSafe(F.col("i.text_hash"))
    empty = F.array().cast("array<string>")
    joined = d.join(i, same_doc, "left").select("d.*", F.coalesce("i.items", empty).alias("items"))
    repeated = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_copy")
    return repeated.withColumn("n_items", F.size("items").cast("bigint"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs whose text holds no benchmark window, all columns kept."""
    report = contamination(docs, benchmark, **options).where(F.size("hit_words") > 0)
    bad = report.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same_text = F.xxhash64(F.col("row.text").cast("string")) == F.col("bad_hash")
    return packed.join(bad, F.col("row.doc_id").eqNullSafe(F.col("bad_id")) & same_text, "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs with the hit words, and what stands before each of them, cut out of the text."""
    report = contamination(docs, benchmark, **options).where(F.size("hit_words") > 0)
    bad = report.select(
        F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"), F.col("hit_words").alias("hit")
    ).dropDuplicates(["bad_id", "bad_hash"])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row.text").cast("string")
    same = F.col("row.doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64(text) == F.col("bad_hash"))
    pieces = F.regexp_extract_all(text, F.lit(ANY_CASE_PIECE), F.lit(0))
    tail = F.regexp_replace(text, ANY_CASE_PIECE, "")
    left = F.filter(pieces, lambda x, i: ~F.array_contains("hit", i))
    cut = F.when(F.col("hit").isNotNull(), F.concat(F.array_join(left, ""), tail)).otherwise(text)
    joined = packed.join(bad, same, "left")
    return joined.select(*[cut.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op1_digest(report: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return report.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )
