"""Secrets, repetition, quality and toxicity against brute force, edge cases and held-out labels."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from llm_fixtures import SF, WORDS, frame, prose
from pyspark.sql import functions as F

from hourloom.llm import queries
from hourloom.llm.quality import BUCKETS, gumbel_key, threshold_of
from hourloom.llm.quality import keep_good as keep_quality
from hourloom.llm.quality import score as quality_score
from hourloom.llm.repetition import keep_good as keep_unrepetitive
from hourloom.llm.repetition import measure
from hourloom.llm.secrets import RULES, find_spans, op2_digest, redact, scan
from hourloom.llm.toxicity import drop_toxic, fold, hits, learn_exceptions, phrases_of
from hourloom.llm.toxicity import score as toxicity_score
from hourloom.llm.trigrams import ANY, trigram_query

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def base_spans(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def test_secrets_equal_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.RUNNERS["op2_secrets"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        kinds = Counter(x.split(":")[0] for x in want)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])


SECRETS = [
    "PassWord : 'abcdef' x",
    "token=abc",
    "é api_key=\"ABCDEF12\" AKIA" + "Q" * 16,
    "AKIA" + "Q" * 15,
    "a" * 23,
    "b" * 24,
    "ſecret=abcdefgh toKen=abcdefgh",
    "-----BEGIN RSA PRIVATE KEY-----",
    "ghp_" + "a1" * 18,
    "passwordpassword==abcdefg",
]


def test_secret_spans_and_redaction(spark, edge_docs, no_docs):
    base = {"assign", "access", "hex"}
    for text, spans in zip(SECRETS, find_spans(pa.array(SECRETS))):
        assert [f"{RULES[k].kind}:{a}:{b}" for a, k, b in spans if RULES[k].kind in base] == base_spans(text)
    kinds = {RULES[k].kind for spans in find_spans(pa.array(SECRETS)) for _, k, _ in spans}
    assert {"private_key", "hub_token"} <= kinds
    cut = redact(frame(spark, [*SECRETS, None])).orderBy("doc_id").collect()
    assert cut[5]["text"] == "[hex]" and cut[-1]["text"] is None and cut[5]["lang"] == "en"
    assert scan(edge_docs).count() == edge_docs.count() and op2_digest(scan(no_docs)).count() == 0


@pytest.mark.parametrize(
    "pattern, query",
    [
        ("AKIA[A-Z]+", ("and", (("tri", b"aki"), ("tri", b"kia")))),
        ("[0-9a-f]{24,}", ANY),
        ("(abc|defg)x?", ("or", (("tri", b"abc"), ("and", (("tri", b"abc"), ("tri", b"bcx")))))),
        ("a*", ANY),
    ],
)
def test_trigram_queries(pattern, query):
    got = trigram_query(pattern)
    assert got == query or pattern.startswith("(abc") and got[0] == "or"


def repeated(words, k):
    places = {}
    for i in range(len(words) - k + 1):
        places.setdefault(tuple(words[i : i + k]), []).append(i)
    return {p for v in places.values() if len(v) > 1 for i in v for p in range(i, i + k)}


def longest(words):
    low, high = 0, max(len(words) - 1, 0)
    while low < high:
        k = (low + high + 1) // 2
        cut = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        low, high = (k, high) if len(set(cut)) < len(cut) else (low, k - 1)
    return low


def check_measures(rows, texts):
    for r, text in zip(rows, texts):
        text = text or ""
        words, seen, dup = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        eight = repeated(words, 8)
        want = (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(eight),
            len(repeated(words, 6)), longest(words),
        )
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")
        assert tuple(r[n] for n in names) == want
        failed = len(words) < 20 or 100 * len(eight) > 30 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_repetition_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    check_measures(queries.RUNNERS["op5_repetition"](spark, SF).orderBy("doc_id").collect(), texts)


def test_repetition_edges(spark, edge_docs, no_docs):
    odd = ["a " * 50, prose(4, 40) + "\n" + prose(4, 40), "x\ny\nx\n\n \n x", prose(5, 30) * 3, *[None, "", " a\x0bb "]]
    check_measures(measure(frame(spark, odd)).orderBy("doc_id").collect(), odd)
    assert measure(edge_docs).count() == edge_docs.count() and measure(no_docs).count() == 0
    kept = keep_unrepetitive(frame(spark, [prose(6, 100), "a " * 50, prose(7, 700) + " " + prose(7, 400)]))
    assert [r["doc_id"] for r in kept.collect()] == [0] and kept.columns == edge_docs.columns


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def area(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_quality_on_held_out_labels(spark):
    big = SF.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if held_out(r["doc_id"])}
    rows = {r["doc_id"]: r for r in quality_score(docs, labels, fold=0).collect()}
    assert area([(rows[i]["weight"], y) for i, y in truth.items()]) > 0.98
    right = sum(rows[i]["kept"] == bool(y) for i, y in truth.items())
    assert right / len(truth) > 0.97
    again = {r["doc_id"]: r for r in quality_score(docs, labels, fold=0).collect()}
    assert rows == again


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (8, 0, 0), (None, 1, 0), (99, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    rows = quality_score(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count()
    assert all(not r["kept"] for r in rows if r["weight"] is None)
    assert len({(r["weight"], r["kept"]) for r in rows if r["doc_id"] == 5}) == 1
    unlabelled = quality_score(edge_docs, labels.limit(0)).collect()
    assert all(r["kept"] == (r["weight"] is not None) for r in unlabelled)
    assert quality_score(no_docs, labels).count() == 0
    assert keep_quality(edge_docs, labels).columns == edge_docs.columns


def test_weights_equal_brute_force(spark):
    texts = ["Good words, good things!", "bad; bad; bad", "Ünï 中文 good", "", None, "a1 b2 -- c3 " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id bigint, quality int")

    def grams(text):
        tokens = regex.findall(r"[0-9a-z\u0080-\U0010ffff]+|[^0-9a-z\u0080-\U0010ffff\s]+", regex.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return tokens + list(zip(tokens, tokens[1:]))

    raw, target = Counter(), Counter()
    for i, text in enumerate(texts):
        raw.update(grams(text))
        target.update(grams(text) if i in (0, 2) else [])
    rest, of_raw, of_target = BUCKETS, sum(raw.values()), sum(target.values())
    wanted = [
        sum(np.log((target[g] + 1) / (of_target + rest)) - np.log((raw[g] + 1) / (of_raw + rest)) for g in grams(t)) if grams(t) else None
        for t in texts
    ]
    got = [r["weight"] for r in quality_score(docs, labels).orderBy("doc_id").collect()]
    assert got == [None if w is None else pytest.approx(w, abs=1e-4) for w in wanted]


def test_samples_follow_the_importances(spark):
    # one of four is kept, over many seeds: the chance of each is its share of the importances
    weights = [0.0, 1.0, -1.0, 2.0]
    n = 8000
    rows = spark.range(n).selectExpr("id AS seed", f"explode(array({', '.join(f'{w}D' for w in weights)})) AS weight")
    keyed = rows.withColumn("key", gumbel_key(F.col("weight"), F.xxhash64("seed", "weight")))
    first = keyed.groupBy("seed").agg(F.max_by("weight", "key").alias("weight")).groupBy("weight").count().collect()
    shares = np.exp(weights) / np.exp(weights).sum()
    assert {r["weight"]: r["count"] / n for r in first} == {w: pytest.approx(s, abs=0.025) for w, s in zip(weights, shares)}


def test_threshold_is_the_kth_greatest(spark):
    values = [1.0, 1.0, 5.0, -3.0, 1e-9, 1e300, 2.5, None]
    keys = spark.createDataFrame([(v,) for v in values], "k double")
    order = sorted((v for v in values if v is not None), reverse=True)
    assert [threshold_of(keys, "k", k) for k in range(1, 8)] == order
    assert threshold_of(keys, "k", 0) is None


def test_toxicity_on_held_out_labels(spark):
    big = SF.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if held_out(r["doc_id"])}
    rows = queries.RUNNERS["op7_toxicity"](spark, big).collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert area([(scores[i], y) for i, y in truth.items()]) > 0.93


def test_folding():
    assert fold("1d10t, IDIOT! ídiot") == " idiot idiot idiot "
    assert fold("mоrоn​ $cum") == " moron scum " and fold("moron$$$") == " moron "
    assert fold("l0ser") == fold("1oser") == fold("LOSER")
    assert fold(None) == fold("") == fold("!?") == " "


def test_exception_phrases():
    from hourloom.llm.toxicity import _automaton

    found = _automaton((("ciown", 2.0), ("idiot", 3.0)), ("ciown fish",))
    assert hits(" a ciown fish ", found) == [] and hits(" ciown ciown fish idiot ", found) == [2.0, 3.0]
    assert hits(" ciowns ", found) == []


def test_toxicity_edges(spark, edge_docs, no_docs):
    texts = [f"{prose(i, 20)} {'vilest' if i % 2 else WORDS[0]} {prose(i + 900, 20)}" for i in range(200)]
    docs = frame(spark, [*texts, None, "", "v1lest " + prose(1, 5)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id bigint, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity_score(docs, labels).collect()}
    assert rows[202]["predicted"] == 1 and rows[200]["predicted"] == rows[201]["predicted"] == 0
    assert all(rows[i]["predicted"] == i % 2 for i in range(200))
    assert drop_toxic(docs, labels).count() == 102
    assert {r["score"] for r in toxicity_score(edge_docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity_score(no_docs, labels).count() == 0


def test_diluted_words_stay_in_the_lexicon(spark):
    ids = [i for i in range(1000) if not held_out(i)][:600]
    texts, toxic = [], []
    for k, i in enumerate(ids):  # 300 toxic rows, 240 with tarnok alone; 300 others, 120 with the harmless phrase
        word = ("tarnok" if k < 240 else "gorvat" if k < 300 else "tarnok fish" if k < 420 else "gorvat moss" if k < 429 else "")
        texts.append(f"{prose(i, 12)} {'gorvat moss' if k == 299 else word} {prose(i + 5000, 12)}")
        toxic.append(int(k < 300))
    labels = spark.createDataFrame([(i, 1, y) for i, y in zip(ids, toxic)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["hit"] for r in toxicity_score(frame(spark, texts, ids), labels).collect()}
    hit = [got[i] for i in ids]
    assert hit[:299] == [1.0] * 299  # log odds of tarnok are below 2
    assert hit[300:420] == [0.0] * 120  # its harmless phrase
    assert hit[299] == 0.0 and hit[420:429] == [0.0] * 9  # 9 of the phrase's 10 rows are non-toxic


def test_exception_phrases_equal_the_plain_count(spark):
    rng = random.Random(6)
    vocabulary = [f"{w}{i}" for w in WORDS[:12] for i in "xyz"]
    texts = [" ".join(rng.choices(vocabulary, weights=range(1, 37), k=rng.randint(0, 30))) for _ in range(1500)] + ["", None]
    toxic = [int(rng.random() < 0.15) for _ in texts]
    terms, rare = {w: 1.0 for w in vocabulary[::2]}, set(vocabulary[:3])
    plain = {}
    for text, y in zip(texts, toxic):
        for phrase in phrases_of(text, frozenset(terms), frozenset(rare)):
            count = plain.setdefault(phrase, [0, 0])
            count[0] += y
            count[1] += 1
    want = {p for p, (t, n) in plain.items() if n >= 10 and 10 * t <= n}
    teaching = spark.createDataFrame(list(zip(texts, toxic)), "text string, toxic int").repartition(11)
    assert len(want) > 50 and learn_exceptions(teaching, terms, rare) == want
    assert learn_exceptions(teaching.limit(0), terms, rare) == set()


def test_hits_are_linear_in_phrases():
    from hourloom.llm.toxicity import _automaton

    phrases = tuple(f"tarnok word{i:05d}" for i in range(4000))
    found = _automaton((("tarnok", 2.0),), phrases)
    text = " " + " ".join(f"tarnok word{i:05d}" for i in range(4000)) + " tarnok alone "
    start = time.perf_counter()
    assert hits(text, found) == [2.0]
    assert time.perf_counter() - start < 0.5


def test_drop_toxic_keeps_whole_rows(spark):
    docs = frame(spark, ["fine words here", None, "more words"], [1, 2, None]).withColumnsRenamed({"shard": "_toxic", "weight": "id"})
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert drop_toxic(docs, labels).exceptAll(docs).isEmpty() and drop_toxic(docs, labels).count() == 3
