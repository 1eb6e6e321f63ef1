"""Texts and frames of the tests in this folder."""

import random

SF = "/root/testdata/sf0.01"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "so") for b in ("an", "el", "ir", "os", "un", "ath", "ing")]
# extra columns whose names the operators use themselves
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, n_words string, _hash string, weight string, spans string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    rows = [(i, t, "en", s, len(t or ""), "x", "y", "z", "w", "v") for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, SCHEMA)


EDGES = [None, "", " \n\t ", "one", prose(1, 4), prose(2, 60), prose(2, 60), prose(3, 12_000), "ünï 中文 🙂 " * 9]


