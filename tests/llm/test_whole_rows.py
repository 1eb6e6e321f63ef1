"""Functions that keep rows keep them whole, whatever their columns are called."""

import pytest
from llm_fixtures import prose
from pyspark.sql import functions as F

from hourloom.llm import store
from hourloom.llm.decontaminate import remove_documents, remove_spans
from hourloom.llm.mixing import mix
from hourloom.llm.neardup import drop_near_duplicates
from hourloom.llm.quality import keep_good as keep_quality
from hourloom.llm.repetition import keep_good as keep_unrepetitive
from hourloom.llm.secrets import redact
from hourloom.llm.sharding import shard_rows

# names that the operators use for helpers of their own
CLASHING = [
    "row", "_row", "_id", "_none", "_hash", "_i", "_n", "_times", "_share", "_again", "_key", "_weight", "weight", "gumbel_key",
    "_measures", "measures", "_hit", "hit", "bad_id", "bad_hash", "id", "root", "times", "_shard", "_slot", "a.b",
]


@pytest.fixture(scope="module")
def marked(spark):
    texts = [prose(i, 80) for i in range(30)] + [prose(3, 80), None, "", prose(99, 200)]
    rows = [(i, t, "en", "ab"[i % 2], 7, *[f"{c}-{i}" for c in CLASHING]) for i, t in enumerate(texts)]
    rows.append((None, texts[0], "en", None, 7, *["null" for _ in CLASHING]))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema)


def keepers(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([("x", prose(99, 12))], "item_id string, text string")
    return {
        "mix": mix,
        "keep_quality": lambda d: keep_quality(d, labels),
        "keep_unrepetitive": keep_unrepetitive,
        "remove_documents": lambda d: remove_documents(d, bench),
        "drop_near_duplicates": drop_near_duplicates,
    }


@pytest.mark.parametrize("name", ["mix", "keep_quality", "keep_unrepetitive", "remove_documents", "drop_near_duplicates"])
def test_kept_rows_are_whole(spark, marked, name):
    kept = keepers(spark)[name](marked)
    assert kept.columns == marked.columns and kept.dtypes == marked.dtypes
    assert kept.distinct().exceptAll(marked).isEmpty() and not kept.isEmpty()


def test_places_and_cut_texts_leave_other_columns(spark, marked):
    placed = [r[:-2] for r in shard_rows(marked).collect()]
    assert sorted(placed, key=repr) == sorted(map(tuple, marked.collect()), key=repr)
    bench = spark.createDataFrame([("x", prose(99, 12))], "item_id string, text string")
    for cut in (remove_spans(marked, bench), redact(marked)):
        assert cut.columns == marked.columns
        assert cut.drop("text").exceptAll(marked.drop("text")).isEmpty() and cut.count() == marked.count()
    assert remove_spans(marked, bench).where(F.col("doc_id") == 33).first()["text"] != marked.where("doc_id = 33").first()["text"]


KEY = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\nMIIEowIBAAKCAQEAabcDEF\n--x\n-----END RSA PRIVATE KEY-----"


def test_private_keys_are_redacted_whole(spark):
    texts = [f"x {KEY} y", f"{KEY}\n{KEY}", KEY[:60] + " cut off", "-----BEGIN PRIVATE KEY-----" * 3000]
    got = [r["text"] for r in redact(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()]
    assert got[0] == "x [private_key] y" and got[1] == "[private_key]\n[private_key]"
    assert "MIIE" not in got[0] + got[1] and got[2].startswith("[private_key]") and got[3] == "[private_key]" * 3000


def test_folder_without_a_setting(spark, monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    first, second = store.shared_folder(Session()), store.shared_folder(Session())
    assert first.startswith("file:///") and first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
