"""Infilling and vector codes against brute force, with edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from llm_fixtures import frame, prose

from hourloom.llm.codes import HOT, compress, decoded, limit, nearest, op12_digest, with_label_error
from hourloom.llm.infill import ERROR, RankIndex, boundaries, infill, op13_digest, rank_index, rearrange


def brute_infill(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        form, out, sizes = "plain", text, (None, None)
    else:
        form = "spm" if h4 % 100 < 20 else "psm"
        out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
        sizes = (len(pre), len(mid))
    return (doc_id, n, form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


HARD = ["a<P>b", "<S", "<P", "x <M y> <<S <<P>", ">" * 50, "🙂é\n" * 40, "<" * 9, "ab" * 50_000, prose(9, 30_000), "1 " * 40_000 + "z" * 9000]


def test_infill_equals_brute_force(spark, edge_docs, no_docs):
    docs = edge_docs.unionByName(frame(spark, HARD * 3, list(range(100, 100 + 3 * len(HARD)))))
    rows = op13_digest(infill(docs)).collect()
    want = [brute_infill(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert op13_digest(infill(no_docs)).count() == 0


def test_rearrange_keeps_other_columns(spark, edge_docs):
    rows, before = rearrange(edge_docs).collect(), edge_docs.collect()
    assert rearrange(edge_docs).columns == edge_docs.columns
    for new, old in zip(rows, before):
        assert new["text"] is None if old["text"] is None else sorted(new["text"].replace("<P>", "").replace("<S>", "").replace("<M>", "")) == sorted(old["text"])
        assert [new[c] for c in new.__fields__ if c != "text"] == [old[c] for c in old.__fields__ if c != "text"]


@pytest.mark.parametrize("text", [*HARD, "", "a", "a b"])
def test_rank_index_is_exact_and_bounded(text):
    values = boundaries(text)
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    assert values.tolist() == np.cumsum([0, *map(len, units)]).tolist()
    index = RankIndex.fit(values)
    ranks = np.arange(len(values))
    assert np.abs(values - index.predict(ranks)).max() <= ERROR + 1
    assert all(index.lookup(int(k)) == values[k] for k in ranks[:: max(1, len(ranks) // 200)])
    assert (index.predict(ranks) + index.residual == values).all()


def test_rank_index_is_small_on_prose():
    index = RankIndex.fit(boundaries(prose(4, 20_000)))
    assert len(index.first) < len(index.residual) / 100


def test_rank_index_table(spark, edge_docs):
    for r, d in zip(rank_index(edge_docs, 8).collect(), edge_docs.collect()):
        residual = np.frombuffer(r["residuals"], np.int8)
        values = boundaries(d["text"] or "")
        assert len(residual) == len(values) and np.abs(residual.astype(int)).max() <= 9
        assert [s["base"] for s in r["segments"]] == [values[s["first"]] for s in r["segments"]]
    with pytest.raises(ValueError):
        rank_index(edge_docs, 500)


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """(sorted result rows, sha256 of the codebooks) by plain loops; all vectors of one length."""
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in good]
    width = len(whole[0]) // parts
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def choose(p, part):
        return min(range(len(books[p])), key=lambda e: (distance(part, books[p][e]), e))

    for _ in range(rounds):
        for p in range(parts):
            chosen = [choose(p, c[p]) for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, k in zip(cut, chosen) if k == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    codes = [[choose(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(distance(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes)]
    totals = {}
    for (_, _, label), e in zip(good, errors):
        totals[label] = totals.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{k:02x}" for k in c), e, totals[lab], sha) for (i, _, lab), c, e in zip(good, codes, errors)]
    return sorted(out, key=repr)


SCHEMA = "vec_id bigint, embedding array<float>, label int, codes string, _label string, error string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y", "z") for i, v, lab in rows], SCHEMA)


def random_rows(n, dimension=32, seed=1):
    rng = random.Random(seed)
    # few distinct values, so that ties of distances and of sums are frequent
    return [(i, [rng.randint(-3, 3) / 4 for _ in range(dimension)], rng.choice([None, 1, 2, i])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 20, 300])
def test_codes_equal_brute_force(spark, n):
    rows = random_rows(n)
    spoiled = [(-1, None, 1), (-2, [None] * 32, 1), (-3, [float("nan")] + [0.0] * 31, 2), (-4, [float("inf")] * 32, 2), (5, rows[0][1], 9)]
    spoiled += [(None, rows[0][1], 1), (-5, [0.5] * 31 + [None], 3)]
    got = op12_digest(*compress(vectors(spark, rows + spoiled).repartition(7)))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(rows + spoiled)


def test_codes_of_odd_tables(spark):
    assert compress(vectors(spark, []))[0].count() == 0
    assert compress(vectors(spark, [(1, [], 2), (2, None, None)]))[0].count() == 0
    # another length than the first kept vector is dropped; 5 components are filled up to 16
    coded, books = compress(vectors(spark, [(1, [0.5] * 5, 1), (2, [0.25] * 4, 1), (3, [1.0] * 5, 1)]))
    assert {r["vec_id"] for r in coded.collect()} == {1, 3} and books[0].shape == (2, 1)
    assert decoded(b"\x00" * 16, books)[:5] == [(128 + 0.5) / 256] * 5
    # components out of range are clamped, and nothing overflows
    top = limit(32, 16) / 256
    huge = compress(vectors(spark, [(1, [3e38] * 32, 1), (2, [-3e38] * 32, 1), (3, [top] * 32, 1)]))[0]
    assert all(0 <= r["error"] <= r["label_error"] for r in huge.collect())


def test_search_ends_strictly_and_ties_go_down():
    entries = np.array([[4, 0], [0, 4], [2, 2], [0, 0], [2, 2]])
    index, gap = nearest(np.array([[3, 3], [2, 2], [2, 0], [9, 9], [-9, -9]]), entries)
    assert index.tolist() == [2, 2, 0, 2, 3] and gap.tolist() == [2, 0, 4, 98, 162]


def test_label_error_of_frequent_and_rare_labels(spark):
    n = 3 * HOT
    rows = [(i, None if i % 3 == 0 else 7 if i % 3 == 1 else i, b"", i) for i in range(n)]
    coded = spark.createDataFrame(rows, "vec_id bigint, label int, codes binary, error bigint")
    got = {r["vec_id"]: r["label_error"] for r in with_label_error(coded).collect()}
    sums = {}
    for i, label, _, e in rows:
        sums[label] = sums.get(label, 0) + e
    assert got == {i: sums[label] for i, label, _, _ in rows}
