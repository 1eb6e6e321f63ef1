"""Personal data: base spans against brute force, the supervision, edge cases and redaction."""

import hashlib
import random
import re

from llm_fixtures import EDGES, SF, frame, prose

from hourloom.llm import queries
from hourloom.llm.personal import BASE_KINDS, BLOCK, CELLS, KINDS, PIECE, candidates, find, fit, op11_digest, posterior, redact, reliabilities, vote_counts

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    found = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def check(rows, texts):
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        want = base_spans(text or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (text or "")[:80]
        for k in BASE_KINDS:
            assert r[f"n_{k}"] == sum(x.startswith(f"{k}:") for x in want)
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert {":".join(x) for x in spans} >= set(want)
        order = [(int(a), KINDS.index(k)) for k, a, _ in spans]
        assert order == sorted(order) and all(int(b) <= len(text) for _, _, b in spans)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = queries.RUNNERS["op11_personal"](spark, SF).orderBy("doc_id").collect()
    check(rows, [d["text"] for d in docs])


ALPHABETS = ["0123456789.", "0123456789 -", "+0123456789 ().-", "ab.@-%", "a1.@+ -\n", "é🙂1.2@a+"]
PLAIN = [
    "a@b.c%d@e.f x@y a.@b..c a@b.c.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0004 1..2.3.4",
    "4111 1111-1111 1111 4111  1111 41111111111111111111111 4111111111111111-",
    "+1 (555) 123-4567 +12 +1() 2 +1+12345678901 +123456789012345678",
    "mail é🙂 ann@b.org, call +44 20 7946 0958",
]


def test_base_spans_of_hard_texts(spark, edge_docs, no_docs):
    rng = random.Random(3)
    texts = [*PLAIN, *("".join(rng.choice(a) for _ in range(n)) for a in ALPHABETS for n in (3, 17, 90, 400) for _ in range(4))]
    # more matches in one text than a block of the running totals, long runs and deep repeats
    texts += ["x@y.z " * (3 * BLOCK), "1.2.3.4 " * (BLOCK + 1), "5" * 60_000, "a" * 60_000, "a@b" + ".c" * 40_000, "1 " * 40_000, "+1" + "-" * 30_000]
    check(op11_digest(find(frame(spark, texts).repartition(5))).orderBy("doc_id").collect(), texts)
    check(op11_digest(find(edge_docs)).collect(), [r["text"] for r in edge_docs.collect()])
    assert op11_digest(find(no_docs)).count() == 0


CLEAN = [prose(s, 200) for s in range(30)] + ["Version 3.14.1592 of 2024-01-02, pages 12-19.", "Of The Rue Des Monts And It Was", "isbn 978 0 306 40615 7"]
NAMED = [f"{prose(s, 20)}. My name is {n} {f} and {prose(s + 50, 20)}" for s, (n, f) in enumerate([("Mary", "Hollis"), ("Hans", "Becker"), ("Priya", "Rao")] * 4)]
SPELLED = [f"{prose(s, 9)} contact: ann.b{s} (at) example (dot) com {prose(s, 9)}" for s in range(12)]


def test_method_adds_spans_and_leaves_clean_texts(spark):
    texts = [*CLEAN, *NAMED, *SPELLED, *[f"x {prose(i, 3)}. {prose(i, 2).title()} {prose(i + 9, 4)}" for i in range(60)]]
    got = {r["doc_id"]: r["spans"] for r in find(frame(spark, texts)).collect()}
    assert all(not got[i] for i in range(len(CLEAN)))
    for i, text in enumerate(NAMED, len(CLEAN)):
        assert [text[s["start"] : s["end"]] for s in got[i] if s["kind"] == "person"] == [re.search("is ([A-Z]\\w+ [A-Z]\\w+)", text)[1]]
    for i in range(len(CLEAN) + len(NAMED), len(CLEAN) + len(NAMED) + len(SPELLED)):
        assert [s["kind"] for s in got[i]] == ["spelled_email"]
        assert all(0.5 <= s["score"] <= 1 and not s["base"] for s in got[i])


def test_reliabilities_are_recovered():
    rng = random.Random(1)
    right, counts, truth = [0.95, 0.9, 0.7, 0.6, 0.55], {}, {}
    for _ in range(40_000):
        z = rng.random() < 0.3
        votes = tuple(0 if rng.random() < 0.3 else (1 if z == (rng.random() < q) else -1) for q in right)
        counts[votes] = counts.get(votes, 0) + 1
        truth.setdefault(votes, [0, 0])[z] += 1
    belief = reliabilities(counts)
    assert abs(belief["prior"] - 0.3) < 0.03
    for table, q in zip(belief["votes"], right):
        assert abs(table[True][1] - 0.7 * q) < 0.06 and abs(table[False][-1] - 0.7 * q) < 0.06
    wrong = sum(n[0 if posterior(belief, v) >= 0.5 else 1] for v, n in truth.items())
    best = sum(min(n) for n in truth.values())
    assert wrong <= best * 1.1
    scaled = reliabilities({v: 1000 * n for v, n in counts.items()})  # behaves alike at every size
    assert abs(scaled["prior"] - belief["prior"]) < 1e-9


def test_votes_are_counted_over_all_rows(spark):
    docs = frame(spark, [*PLAIN * 3, *NAMED])
    found = candidates(docs)
    counts = vote_counts(found).collect()
    assert sum(r["n"] for r in counts) == sum(len(r["candidates"]) for r in found.collect())
    assert len(counts) <= CELLS * len(KINDS)
    model = fit(found)
    assert set(model.reliabilities) <= set(KINDS)
    assert fit(candidates(frame(spark, ["nothing"]))) is None


def brute_redact(text, spans):
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    # a stretch is what overlapping spans cover together
    return "".join(out) + text[at:]


def test_redaction_equals_brute_force(spark):
    mail, phone = "ann@example.com, 1.2.3.4 ", "+1 (555) 123-4567"
    long = [f * (PIECE // len(f) - 3) + mail + f * PIECE + phone for f in ("x ", "é🙂 ", "word ")]
    texts = [*PLAIN, *EDGES, *long, "+4111 1111 1111 1111", "é🙂 a@b.c+14155550100"]
    docs = frame(spark, texts).withColumnRenamed("spans", "candidates")
    want = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in find(docs).collect()}
    rows = redact(docs).orderBy("doc_id").collect()
    assert redact(docs).columns == docs.columns
    for r, before in zip(rows, docs.orderBy("doc_id").collect()):
        expected = None if before["text"] is None else brute_redact(before["text"], want[r["doc_id"]])
        assert r["text"] == expected
        assert [r[c] for c in docs.columns if c != "text"] == [before[c] for c in docs.columns if c != "text"]
