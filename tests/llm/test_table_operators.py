"""Decontamination, near copies, records, chat, sharding, mixing and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import compare, integer_widths, oracle_connection
from llm_fixtures import EDGES, SF, frame, prose

import corpus_pipeline
from hourloom.llm import queries
from hourloom.llm.chat import format_conversations, format_segments, parse, read_segments, round_trip
from hourloom.llm.components import components
from hourloom.llm.decontaminate import contamination, op1_digest, remove_documents, remove_spans
from hourloom.llm.mixing import closest_subset, fit_lengths, mix, plan
from hourloom.llm.neardup import drop_near_duplicates, near_duplicates, registers_of
from hourloom.llm.sharding import assign, exchanges, flows, shard_rows
from hourloom.llm.token_records import Encoder, frame as framed, read_digests, read_frame, read_shuffled, write_records

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = oracle_connection(SF)
    assert compare(spark, SF, queries.RUNNERS[name], queries.SQL[name], con) is None
    assert integer_widths(spark, SF, queries.RUNNERS[name], queries.SQL[name], con) == []


# --- decontamination -----------------------------------------------------------------------------------


def brute_contamination(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {i: i + 32 for i in range(65, 91)}
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall((text or "").translate(lower))
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, names = word.findall((text or "").translate(lower)), set(), set()
        for i in range(len(w)):
            for n in {len(k) for k in windows}:
                if (found := windows.get(tuple(w[i : i + n]))) and i + n <= len(w):
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("bound", [200_000, 7])
def test_decontamination(spark, edge_docs, no_docs, bound):
    passage, short = prose(50, 25), "zeta Eta theta"
    texts = [*EDGES, "x " + passage.upper() + " y", prose(51, 30) + " " + short + ".", " ".join(passage.split()[:9]), passage + " " + passage]
    items = [(1, passage), (1, passage), (10, short), (2, passage), (None, prose(60, 12)), (3, None), (4, " .,")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, [*texts, texts[9]], [*range(len(texts)), 9])
    rows = op1_digest(contamination(docs, bench, max_windows=bound)).collect()
    want = brute_contamination([*texts, texts[9]], items)
    got = [(r["doc_id"], *tuple(r)[1:]) for r in rows]
    assert Counter(got) == Counter((i, *x) for i, x in zip([*range(len(texts)), 9], want))
    bad = {i for i, x in enumerate(want) if x[4]}
    kept = remove_documents(docs, bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - bad and kept.columns == docs.columns
    cut = remove_spans(docs, bench)
    assert cut.count() == docs.count() and not any(r["hit_words"] for r in contamination(cut, bench).collect())
    assert contamination(no_docs, bench).count() == 0
    clean = contamination(edge_docs, bench.limit(0)).collect()
    assert len(clean) == edge_docs.count() and not any(r["hit_words"] for r in clean)


# --- near copies ---------------------------------------------------------------------------------------


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(ids, texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                parent[root(i)] = root(j)
    low = defaultdict(list)
    for i in range(len(ids)):
        low[root(i)].append(ids[i])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return [(ids[i], len(sets[i]), smallest[root(i)]) for i in range(len(ids))]


def near_texts():
    """Chains and stars around the threshold, a group with many differences of its own, shared passages."""
    texts, base = [], prose(70, 150).split()
    for k in range(60):
        w = list(base)
        for e in range(k % 5):
            w[(k * 13 + e * 37) % 150] = f"edit{k}x{e}"
        texts.append(" ".join(w))
    w = list(prose(71, 200).split())
    for k in range(20):  # a chain: each differs from the one before
        w[(k * 9) % 200] = f"link{k}"
        texts.append(" ".join(w))
    shared = prose(72, 60)
    texts += [f"{shared} {prose(100 + k, 40 + k)}" for k in range(40)]
    return texts + texts[:5]


def test_near_copies_equal_brute_force(spark):
    texts = [*near_texts(), *EDGES]
    ids = [*range(len(texts) - 1), None]
    found = near_duplicates(frame(spark, texts, ids)).collect()
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found)
    want = brute_components(ids, texts)
    assert got == Counter((i, n, c if n else i) for i, n, c in want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    kept = drop_near_duplicates(frame(spark, texts, ids))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({c for i, n, c in want if n and c is not None} | {i for i, n, _ in want if not n and i is not None})


def test_near_copies_edges(spark, edge_docs, no_docs):
    found = near_duplicates(edge_docs).collect()
    assert len(found) == edge_docs.count()
    assert {r["component_id"] for r in found if r["doc_id"] in (5, 6)} == {5}
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [5]
    assert drop_near_duplicates(edge_docs).where("doc_id = 5").count() == 1
    assert near_duplicates(no_docs).count() == 0 and drop_near_duplicates(no_docs).count() == 0


def test_one_row_of_each_component_stays(spark):
    one, two, three, four = (prose(80 + k, 30) for k in range(4))
    ids = [None, None, None, None, 7, 7, 7, 7, 8, None, None, None, None, 9, 9]
    texts = [one, two, two, three, one + " x", four, four, prose(90, 30), four, None, None, "", "", None, None]
    kept = drop_near_duplicates(frame(spark, texts, ids, [f"s{i % 3}" for i in range(len(ids))]))
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    want = [(7, one + " x"), (None, two), (None, three), (7, four), (7, prose(90, 30))]
    want += [(None, None), (None, None), (None, ""), (None, ""), (9, None), (9, None)]
    assert got == Counter(want)
    same = frame(spark, [one] * 40 + [None] * 40, [None] * 80)
    assert Counter(r["text"] for r in drop_near_duplicates(same).collect()) == {one: 1, None: 40}


def test_registers_merge_and_agree_with_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    both = registers_of(np.concatenate([a[:3000], a[1000:], a]), np.array([0, 3000, 6000]))
    assert (np.maximum(both[0], both[1]) == both[2]).all()
    assert abs((both[0] == both[1]).mean() - 0.5) < 0.12


def test_components(spark):
    links = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q")], "a string, b string")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{f"{i:03d}": "000" for i in range(1, 41)}, "y": "x"}
    assert components(links.limit(0)).count() == 0
    # a hub with many neighbours, half of which have a chain of their own
    hub = [(0, i) for i in range(1, 3000)] + [(i, i + 10_000) for i in range(1, 1500)] + [(i + 10_000, i + 20_000) for i in range(1, 700)]
    apart = [(50_000, 50_001), (50_002, 50_001)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(hub + apart, "a bigint, b bigint")).collect()}
    assert got == {**{x: 0 for link in hub for x in link if x}, 50_001: 50_000, 50_002: 50_000}


# --- token records -------------------------------------------------------------------------------------


def tokenizer_path():
    from public_tokenizers import path

    return path("word_bpe_49k.json")


ODD = [
    "Hello <|endoftext|> x<|startoftext|>y", "<|ENDOFTEXT|> A", "H\u0331 x J\u030c \u00c9", "don't I'LL we'Re", "a\x1cb\u00a0c\x85d",
    "\u03a3 \u0130 \u01c5 \ufb01", "foo . . ' s 's u.s. foo.. x,y z!", "\u4e2d\u6587 \U0001f642\U0001f642!!!",
]


def test_word_cache_equals_whole_texts():
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path(), True)
    for text in ODD * 2:
        got = np.frombuffer(encoder.encode([text.encode()])[0], "<u2").tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode(self, text, **kwargs):
        self.texts += 1
        return self.tokenizer.encode(text, **kwargs)

    def encode_batch_fast(self, texts, **kwargs):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **kwargs)


def test_new_words_reach_the_tokenizer_as_few_texts(monkeypatch):
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path(), True)
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdeforstuvz\u00e9\u00df\u0130\u4e2d'.,!$7"))
    words = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 12, 6000)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(200)]
    texts += ["", " ", "\t\n \x0b\x0c\r ", "  two \r\n words\t", *ODD, "e\u0301 \u0958x \u1100\u1161", "\u3000 \x1c x"]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    got = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == want
    assert 0 < counted.texts < 40 and len(encoder.known) > 3000  # one by one they would be thousands
    before = counted.texts
    assert encoder.encode([t.encode() for t in texts]) == got and counted.texts == before
    assert encoder.encode([b""]) == [b""] and encoder.encode([]) == []
    # the cache is dropped in between
    monkeypatch.setattr("hourloom.llm.token_records.CACHED_WORDS", 100)
    assert [x for t in texts for x in encoder.encode([t.encode()])] == got


def test_records_round_trip(spark, edge_docs, no_docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.RUNNERS["op4_token_records"](spark, SF).collect()}
    start = 0
    for r in docs:
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        assert got[r["doc_id"]] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for by_word in (True, False):
        manifest = write_records(edge_docs, tokenizer_path(), 1, by_word=by_word)
        rows = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in read_digests(manifest).collect())
        assert rows[0][2] is None and [x[2] for x in rows[1:]] == sorted(x[2] for x in rows[1:])
        assert all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:]))
        mixed = {(r["doc_id"], len(r["ids"])) for r in read_shuffled(manifest, 3).collect()}
        assert mixed == {(x[2], x[1]) for x in rows}
    assert read_digests(write_records(no_docs, tokenizer_path(), 1)).count() == 0


def test_damage_is_noticed():
    import io

    record = framed(b"\x02abcd")
    assert read_frame(io.BytesIO(record)) == b"\x02abcd" and read_frame(io.BytesIO(b"")) is None
    for broken in (record[:-1], record[:5], b"\x09" + record[1:], record[:13] + b"?" + record[14:]):
        with pytest.raises(ValueError):
            read_frame(io.BytesIO(broken))


# --- chat ----------------------------------------------------------------------------------------------

HOSTILE = [
    "\\### Assistant: </turn> ok", "\\\\e", "\\e", "a\\\\\\h", "</turn>\n### user: x", "</tur", "n>", "### ", "C:\\dir", "\\", "\\\\", "", None,
    "<</turn>/turn>", "x</turn></turn>", "é🙂 ### </turn>",
]


def test_chat_round_trip(spark):
    roles = ["user", "assistant", "a: b</turn>", None, "### x\\c"]
    rows = [(c, t, roles[(c + t) % 5], text, "x") for c in range(3) for t, text in enumerate(HOSTILE)]
    rows += [(9, t, "assistant", f"t{t}", "x") for t in range(300)] + [(9, 7, "assistant", "t7", "x"), (9, None, "user", "first", "x"), (None, 0, "user", "lost", "x")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, segment string")
    want = defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    got = {r["conv_id"]: r for r in round_trip(table).collect()}
    whole = {r["conv_id"]: r["turns"] for r in format_conversations(table).select("conv_id", parse(F_col("formatted")).alias("turns")).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in whole[c]] == [x[2:] for x in turns]
        assert got[c]["turns_text"] == "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        assert got[c]["loss_text"] == "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
    segments = format_segments(table).collect()
    assert max(len(s["loss_spans"]) for s in segments) <= 65
    assert round_trip(table.limit(0)).count() == 0 and read_segments(format_segments(table)).count() == len(segments)


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


# --- sharding ------------------------------------------------------------------------------------------


def check_shards(rows, n, shards=16):
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == n and max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(shards)), default=0) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding(spark, edge_docs, no_docs):
    texts = ["hot"] * 20 + [f"pair {i // 2}" for i in range(200)] + [f"alone {i}" for i in range(97)] + [None, None, ""]
    docs = frame(spark, texts)
    rows = assign(docs).collect()
    check_shards(rows, len(texts))
    where = defaultdict(Counter)
    for r in rows:
        text = texts[r["doc_id"]]
        where[text][r["shard"]] += 1
        assert r["size"] == len((text or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text or "").encode())
    assert sum(len(where[f"pair {i}"]) > 1 for i in range(100)) <= 8
    assert max(where["hot"].values()) >= 10  # a quota is 26 rows; the hash alone gives each shard one or two
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in rows} == {r["doc_id"]: (r["shard"], r["slot"]) for r in assign(docs).collect()}
    check_shards(assign(edge_docs).collect(), edge_docs.count())
    placed = shard_rows(edge_docs)
    check_shards(placed.collect(), edge_docs.count())
    assert set(placed.columns) == set(edge_docs.columns) | {"slot"}
    assert assign(no_docs).count() == 0 and shard_rows(no_docs).count() == 0


@pytest.mark.parametrize("copies,hot", [(2, 0), (4, 0), (2, 1100)])
def test_groups_meet_in_full_shards(spark, copies, hot):
    texts = ["hot"] * hot + [f"text {i // copies}" for i in range(3200 - hot)]
    rows = assign(frame(spark, texts)).collect()
    check_shards(rows, len(texts))
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(v) > 1 for t, v in where.items() if t != "hot") <= 0.01 * len(where)
    assert len(where["hot"]) <= 12  # 1100 rows need six shards of 200; the hash alone spreads them over all 16


def test_flows_fit():
    wants = {(0, 1): 10, (1, 2): 4, (2, 0): 7, (2, 1): 5, (3, 0): 9}
    flow = flows(wants, [0, 0, 0, -3])
    leaving = [sum(n for (a, _), n in flow.items() if a == s) for s in range(4)]
    entering = [sum(n for (_, b), n in flow.items() if b == s) for s in range(4)]
    assert all(0 <= flow[p] <= wants[p] for p in wants) and all(e <= x + 0.01 for e, x in zip(entering[:3], leaving))
    assert flows({(0, 1): 5}, [0, 2])[0, 1] == pytest.approx(2)
    cycle = flows({(0, 1): 10, (1, 2): 4, (2, 0): 7}, [0, 0, 0])
    assert all(n == pytest.approx(4, abs=0.01) for n in cycle.values())
    out = exchanges(wants, flow, {0: 100, 1: 2})
    assert out[0, 3] == pytest.approx(wants[3, 0] - flow[3, 0]) and sum(n for (b, _), n in out.items() if b == 1) <= 2.001


# --- mixing --------------------------------------------------------------------------------------------


def test_closest_subset():
    rng = np.random.default_rng(4)
    for _ in range(200):
        lengths = np.unique(rng.integers(1, 40, rng.integers(1, 7)))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = closest_subset(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert abs(int((taken * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)
    lengths, counts = np.arange(1, 3000), np.full(2999, 5)
    assert int((fit_lengths(lengths, counts, 7_654_321) * lengths).sum()) == 7_654_321


def water(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check_mix(rows, sources):
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = sources[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["size"] * r["times"]
        target[s] = r["target"]
        assert r["size"] * r["times"] <= 2 * r["size"]
    want = water(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-12)
        assert abs(taken[s] - target[s]) <= 1


def test_mixing(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    planned = plan(docs).collect()
    check_mix(planned, {r["doc_id"]: r["source"] for r in rows})
    assert {r["doc_id"]: r["size"] for r in planned} == {r["doc_id"]: len(SPACES.findall(r["text"] or "")) for r in rows}
    assert sorted(planned) == sorted(plan(docs).collect())
    times = {r["doc_id"]: r["times"] for r in planned}
    assert Counter(r["doc_id"] for r in mix(docs).collect()) == Counter({i: n for i, n in times.items() if n})
    assert plan(edge_docs).count() == edge_docs.count() and mix(edge_docs).columns == edge_docs.columns
    assert mix(edge_docs).count() == sum(r["times"] for r in plan(edge_docs).collect())
    assert plan(no_docs).count() == 0 and mix(no_docs).count() == 0
    assert plan(frame(spark, [None, ""])).select("target", "times").distinct().collect() == [(0.0, 0)]


# --- the pipeline --------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names, before = docs.columns, docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        table = spark.createDataFrame(before, docs.schema)
        after_table = stage(spark, table, SF)
        after = after_table.collect()
        ids = [r["doc_id"] for r in after]
        if name != "sharding":
            assert after_table.columns == names and set(after) <= set(before)
        if name == "quality":
            right = [(r["doc_id"] in set(ids)) == bool(labels[r["doc_id"]]) for r in before if r["doc_id"] in labels]
            assert sum(right) / len(right) > 0.95
        elif name == "near_copies":
            want = brute_components([r["doc_id"] for r in before], [r["text"] for r in before])
            assert sorted(ids) == sorted({c for _, n, c in want if n} | {i for i, n, _ in want if not n})
        elif name == "decontamination":
            bad = brute_contamination([r["text"] for r in before], items)
            assert sorted(ids) == [r["doc_id"] for r, x in sorted(zip(before, bad)) if not x[4]]
        elif name == "mixing":
            counted = Counter(ids)
            sources = {r["doc_id"]: r["source"] for r in before}
            check_mix([r.asDict() | {"times": counted[r["doc_id"]]} for r in plan(table).collect()], sources)
        else:
            check_shards(after, len(before))
            assert Counter(ids) == Counter(r["doc_id"] for r in before)
        before = after
    assert queries.RUNNERS["pipeline"](spark, SF).count() == len(before)


def test_registered_names():
    assert sorted(queries.RUNNERS, key=lambda n: int(re.sub(r"\D", "", n.split("_")[0]) or 99)) == [
        "op1_decontaminate", "op2_secrets", "op3_near_duplicates", "op4_token_records", "op5_repetition", "op6_chat",
        "op7_toxicity", "op8_sharding", "op9_mixing", "op10_quality", "pipeline",
    ]
    assert pa.__version__
