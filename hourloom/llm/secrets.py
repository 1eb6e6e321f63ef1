"""Secrets found through a trigram index: derived queries, postings, then the expressions themselves.

Every rule's expression is analysed into a Boolean query over trigrams it cannot match without.
Texts come in segments; each segment is indexed for the trigrams that some rule mentions, postings
are intersected, and a rule's expression runs only on its candidates. Rules without a mandatory
trigram (a run of hexadecimal digits) run on every text. Segments are independent of each other, so
nothing is shuffled, memory is bounded by a segment and a lost task is simply run again.

Defined results. A null text is empty and has no spans; very long texts are scanned whole; each row
gives its own result row, so repeated rows and ties need no rule. Spans are code points, end
exclusive, ordered by start and then by the order of RULES. Extra columns are ignored by scan and
kept by redact.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.trigrams import ANY, SegmentIndex, Vocabulary, trigram_query, trigrams_in
from hourloom.llm.words import LOWER, text_slices


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and do not overlap; those whose measured group is too short are dropped."""

    kind: str
    pattern: str
    shortest: int = 0
    group: int = 0
    any_case: bool = False
    body: str = ""  # extends a match that it follows at once; a match without it stays as it is

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.any_case else 0)


# what follows the first line of a key, through its last line; dashes inside stand in runs of four at most
KEY_BODY = r"(?:[^-]|-{1,4}[^-])*-----END [A-Z ]{0,40}PRIVATE KEY-----"
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        shortest=6,
        group=2,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", shortest=20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of 24 and more among the runs of [0-9a-f]+
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", body=KEY_BODY),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
)
SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


@lru_cache(maxsize=8)
def _plan(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    vocabulary = Vocabulary(set().union(*map(trigrams_in, queries)))
    bodies = [re.compile(r.body, r.flags) if r.body else None for r in rules]
    return queries, vocabulary, [re.compile(r.pattern, r.flags) for r in rules], bodies


def find_spans(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, number of the rule, end), ordered."""
    queries, vocabulary, patterns, bodies = _plan(rules)
    result = []
    for raw, offsets in text_slices(texts):
        index = SegmentIndex(LOWER[raw], offsets, vocabulary)
        buffer, spans, decoded = raw.tobytes(), [[] for _ in range(index.size)], {}
        for k, (rule, query, pattern, body) in enumerate(zip(rules, queries, patterns, bodies)):
            for i in index.candidates(query).tolist():
                text = decoded.get(i)
                if text is None:
                    text = buffer[offsets[i] : offsets[i + 1]].decode()
                    if query != ANY:
                        decoded[i] = text
                for m in pattern.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.shortest:
                        more = body.match(text, m.end()) if body else None
                        spans[i].append((m.start(), k, more.end() if more else m.end()))
        result.extend(sorted(s) for s in spans)
    return result


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, spans) of every row."""
    rules = tuple(rules)

    def spans_of(texts: pa.Array) -> pa.Array:
        found = find_spans(texts, rules)
        flat = [s for one in found for s in one]
        ends = np.cumsum([0, *map(len, found)])
        cells = [
            pa.array([rules[k].kind for _, k, _ in flat], pa.string()),
            pa.array([a for a, _, _ in flat], pa.int64()),
            pa.array([b for _, _, b in flat], pa.int64()),
        ]
        values = pa.StructArray.from_arrays(cells, names=["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    udf = F.arrow_udf(spans_of, SPANS)
    return docs.select("doc_id", udf(F.col("text").cast("string")).alias("spans"))


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; of overlapping spans the first counts."""
    rules = tuple(rules)

    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), find_spans(texts, rules)):
            parts, at = [], 0
            for start, k, end in spans:
                if start >= at:
                    parts += [text[at:start], f"[{rules[k].kind}]"]
                    at = end
            out.append(text if text is None or not parts else "".join(parts) + text[at:])
        return pa.array(out, pa.string())

    return docs.withColumn("text", F.arrow_udf(cut, "string")(F.col("text").cast("string")))


def op2_digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
