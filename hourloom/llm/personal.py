"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Built from DataFrame functions only. Each kind has an expression whose leftmost, non-overlapping matches
are the candidates. split() and regexp_extract_all() give the gaps and the matches of a text in order, and
running totals of their lengths give the places. Five labelers vote -1, 0 or 1 on every candidate: its
form and its checksum (regular expressions), gazetteers, and the words before it and the signs around it
(context). Candidates are counted by kind and votes over all documents; expectation-maximisation on these
counts estimates for each kind how often a labeler votes what on personal data and on other text. Its
probabilities, as weights, train a logistic regression over votes, kind and form of a span, which gives
the final score. The spans of the base rules always stay; other candidates are added from THRESHOLD on.

Scale. Texts are read once; what is written is one row per document with its candidates. Counts are
summed map-side and have at most 3**5 rows a kind and at most CELLS a kind, so they may be collected and
fitted in one task. Nothing is grouped by document.

Defined results. A null text is empty and has no spans; very long texts are read whole; repeated rows each
get a row. Offsets are code points, end exclusive; spans are ordered by start and then by kind as listed
in KINDS. Spans of different kinds may overlap, redact() replaces each stretch that they cover together.
With no candidate at all every row has empty spans. Extra columns are ignored by find and kept by redact.

The expressions use possessive repeats and look-behinds where they give the same matches, so that a long
run of one class costs linear time and no deep recursion.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.store import saved

BASE_KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
CONTEXT = 40  # code points read before a candidate
CELLS = 3**5 * 3 * 3  # votes x length class x share of digits
EM_ROUNDS, EM_ANCHOR = 30, 0.05  # the anchor is the share of a kind's candidates that the starting belief weighs
PIECE = 4096  # code points that redact() cuts at once
NEWTON_STEPS, PENALTY = 50, 1e-4
BLOCK = 256  # running totals are built over blocks of this many entries

# --- Fixed values: expressions of the candidates -------------------------------------------------------
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9A-Za-z+()./-])(?<!\+[0-9]{1,3}[\x20.-]{1,2})\(?[0-9]{3}\)?[\x20./-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "spelled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]{1,63}){1,5}",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "person": r"(?<![A-Za-z])[A-Z][a-z]{1,24}(?:\x20[A-Z]\.)?\x20[A-Z][a-z]{1,24}(?![A-Za-z])",
}
KINDS = tuple(PATTERNS)
# --- Fixed values: words that speak for a kind when they stand before it, and words that speak against all
CUES = {
    "email": "e-?mail|mailto|contact|write to|reach",
    "ip": "ip|host|server|client|address|login from",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "tel|phone|call|mobile|cell|fax|whatsapp|contact",
    "local_phone": "tel|phone|call|mobile|cell|fax|whatsapp|contact",
    "spelled_email": "e-?mail|contact|write to|reach",
    "national_id": "ssn|social security|national id|tax id|tax number",
    "iban": "iban|account|bank|transfer to",
    "person": "mr|mrs|ms|dr|prof|my name is|named|signed|sincerely|regards|dear",
}
AGAINST = "isbn|issn|doi|version|release|build|order|invoice|ticket|page|figure|fig|section|chapter|serial|sku|part no"
# --- Fixed values: gazetteers --------------------------------------------------------------------------
GIVEN_NAMES = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica "
    "Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Mark Donald Steven Paul Andrew Kenneth George Anna Peter "
    "Hans Klaus Ursula Jean Pierre Marie Claire Jose Juan Carlos Luis Ana Carmen Sofia Laura Emma Olivia Noah Liam Ahmed "
    "Fatima Wei Ivan Olga Raj Priya"
).split()
NOT_NAMES = (
    "The A An Of In On And Or For With From To At By It Is Was This That These Those He She We They You Der Die Das Und Ein "
    "Eine Le La Les Un Une Des El Los Las Y De Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February "
    "March April May June July August September October November December"
).split()
MAIL_ENDS = "com org net edu gov io info de fr es uk it nl eu ch at us ca".split()
BANK_COUNTRIES = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split()
DIAL_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 62 81 82 86 90 91 351 353 358 420".split()

# --- Fixed values: forms that are usual for a kind, and forms that are not; signs around a candidate -----
FORMS = {
    "email": (r"^[A-Za-z0-9][^@]{1,63}@(?!.*\.\.)[^@]{3,}$", r"\.\.|^[.%+-]"),
    "ip": (r"^(?:[1-9][0-9]{0,2}\.)(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){2}$", r"^0|\.0[0-9]"),
    "card": (r"^(?!([0-9])\1*$)(?:[0-9]{14,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{2,7})$", r"^(?:[^0-9]*[0-9]){1,13}$|^([0-9])\1*$|^(?:[0-9][^0-9]?){20}"),
    "phone": (r"^\+[1-9](?!.*(?:\.\.|--|  ))[0-9 ().-]{8,20}$", r"\.\.|--|  |^\+([0-9])\1*$"),
    "local_phone": (r"^\(?[2-9]", r"^\(?[01]"),
    "spelled_email": (r"(?i)dot", None),
    "national_id": (None, r"^(?:000|666|9)|-00-|-0000$"),
    "iban": (r"^[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?$", r"^[A-Z]{2}[0-9]{2}[A-Z ]*$"),
}
FRAMED = r"^[:<(\[\"']|\n[>)\]\"';]"
GLUED = r"^[A-Za-z0-9_/=#$%&*]|\n(?:[A-Za-z0-9_/=#$%&*]|[.,-][0-9])"

LABELERS = ("form", "checksum", "gazetteer", "words", "signs")


@dataclass(frozen=True)
class Model:
    """Reliabilities by kind, and the weights of the final classifier by feature."""

    reliabilities: dict[str, dict]
    weights: dict[str, float]


# --- candidates ----------------------------------------------------------------------------------------


def _matches(text: Column, kind: str) -> Column:
    """Gaps and matches in order, the rest of the text as a last entry without a match; null without any match."""
    pattern = PATTERNS[kind]

    def entry(gap: Column, match: Column) -> Column:
        length = F.coalesce(F.length(match), F.lit(0))
        return F.struct(
            F.length(gap).cast("bigint").alias("gap"),
            (F.length(gap) + length).cast("bigint").alias("size"),
            F.right(gap, F.lit(CONTEXT)).alias("before"),
            F.left(gap, F.lit(2)).alias("head"),
            match.alias("match"),
        )

    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), entry)
    return F.when(text.rlike(pattern), pairs).alias(kind)


def running_totals(sizes: Column) -> Column:
    """Sum of all earlier entries for each entry of a stored array.

    An array is extended by copying, so totals are built inside blocks and the blocks' sums are added.
    """

    def fold(block: Column) -> Column:
        start = F.array(F.lit(0).cast("bigint"))
        return F.aggregate(block, start, lambda seen, x: F.concat(seen, F.array(F.element_at(seen, -1) + x)))

    last = F.floor((F.size(sizes) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: fold(F.slice(sizes, k * BLOCK + 1, F.lit(BLOCK))))
    starts = F.slice(fold(F.transform(blocks, lambda b: F.element_at(b, -1))), F.lit(1), last + 1)
    shifted = F.zip_with(blocks, starts, lambda b, s: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: x + s))
    return F.flatten(shifted)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def holds(kind: str, match: Column) -> Column:
    """Whether a match of a base kind passes its rule."""
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", F.when(n.between(14, 19), _digits(match)))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(kind == "email")


def _remainder_97(match: Column) -> Column:
    """Remainder of an account number whose first four signs are put last and whose letters are numbers."""
    bare = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))

    def step(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _gazetteers() -> dict[str, tuple[str | None, str | None]]:
    """Expressions of matches that a list speaks for, and against."""
    names, others, ends, countries = ("|".join(x) for x in (GIVEN_NAMES, NOT_NAMES, MAIL_ENDS, BANK_COUNTRIES))
    return {
        "email": (rf"(?i)\.(?:{ends})$", r"\.[0-9]+$"),
        "ip": (None, r"^(?:0|127|255)\."),
        "card": ("^(?:4|5[1-5]|2[2-7]|3[47]|6)", "^0"),
        "phone": (rf"^\+(?:{'|'.join(DIAL_CODES)})", r"^\+0"),
        "spelled_email": (rf"(?i)(?:\)|\]|\}}|\.|\x20)(?:{ends})$", None),
        "iban": (rf"^(?:{countries})", rf"^(?!{countries})"),
        "person": (rf"^(?:{names})\x20(?!(?:{others})$)", rf"^(?:{others})\x20|\x20(?:{others})$"),
    }


def _vote(value: Column, yes: str | None, no: str | None) -> Column:
    vote = F.lit(0)
    if no:
        vote = F.when(value.rlike(no), -1).otherwise(vote)
    return F.when(value.rlike(yes), 1).otherwise(vote) if yes else vote


def _votes(kind: str, before: Column, match: Column, behind: Column) -> list[Column]:
    """The votes of LABELERS on one candidate; a vote for comes before one against."""
    checks = {"iban": lambda: _remainder_97(match) == 1} | {k: lambda: holds(kind, match) for k in ("ip", "card", "phone")}
    reach = "[^a-z]{1,4}$" if kind == "person" else r"[^a-z]*(?:[a-z]+[^a-z]+){0,2}$"
    signs = F.concat(F.right(before, F.lit(1)), F.lit("\n"), behind)  # a line feed stands for the match
    return [
        _vote(match, *FORMS.get(kind, (None, None))),
        F.when(checks[kind](), 1).otherwise(-1) if kind in checks else F.lit(0),
        _vote(match, *_gazetteers().get(kind, (None, None))),
        _vote(F.lower(before), rf"(?:^|[^a-z])(?:{CUES[kind]}){reach}", rf"(?:^|[^a-z])(?:{AGAINST})[^a-z]{{0,6}}$"),
        _vote(signs, FRAMED, GLUED),
    ]


def _located(kind: str) -> Column:
    """The candidates of one kind, out of its stored gaps and matches."""
    pairs = F.col(f"found.{kind}")
    n = F.size(pairs) - 1
    rows = F.arrays_zip(
        F.slice(pairs, F.lit(1), n).alias("pair"),
        F.slice(running_totals(pairs["size"]), F.lit(1), n).alias("offset"),
        F.slice(pairs["head"], F.lit(2), n).alias("behind"),
    )

    def one(row: Column) -> Column:
        match, start = row["pair"]["match"], row["offset"] + row["pair"]["gap"]
        length = F.length(match)
        votes = _votes(kind, row["pair"]["before"], match, row["behind"])
        return F.struct(
            F.lit(kind).alias("kind"),
            start.alias("start"),
            (start + length).alias("end"),
            holds(kind, match).alias("base"),
            F.struct(*[v.alias(name) for name, v in zip(LABELERS, votes)]).alias("votes"),
            F.when(length < 12, 0).when(length < 20, 1).otherwise(2).alias("length"),
            F.floor(3.0 * F.length(_digits(match)) / (length + 1)).cast("int").alias("digits"),
        )

    return F.when(pairs.isNotNull(), F.transform(rows, one)).otherwise(F.array())


def candidates(docs: DataFrame, *carried: Column) -> DataFrame:
    """One row per document row: doc_id, what is carried along, and the candidates of all kinds.

    A candidate has kind, start, end, base, its votes, its length class and its share of digits. Gaps and
    matches are written first, so that later steps read them instead of matching again.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = saved(docs.select("doc_id", *carried, F.struct(*[_matches(text, k) for k in KINDS]).alias("found")))
    located = F.flatten(F.array(*[_located(k) for k in KINDS])).alias("candidates")
    return saved(found.select(*[c for c in found.columns if c != "found"], located))


# --- weak supervision ----------------------------------------------------------------------------------


def vote_counts(found: DataFrame) -> DataFrame:
    """Candidates by kind, votes, length class and share of digits: at most CELLS rows a kind."""
    told = found.select(F.inline("candidates")).select("kind", "votes.*", "length", "digits")
    return told.groupBy("kind", *LABELERS, "length", "digits").agg(F.count(F.lit(1)).alias("n"))


def reliabilities(counts: dict[tuple, int], rounds: int = EM_ROUNDS) -> dict:
    """EM over the votes of one kind: the share of personal data and how often each labeler votes what on either side.

    Labelers vote independently given the truth. The starting belief, that a labeler is right eight times
    as often as wrong, keeps the weight of EM_ANCHOR of the candidates, so the sides cannot change places.
    """
    total = sum(counts.values())
    anchor = EM_ANCHOR * total
    belief = {True: {1: 8 / 13, 0: 4 / 13, -1: 1 / 13}, False: {1: 1 / 13, 0: 4 / 13, -1: 8 / 13}}
    prior, table = 0.5, [belief] * len(LABELERS)
    for _ in range(rounds):
        sides = {True: 0.0, False: 0.0}
        sums = [{side: {v: anchor * belief[side][v] for v in (1, 0, -1)} for side in (True, False)} for _ in LABELERS]
        for votes, n in counts.items():
            p = posterior({"prior": prior, "votes": table}, votes)
            for side, share in ((True, p), (False, 1.0 - p)):
                sides[side] += share * n
                for j, v in enumerate(votes):
                    sums[j][side][v] += share * n
        prior = (sides[True] + 0.2 * anchor) / (total + anchor)
        table = [
            {side: {v: x / sum(cells.values()) for v, x in cells.items()} for side, cells in one.items()} for one in sums
        ]
    return {"prior": prior, "votes": table}


def posterior(belief: dict, votes: tuple[int, ...]) -> float:
    """Probability that a candidate with these votes is personal data."""
    log_odds = math.log(belief["prior"]) - math.log(1.0 - belief["prior"])
    for table, v in zip(belief["votes"], votes):
        log_odds += math.log(table[True][v]) - math.log(table[False][v])
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, log_odds))))


FEATURES = (
    *[f"{k}_{name}" for k in KINDS for name in ("is", *LABELERS)],  # a constant and the votes for each kind
    *[f"{form}_{value}" for form in ("length", "digits") for value in (1, 2)],
)


def _row(kind: str, votes: tuple[int, ...], length: int, digits: int) -> list[float]:
    cells = dict(zip([f"{kind}_{name}" for name in ("is", *LABELERS)], (1.0, *map(float, votes))))
    cells |= {f"length_{length}": 1.0, f"digits_{digits}": 1.0}
    return [cells.get(name, 0.0) for name in FEATURES]


def logistic(rows: np.ndarray, shares: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Coefficients of the logistic regression of shares in 0..1 on rows, by Newton steps with a small penalty."""
    found = np.zeros(rows.shape[1])
    for _ in range(NEWTON_STEPS):
        p = 1.0 / (1.0 + np.exp(-np.clip(rows @ found, -30.0, 30.0)))
        slope = rows.T @ (weights * (shares - p)) - PENALTY * found
        bend = (rows * (weights * p * (1.0 - p))[:, None]).T @ rows + PENALTY * np.eye(len(found))
        step = np.linalg.solve(bend, slope)
        found += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return found


def fit(found: DataFrame) -> Model | None:
    """Reliabilities and classifier from the counts of all candidates; None without any."""
    cells = sorted(vote_counts(found).collect(), key=tuple)  # CELLS rows a kind at most
    if not cells:
        return None
    keys = [(r["kind"], tuple(r[name] for name in LABELERS), r["length"], r["digits"]) for r in cells]
    counts: dict[str, dict[tuple, int]] = {}
    for (kind, votes, _, _), r in zip(keys, cells):
        of_kind = counts.setdefault(kind, {})
        of_kind[votes] = of_kind.get(votes, 0) + r["n"]
    beliefs = {k: reliabilities(c) for k, c in counts.items()}
    n = np.array([r["n"] for r in cells], float)
    shares = np.array([posterior(beliefs[key[0]], key[1]) for key in keys])
    weights = logistic(np.array([_row(*key) for key in keys]), shares, n / n.sum())
    return Model(beliefs, dict(zip(FEATURES, weights.tolist())))


def _score(model: Model, c: Column) -> Column:
    """The classifier on one candidate."""
    total = of_kind = F.lit(0.0)
    for k in KINDS:
        own = F.lit(model.weights[f"{k}_is"])
        for name in LABELERS:
            own = own + F.lit(model.weights[f"{k}_{name}"]) * c["votes"][name]
        of_kind = F.when(c["kind"] == k, own).otherwise(of_kind)
    for feature in ("length", "digits"):
        for value in (1, 2):
            total = total + F.when(c[feature] == value, F.lit(model.weights[f"{feature}_{value}"])).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-(total + of_kind)))


def _chosen(model: Model | None, threshold: float) -> Column:
    """spans: the base ones and those whose score reaches the threshold, ordered."""
    def scored(c: Column) -> Column:
        score = _score(model, c) if model else F.lit(0.0)
        order = F.lit(0)
        for i, k in enumerate(KINDS):
            order = F.when(c["kind"] == k, i).otherwise(order)
        return F.struct(c["start"].alias("start"), order.alias("order"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"), score.alias("score"))

    kept = F.filter(F.transform("candidates", scored), lambda c: c["base"] | (c["score"] >= threshold))
    return F.transform(
        F.sort_array(kept),
        lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), c["score"].alias("score")),
    ).alias("spans")


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: doc_id and spans (kind, start, end, base, score)."""
    found = candidates(docs)
    return found.select("doc_id", _chosen(fit(found), threshold))


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with each stretch that spans cover replaced by the kind of its first span in brackets."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = candidates(docs, row)
    told = saved(found.select("row", _chosen(fit(found), threshold)))
    text = F.col("row.text").cast("string")
    # pieces of a bounded length, each cut at the spans that reach into it
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(piece: Column, k: Column) -> Column:
        begin = k * PIECE
        stop = begin + F.length(piece)
        inside = F.filter(F.col("spans"), lambda s: (s["start"] < stop) & (s["end"] > begin))

        def step(acc: Column, s: Column) -> Column:
            kept = F.substr(piece, acc["at"] - begin + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            fresh = s["start"] >= F.greatest(acc["at"], acc["until"])
            mark = F.when(fresh & (s["start"] >= begin), F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
            end = F.greatest(acc["at"], F.least(s["end"], stop))
            return F.struct(end.cast("bigint").alias("at"), F.greatest(acc["until"], s["end"]).alias("until"), F.concat(acc["out"], kept, mark).alias("out"))

        zero = F.struct(begin.cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("until"), F.lit("").alias("out"))
        return F.aggregate(inside, zero, step, lambda acc: F.concat(acc["out"], F.substr(piece, acc["at"] - begin + 1)))

    cleaned = F.when(F.size("spans") > 0, F.array_join(F.transform(pieces, cut), "")).otherwise(text)
    return told.select(*[cleaned.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op11_digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
