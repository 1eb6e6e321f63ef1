"""Fill-in-the-middle: texts cut at two token boundaries and rearranged around sentinels.

Tokens are runs of A-Z and a-z, and single code points otherwise. Boundary k is the code point offset
behind the first k tokens. All boundaries of a text are held in a piecewise-linear rank index: segments
(first rank, its offset, slope) that miss no boundary by more than ERROR, fitted greedily over a
shrinking range of slopes, and one byte per boundary with what its prediction misses. A cut is the
prediction of its segment corrected by that residual, which is exact.

Where the cuts fall, which form is used and whether a text stays plain follow from sha256 of the seed and
doc_id alone, so reruns and retries agree. Texts are handled row by row, whole, without a shuffle; memory
is bounded by the longest text.

Defined results. A null text is empty; an empty text stays plain. A null doc_id is hashed as the empty
string. Repeated rows give equal rows. Texts that hold a sentinel stay plain, so restore() is exact for
every row. Extra columns are ignored by infill and kept by rearrange.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = 60  # the most a segment may miss, so that residuals fit a signed byte
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100: texts left plain, and the rest put suffix first
INFILL = (
    "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string, "
    "segments: int, index_bytes: bigint>"
)


def boundaries(text: str) -> np.ndarray:
    """Code point offsets of all token boundaries, 0 and the length included."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(1, np.int64)
    lower = points | 0x20
    letter = (lower >= 0x61) & (lower <= 0x7A) & (points < 0x80)
    inside = letter[1:] & letter[:-1]
    return np.concatenate([[0], np.flatnonzero(~inside) + 1, [len(points)]]).astype(np.int64)


@dataclass
class RankIndex:
    """rank -> value of a non-decreasing integer array: segments, and the residual of every rank."""

    first: np.ndarray  # first rank of each segment
    base: np.ndarray  # the value there
    slope: np.ndarray
    residual: np.ndarray  # int8

    @classmethod
    def fit(cls, values: np.ndarray, error: int = ERROR) -> RankIndex:
        first, slopes, at, n = [], [], 0, len(values)
        while at < n:
            end, slope = _segment(values, at, error)
            first.append(at)
            slopes.append(slope)
            at = end
        starts = np.array(first, np.int64)
        index = cls(starts, values[starts], np.array(slopes, np.float64), np.zeros(0, np.int8))
        index.residual = (values - index.predict(np.arange(n))).astype(np.int8)
        return index

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[k] + np.rint(self.slope[k] * (ranks - self.first[k])).astype(np.int64)

    def lookup(self, rank: int) -> int:
        """The exact value: prediction plus residual."""
        return int(self.predict(np.array([rank]))[0]) + int(self.residual[rank])

    @property
    def nbytes(self) -> int:
        return self.first.nbytes + self.base.nbytes + self.slope.nbytes + self.residual.nbytes


def _segment(values: np.ndarray, at: int, error: int) -> tuple[int, float]:
    """(end, slope) of the longest segment from `at` on that some slope serves within the error.

    Every further value narrows the range of slopes; ranges are read in growing pieces, so the work is
    in proportion to the segment.
    """
    low, high, begin, size, n = -np.inf, np.inf, at + 1, 64, len(values)
    while begin < n:
        end = min(begin + size, n)
        step = np.arange(begin - at, end - at, dtype=np.float64)
        rise = (values[begin:end] - values[at]).astype(np.float64)
        lows = np.maximum(np.maximum.accumulate((rise - error) / step), low)
        highs = np.minimum(np.minimum.accumulate((rise + error) / step), high)
        crossed = lows > highs
        if crossed.any():
            stop = int(crossed.argmax())
            if stop:
                low, high = lows[stop - 1], highs[stop - 1]
            end, begin = begin + stop, n
        else:
            low, high, begin, size = lows[-1], highs[-1], end, size * 2
    if at + 1 >= n or not np.isfinite(low):
        return at + 1, 0.0
    return end, (low + high) / 2


def draws(doc_id: str, seed: int = SEED) -> tuple[int, int, int, int]:
    """The first four groups of eight digits of sha256, as unsigned integers."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


@dataclass
class Cut:
    n: int
    form: str
    prefix: int | None  # code points
    middle: int | None
    output: str
    index: RankIndex


def cut(text: str, doc_id: str, seed: int = SEED) -> Cut:
    """One text rearranged; the cuts are looked up in its rank index."""
    index = RankIndex.fit(boundaries(text))
    n = len(index.residual) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return Cut(n, "plain", None, None, text, index)
    a, b = (index.lookup(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return Cut(n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", index)
    return Cut(n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", index)


def restored(output: Column, form: Column) -> Column:
    """The exact text out of output and form.

    The output opens with a sentinel and holds each other sentinel once, because a text with a sentinel
    stays plain and no sentinel can begin inside another.
    """
    body = F.substr(output, F.lit(4))
    middle = F.substring_index(body, MIDDLE, -1)
    rest = F.substring_index(body, MIDDLE, 1)

    def part(second: str, side: int) -> Column:
        return F.substring_index(rest, second, side)

    psm = F.concat(part(SUFFIX, 1), middle, part(SUFFIX, -1))
    spm = F.concat(part(PREFIX, -1), middle, part(PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def _cuts(seed: int) -> Column:
    def udf(ids: pa.Array, texts: pa.Array) -> pa.Array:
        found = [cut(t or "", i or "", seed) for i, t in zip(ids.to_pylist(), texts.to_pylist())]
        cells = {
            "n": pa.array([c.n for c in found], pa.int64()),
            "form": pa.array([c.form for c in found], pa.string()),
            "prefix_chars": pa.array([c.prefix for c in found], pa.int64()),
            "middle_chars": pa.array([c.middle for c in found], pa.int64()),
            "output": pa.array([c.output for c in found], pa.string()),
            "segments": pa.array([len(c.index.first) for c in found], pa.int32()),
            "index_bytes": pa.array([c.index.nbytes for c in found], pa.int64()),
        }
        return pa.StructArray.from_arrays(list(cells.values()), names=list(cells))

    return F.arrow_udf(udf, INFILL)(F.col("doc_id").cast("string"), F.col("text").cast("string"))


def infill(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document row: doc_id, n, form, prefix_chars, middle_chars, output, segments, index_bytes."""
    return docs.select("doc_id", _cuts(seed).alias("cut")).select("doc_id", "cut.*")


def rearrange(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with the rearranged text, null texts as they are."""
    output = F.when(F.col("text").isNotNull(), _cuts(seed)["output"])
    return docs.select(*[output.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def rank_index(docs: DataFrame, error: int = ERROR) -> DataFrame:
    """The index itself: doc_id, segments (first, base, slope) and the residuals, one signed byte a boundary."""
    kind = "struct<segments: array<struct<first: bigint, base: bigint, slope: double>>, residuals: binary>"
    if not 0 < error <= ERROR:
        raise ValueError(f"error must lie between 1 and {ERROR}")

    def udf(texts: pa.Array) -> pa.Array:
        fits = [RankIndex.fit(boundaries(t or ""), error) for t in texts.to_pylist()]
        segments = [
            [{"first": f, "base": b, "slope": s} for f, b, s in zip(x.first.tolist(), x.base.tolist(), x.slope.tolist())]
            for x in fits
        ]
        shape = pa.list_(pa.struct([("first", pa.int64()), ("base", pa.int64()), ("slope", pa.float64())]))
        residuals = pa.array([x.residual.tobytes() for x in fits], pa.binary())
        return pa.StructArray.from_arrays([pa.array(segments, shape), residuals], names=["segments", "residuals"])

    fitted = F.arrow_udf(udf, kind)(F.col("text").cast("string"))
    return docs.select("doc_id", fitted.alias("index")).select("doc_id", "index.*")


def op13_digest(cuts: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    exact = restored(F.col("output"), F.col("form"))
    return cuts.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(exact, 256).alias("restored_sha256"),
    )
