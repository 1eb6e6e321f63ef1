"""Normal quantiles and Student-t tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Wichura's published rational approximation (algorithm AS 241).
CENTRAL_NUM = [
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
    1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
    3.3430575583588128105e4, 2.5090809287301226727e3,
]
CENTRAL_DEN = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
    5.2264952788528545610e3,
]
MIDDLE_NUM = [
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
    3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
    2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
MIDDLE_DEN = [
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
    1.05075007164441684324e-9,
]
FAR_NUM = [
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
    2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
    2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
FAR_DEN = [
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
    2.04426310338993978564e-15,
]


def _ratio(x: Column, num: list[float], den: list[float]) -> Column:
    def horner(coefficients: list[float]) -> Column:
        acc = F.lit(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            acc = acc * x + F.lit(c)
        return acc

    return horner(num) / horner(den)


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile for 0 < p < 1."""
    q = p - F.lit(0.5)
    central = q * _ratio(F.lit(0.180625) - q * q, CENTRAL_NUM, CENTRAL_DEN)
    r = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p)))
    middle = _ratio(r - F.lit(1.6), MIDDLE_NUM, MIDDLE_DEN)
    far = _ratio(r - F.lit(5.0), FAR_NUM, FAR_DEN)
    tail = F.signum(q) * F.when(r <= 5.0, middle).otherwise(far)
    return F.when(F.abs(q) <= 0.425, central).otherwise(tail)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def t_two_sided(stat: float, df: float) -> float:
    """Two-sided tail probability of Student's t, for single values; t_tail is the column form."""
    if stat is None or df is None or math.isnan(stat) or df <= 0:
        return math.nan
    ratio = stat * stat / df
    x, rest = 1.0 / (1.0 + ratio), ratio / (1.0 + ratio)
    if rest <= 0.0:
        return 1.0
    a, b = df / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - a * math.log1p(ratio)) * math.sqrt(rest)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, rest) / b


GAMMA_SHIFT = 20  # the series of the gamma ratio starts this far out
# The asymptotic series of gamma(a + 1/2) / (gamma(a) sqrt(a)) in powers of 1 / a
GAMMA_RATIO = [1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304, 39325 / 33554432]


def _half_gamma_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a) for a > 0: the series at a + GAMMA_SHIFT, brought back by the recurrence."""
    far = a + F.lit(float(GAMMA_SHIFT))
    series = F.lit(GAMMA_RATIO[-1])
    for c in reversed(GAMMA_RATIO[:-1]):
        series = series / far + F.lit(c)
    back = F.lit(1.0)
    for i in range(GAMMA_SHIFT):
        back = back * (a + F.lit(float(i))) / (a + F.lit(i + 0.5))
    return F.sqrt(far) * series * back


def _beta_steps(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function as a fold over a sequence of terms.

    On this side of the transition it settles within a few times sqrt(max(a, b)) terms, which is the length taken.
    """

    def away(v: Column) -> Column:
        return F.when(F.abs(v) > 1e-300, v).otherwise(1e-300)

    def step(acc: Column, k: Column) -> Column:
        p, q, z, m = acc["a"], acc["b"], acc["x"], F.floor((k + 1) / 2).cast("double")
        even = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        odd = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        term = F.when(k % 2 == 1, odd).otherwise(even)
        d = 1.0 / away(1.0 + term * acc["d"])
        c = away(1.0 + term / acc["c"])
        return F.struct(p.alias("a"), q.alias("b"), z.alias("x"), c.alias("c"), d.alias("d"), (acc["value"] * c * d).alias("value"))

    first = 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(a.alias("a"), b.alias("b"), x.alias("x"), F.lit(1.0).alias("c"), first.alias("d"), first.alias("value"))
    terms = F.least(F.lit(60.0) + 8.0 * F.sqrt(F.greatest(a, b)), F.lit(500_000.0)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda acc: acc["value"])


def t_tail(stat: Column, df: Column) -> Column:
    """Two-sided tail probability of Student's t as a column expression; nan without a statistic or degrees of freedom."""
    t2, a, b = stat * stat, df / 2.0, F.lit(0.5)
    ratio = t2 / df
    x, rest = 1.0 / (1.0 + ratio), ratio / (1.0 + ratio)
    # x**a * (1 - x)**(1/2) / beta(a, 1/2)
    front = F.exp(-a * F.log1p(ratio)) * F.sqrt(rest) * _half_gamma_ratio(a) / F.lit(math.sqrt(math.pi))
    lower = front * _beta_steps(a, b, x) / a
    upper = 1.0 - front * _beta_steps(b, a, rest) / b
    p = F.when(rest <= 0.0, 1.0).when(x < (a + 1.0) / (a + b + 2.0), lower).otherwise(upper)
    known = stat.isNotNull() & df.isNotNull() & ~F.isnan(stat) & (df > 0)
    return F.when(known, F.when(F.abs(stat) == float("inf"), 0.0).otherwise(p)).otherwise(float("nan"))
