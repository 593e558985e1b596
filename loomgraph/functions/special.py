"""Upper tails of the gamma and normal distributions, as column expressions and in numpy."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients (g = 7, nine terms).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma_plus_one(a: Column) -> Column:
    """log Gamma(a + 1) for a > 0."""
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (a + i)
    t = a + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (a + 0.5) * F.log(t) - t + F.log(total)


def gamma_upper(a: Column, x: Column, terms: int = 600) -> Column:
    """Q(a, x), the regularised upper incomplete gamma function, by its power series (absolute error about 1e-15)."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda acc, k: F.struct((acc["t"] * x / (a + k)).alias("t"), (acc["s"] + acc["t"] * x / (a + k)).alias("s")),
        lambda acc: acc["s"],
    )
    # So far out that the tail is below the absolute error, and the series would need more terms.
    beyond = (x > 300) & (x > 1.5 * a + 200)
    lower = F.exp(-x + a * F.log(x) - lgamma_plus_one(a)) * series
    return F.when(x <= 0, F.lit(1.0)).when(beyond, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - lower)))


def gammaincc(a: float, x: float) -> float:
    """Q(a, x) with relative precision in the tail (series below a + 1, continued fraction above)."""
    if not (a > 0 and math.isfinite(a) and math.isfinite(x)):
        return math.nan
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(100_000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-17:
                break
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c = 1 / tiny
    d = 1 / b if b else 1 / tiny
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_two_sided_col(z: Column) -> Column:
    """P(|N(0,1)| > |z|) = Q(1/2, z^2 / 2)."""
    return gamma_upper(F.lit(0.5), z * z / 2)
