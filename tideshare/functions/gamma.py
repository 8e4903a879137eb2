"""Discretised gamma weights and the quantiles that go with them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideshare.functions.numbers import array_sum, col, let, log_gamma

# Default shape, scale, and the tail the truncation keeps.
DEFAULT_ALPHA = 2.03
DEFAULT_THETA = 2.32
TRUNCATION = 0.99


def gamma_cdf_value(x: float, alpha: float, theta: float = 1.0) -> float:
    """Driver-side scalar CDF, used for run options only."""
    z = x / theta
    if z <= 0:
        return 0.0
    if z > 100 + 2 * alpha:
        return 1.0
    term = total = 1.0
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= z / (alpha + n)
        total += term
    return min(1.0, math.exp(alpha * math.log(z) - z - math.lgamma(alpha + 1)) * total)


def truncation_length(alpha: float, theta: float) -> int:
    """Smallest whole day that holds 99 % of the generation time."""
    m = 1
    while gamma_cdf_value(m, alpha, theta) < TRUNCATION:
        m += 1
    return m


def weights_value(alpha: float, theta: float, length: int | None = None, division: int = 1,
                  c: float = 1.0) -> list[float]:
    """Driver-side weights for one scalar time scale; lag m is m / division days."""
    length = truncation_length(alpha, theta) if length is None else length
    cdf = [gamma_cdf_value(m / division, alpha, c * theta) for m in range(length * division + 1)]
    return [(b - a) / cdf[-1] for a, b in zip(cdf, cdf[1:])]


def chi2_quantile(df: int, p: float = 0.95) -> float:
    """Chi-square quantile by bisection on the gamma CDF."""
    lo, hi = 0.0, 1.0
    while gamma_cdf_value(hi, df / 2, 2.0) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_cdf_value(mid, df / 2, 2.0) < p else (lo, mid)
    return (lo + hi) / 2


def chi2_quantile_column(df: Column | str, p: float = 0.95) -> Column:
    """The same inside a row, for a column of whole degrees of freedom: halving below a bound of the tail."""
    half = col(df).cast("double") / 2
    beyond = col(df) + 2 * F.sqrt(col(df) * math.log(1 / (1 - p))) + 2 * math.log(1 / (1 - p))

    def below(x: Column) -> Column:
        reach = x / 2
        total = F.aggregate(
            F.sequence(F.lit(1), F.ceil(reach + 12 * F.sqrt(reach) + 60).cast("int")),
            F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
            lambda acc, n: let(
                acc["term"] * reach / (n + half),
                lambda t: F.struct(t.alias("term"), (acc["total"] + t).alias("total")),
            ),
            lambda acc: acc["total"],
        )
        return F.exp(F.ln(reach) * half - reach - log_gamma(half + 1.0)) * total < p

    def halve(s: Column, _: Column) -> Column:
        return let((s["lo"] + s["hi"]) / 2, lambda m: F.when(below(m), F.struct(m.alias("lo"), s["hi"].alias("hi")))
                   .otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(0.0).alias("lo"), beyond.alias("hi")), halve,
                       lambda s: (s["lo"] + s["hi"]) / 2)


def gamma_cdf(x: Column | str, alpha: float, theta: Column | str | float) -> Column:
    """Regularised lower incomplete gamma function as a fold over the power series.

    Terms fall from n = z - alpha on; twelve square roots of z later they no longer count.
    """
    theta = F.lit(theta) if isinstance(theta, (int, float)) else col(theta)

    def series(z: Column) -> Column:
        reach = F.greatest(F.lit(1.0), F.least(z, F.lit(100 + 2 * alpha)))
        total = F.aggregate(
            F.sequence(F.lit(1), F.ceil(reach + 12 * F.sqrt(reach) + 60).cast("int")),
            F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
            lambda acc, n: let(
                acc["term"] * z / (n + alpha),
                lambda t: F.struct(t.alias("term"), (acc["total"] + t).alias("total")),
            ),
            lambda acc: acc["total"],
        )
        head = F.exp(F.ln(z) * alpha - z - math.lgamma(alpha + 1))
        return (
            F.when(z <= 0, F.lit(0.0))
            .when(z > 100 + 2 * alpha, F.lit(1.0))
            .otherwise(F.least(F.lit(1.0), head * total))
        )

    return let(col(x) / theta, series)


def gamma_weights(alpha: float, theta: float, c: Column | str, length: int, division: int = 1) -> Column:
    """``array<double>`` of weights per lag for a time-scale ratio column ``c``."""
    c = col(c)
    steps = F.sequence(F.lit(0), F.lit(length * division))
    cdf = F.transform(steps, lambda m: gamma_cdf(m / F.lit(float(division)), alpha, c * theta))
    return let(
        cdf,
        lambda v: F.transform(
            F.sequence(F.lit(1), F.lit(length * division)),
            lambda m: (F.element_at(v, m + 1) - F.element_at(v, m)) / F.element_at(v, -1),
        ),
    )


def truncation_days(alpha: float, theta: Column | str) -> Column:
    """Smallest whole day m with CDF(m) >= 99 %.

    No quantile of 99 % lies more than the square root of 99 standard deviations above the mean, so the
    days up to there hold it, whatever the scale.
    """
    theta = col(theta)
    last = F.greatest(F.lit(1), F.ceil(theta * (alpha + math.sqrt(99 * alpha))).cast("int"))
    return F.try_element_at(
        F.filter(F.sequence(F.lit(1), last), lambda m: gamma_cdf(m.cast("double"), alpha, theta) >= TRUNCATION),
        F.lit(1),
    )


def normalised(a: Column | str) -> Column:
    """x / sum(x) inside an array."""
    a = col(a)
    return let(array_sum(a), lambda s: F.transform(a, lambda x: x / s))
