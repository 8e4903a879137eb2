"""Scalar column expressions for dates, scores and log-likelihood terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cost used for a log-likelihood that is not finite.
WORST_LL = -1.7976931348623157e308

# Lanczos approximation of the gamma function, g = 7, nine terms.
LANCZOS_G = 7.0
LANCZOS = [
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
]
LOG_SQRT_2PI = 0.9189385332046727


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def day_offset(date: Column | str, start: Column | str) -> Column:
    """One-based day number of ``date`` counted from ``start``."""
    return F.datediff(col(date), col(start)) + 1


def day_calendar(start: Column | str, end: Column | str, future: int = 0) -> Column:
    """Array of all days from ``start`` to ``end`` plus ``future`` days."""
    return F.sequence(col(start), F.date_add(col(end), future))


def iso(date: Column | str) -> Column:
    return F.date_format(col(date), "yyyy-MM-dd")


def floor3(x: Column | str) -> Column:
    """Cut (not round) to three decimals."""
    return F.floor(col(x) * 1000) / 1000


def interval_label(lb: Column | str, ub: Column | str) -> Column:
    """``lb—ub`` with three decimals each, NULL if an end is missing."""
    lb, ub = col(lb), col(ub)
    return F.when(lb.isNotNull() & ub.isNotNull(), F.format_string("%.3f—%.3f", lb, ub))


def aic(ll: Column | str, num_pars: Column | str) -> Column:
    return -2.0 * col(ll) + 2.0 * col(num_pars)


def coarsening_bound(aic_col: Column | str, blocks: Column | str) -> Column:
    """Lowest AIC any coarsening can reach: each of ``blocks`` merges saves one parameter."""
    return col(aic_col) - 2.0 * col(blocks)


def num_parameters(blocks, subjects, time_scale: bool = False, dirichlet: bool = False) -> Column:
    """Free parameters: one rate per block, one start share per subject, optional extras."""
    n = col(blocks) + col(subjects)
    if time_scale:
        n = n + col(subjects)
    if dirichlet:
        n = n + F.lit(1)
    return n.cast("bigint")


def finite_ll(ll: Column | str) -> Column:
    """Replace a NULL, NaN or infinite log-likelihood by the worst finite value."""
    inf = F.lit(float("inf"))
    return let(
        col(ll),
        lambda x: F.when(
            x.isNull() | F.isnan(x) | (x == inf) | (x == -inf), F.lit(WORST_LL)
        ).otherwise(x),
    )


def log_gamma(x: Column | str) -> Column:
    """ln Γ(x) for x > 0, evaluated at x + 1 so that small x keep their accuracy."""
    x = col(x).cast("double")
    series = F.lit(LANCZOS[0])
    for i, coef in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(coef) / (x + float(i))
    t = x + (LANCZOS_G + 0.5)
    return F.lit(LOG_SQRT_2PI) + (x + 0.5) * F.ln(t) - t + F.ln(series) - F.ln(x)


def digamma(x: Column | str) -> Column:
    """Derivative of ln Γ(x) for x > 0: eight steps up, then the asymptotic series."""

    def series(y: Column) -> Column:
        r = 1 / (y * y)
        return F.ln(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))

    def steps(y: Column) -> Column:
        below = F.lit(0.0)
        for i in range(8):
            below = below + 1 / (y + float(i))
        return let(y + 8.0, series) - below

    return let(col(x).cast("double"), steps)


def log_factorial(n: Column | str) -> Column:
    """ln n!, with the exact 0 for n = 0 and n = 1."""
    n = col(n).cast("double")
    return F.when(n < 2, F.lit(0.0)).otherwise(log_gamma(n + 1.0))


def multinomial_term(n: Column | str, p: Column | str) -> Column:
    """n ln p; 0 for n = 0 and NULL (impossible) for a count on a zero probability."""
    n, p = col(n), col(p)
    return F.when(n == 0, F.lit(0.0)).when(p > 0, n * F.ln(p))


def dirichlet_term(n: Column | str, a: Column | str) -> Column:
    """ln Γ(n+a) - ln Γ(a) - ln n! for one category with a > 0."""
    n, a = col(n), col(a)
    return F.when(n == 0, F.lit(0.0)).otherwise(log_gamma(n + a) - log_gamma(a) - log_factorial(n))


def dirichlet_head(total: Column | str, alpha: Column | str) -> Column:
    """ln N! + ln Γ(A) - ln Γ(N+A) for one bin."""
    total, alpha = col(total), col(alpha)
    return log_factorial(total) + log_gamma(alpha) - log_gamma(total + alpha)
