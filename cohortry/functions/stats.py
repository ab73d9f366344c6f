"""Proportions, intervals and odds ratios as column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def proportion(part: Column, whole: Column) -> Column:
    """``part / whole`` as double; NULL for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return proportion(part, whole) * F.lit(100.0)


def wald_margin(p: Column, n: Column, level: float = 0.95) -> Column:
    """Signed Wald margin ``z((1-level)/2) * sqrt(p(1-p)/n)``.

    The lower-tail quantile is negative, so the lower bound is ``p + margin``
    and the upper bound is ``p - margin``.
    """
    z = normal_quantile((1 - level) / 2)
    return F.lit(z) * F.sqrt(F.try_divide(p * (F.lit(1.0) - p), n.cast("double")))


def wald_bounds(p: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    margin = wald_margin(p, n, level)
    return p + margin, p - margin


def log_odds_bounds(log_odds: Column, error: Column, level: float = 0.95) -> tuple[Column, Column, Column]:
    """``(odds ratio, low, high)`` from a log odds ratio and its standard error."""
    reach = F.lit(normal_quantile(1 - (1 - level) / 2)) * error
    return F.exp(log_odds), F.exp(log_odds - reach), F.exp(log_odds + reach)


def two_by_two(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """``(log odds ratio, standard error)`` of a 2x2 table; NULL when a cell is empty.

    ``a``/``b`` are exposed with/without the outcome, ``c``/``d`` unexposed.
    """
    cells = [x.cast("double") for x in (a, b, c, d)]
    filled = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    ratio = F.try_divide(cells[0] * cells[3], cells[1] * cells[2])
    spread = sum((F.try_divide(F.lit(1.0), x) for x in cells[1:]), F.try_divide(F.lit(1.0), cells[0]))
    return F.when(filled, F.ln(ratio)), F.when(filled, F.sqrt(spread))


def one_decimal(value: Column) -> Column:
    """One-decimal text of the exact binary value, ties to the even digit.

    The nearest tenth cannot be read off ``value * 10``, which is rounded itself:
    21.95 is stored slightly below 21.95 and belongs to 21.9. The value is split
    into two halves whose products with 20 are exact, which gives the exact sign
    of its distance to the middle between two tenths.
    """
    spread = value * F.lit(134217729.0)  # 2**27 + 1
    upper = spread - (spread - value)
    lower = value - upper
    tenths = F.floor(value * F.lit(10.0))
    past_middle = (upper * F.lit(20.0) - (tenths * 2 + 1).cast("double")) + lower * F.lit(20.0)
    odd = F.pmod(tenths, F.lit(2)) == 1
    rounded = tenths + ((past_middle > 0) | ((past_middle == 0) & odd)).cast("int")
    return F.format_string("%.1f", rounded / F.lit(10.0))
