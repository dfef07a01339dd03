"""Column formulas shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TRADING_DAYS = 252


def dbl(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def ratio(num: Column | str, den: Column | str) -> Column:
    """Double division, NULL where the denominator is zero or NULL."""
    return F.try_divide(dbl(num), dbl(den))


def simple_return(now: Column | str, before: Column | str) -> Column:
    return ratio(now, before) - 1.0


def gain_loss_pct(market_value: Column, cost: Column, *, on_market_value: bool = False) -> Column:
    """Gain in percent of cost, or of market value with ``on_market_value``."""
    if on_market_value:
        return (1.0 - ratio(cost, market_value)) * 100.0
    return (ratio(market_value, cost) - 1.0) * 100.0


def annualised(gain_pct: Column, days: Column | str) -> Column:
    return gain_pct * ratio(F.lit(365.0), days)


def ordered_case(*branches: tuple[Column, object], otherwise: object = None) -> Column:
    """CASE with branches tried in the given order."""
    (first_cond, first_value), *rest = branches
    out = F.when(first_cond, first_value)
    for cond, value in rest:
        out = out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def pick(values: list, n: Column) -> Column:
    """Value number ``n`` modulo the list length; negative ``n`` wraps too."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def rounded_ratio(num: Column | str, den: Column | str, digits: int) -> Column:
    """num / den rounded half away from zero; exact at ties while num and den are whole numbers below 2**53."""
    scale = float(10 ** digits)
    return F.round(ratio(dbl(num) * scale, den)) / scale
