"""Closed formulas for detector quality; a rate over nothing is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv


def rate(k: Column, n: Column) -> Column:
    return F.try_divide(k, n)


def wilson_bounds(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson score interval at 95 %."""
    z = fv.WILSON_Z
    p = F.try_divide(k, n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = p + F.try_divide(F.lit(z * z), 2 * n)
    reach = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    return F.try_divide(centre - reach, scale), F.try_divide(centre + reach, scale)


def wilson_ci(k: Column, n: Column) -> Column:
    lo, hi = wilson_bounds(k, n)
    return F.when(n > 0, F.struct(lo.alias("lo"), hi.alias("hi")))


def rate_text(k: Column, n: Column) -> Column:
    """``85% (17/20; CI 64-95%)`` or ``n/a``."""
    lo, hi = wilson_bounds(k, n)
    whole = lambda x: F.call_function("format_number", x * 100, F.lit("0"))
    text = F.concat(
        whole(rate(k, n)), F.lit("% ("), k.cast("string"), F.lit("/"), n.cast("string"),
        F.lit("; CI "), whole(lo), F.lit("-"), whole(hi), F.lit("%)"),
    )
    return F.when(n > 0, text).otherwise(F.lit("n/a"))
