"""Scalar expressions used across operators.

All are compositions of built-in Spark SQL functions, so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faretrail.schema import MONTH_NAMES, WEEKDAY_NAMES


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def minutes_between(start, end) -> Column:
    """Fractional minutes from ``start`` to ``end`` (null if either is null).

    Microsecond difference divided by 6e7, so equal inputs give bit-identical
    doubles in any engine that does the same integer/double division.
    """
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(6e7)


def round2(c) -> Column:
    """Round a non-negative double to 2 decimals, halves up.

    Written as ``floor(x*100 + 0.5) / 100`` so that every engine evaluating the
    same IEEE operations agrees bit for bit (decimal-based rounding and
    multiply-then-round can differ in the last place).
    """
    return F.floor(_col(c) * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def exact_sum(c, scale: int = 10) -> Column:
    """Sum of a double column computed exactly in decimal, returned as double.

    Money amounts are summed in ``decimal(38, scale)`` so the result does not
    depend on partitioning or summation order (a double sum does).
    """
    return F.sum(_col(c).cast(f"decimal(38,{scale})")).cast("double")


def paste(*cols) -> Column:
    """Space-join values, writing null as the literal ``NA``."""
    return F.concat_ws(" ", *[F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols])


def month_label(c) -> Column:
    """1..12 to the month name, anything else to ``'ERROR'``."""
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    m = _col(c)
    return F.when((m >= 1) & (m <= 12), F.element_at(names, m.cast("int"))).otherwise(F.lit("ERROR"))


def weekday_name(c) -> Column:
    """1..7 (1 = Sunday) to the weekday name, null otherwise."""
    names = F.array(*[F.lit(d) for d in WEEKDAY_NAMES])
    d = _col(c)
    return F.when((d >= 1) & (d <= 7), F.element_at(names, d.cast("int")))
