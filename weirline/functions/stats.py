"""Ratio and average helpers with one rounding rule, shared by every analysis.

* percentages: ``round(double(num) * 100 / den, 2)``, NULL when ``den`` is 0
  (ANSI mode would raise on a zero divisor);
* averages of decimals: ``round(double(sum(x)) / count(x), n)`` so the sum is
  exact and the result does not depend on the order of the partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct(num, den, digits: int = 2) -> Column:
    return F.round(F.try_divide(_col(num).cast("double") * 100.0, _col(den).cast("double")), digits)


def exact_avg(x, digits: int = 2) -> Column:
    """Aggregate: rounded average with an exact (decimal) sum."""
    x = _col(x)
    return F.round(F.try_divide(F.sum(x).cast("double"), F.count(x).cast("double")), digits)


def round_dbl(agg: Column, digits: int = 2) -> Column:
    """Round an aggregate of decimals and return it as double."""
    return F.round(agg, digits).cast("double")


def count_true(c) -> Column:
    """``COUNT(CASE WHEN c = true THEN 1 END)``."""
    return F.count_if(_col(c) == F.lit(True))
