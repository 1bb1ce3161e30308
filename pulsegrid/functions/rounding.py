"""rounding of reported numbers.

Values are computed unrounded and rounded only in output projections, HALF_UP
(deviation D4).  Before that, noise beyond the 9th decimal is cleared, so that
summation order (a mean that is exactly x.xx5 arriving as x.xx4999999999)
cannot flip the last digit; a value that differs from a tie by more than float
noise is rounded once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLEAN_DIGITS = 9


def half_up(col, digits: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    cleaned = F.round(c, CLEAN_DIGITS)
    return cleaned if digits >= CLEAN_DIGITS else F.round(cleaned, digits)
