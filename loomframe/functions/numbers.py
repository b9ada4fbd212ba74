"""Rounded means that do not depend on the order of summing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUDGE = 1e-9  # larger than summing errors, smaller than any step that is kept


def mean(c: str | Column, digits: int) -> Column:
    """Average rounded half up; the nudge lets exact halves round alike however their sum was taken."""
    return F.round(F.avg(c) + NUDGE, digits)
