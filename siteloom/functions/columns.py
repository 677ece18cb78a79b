"""Column helpers that are about no data type in particular."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often it is used.

    Matters inside loops over arrays: the optimizer puts a column that is used in one place right
    there, and in a loop that place is reached for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
