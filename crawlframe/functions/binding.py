"""Bind a sub-expression once inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Higher-order functions get no common-subexpression elimination, so an
    expensive operand used several times is bound to a lambda variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
