"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    A column used several times inside a lambda is written out, and evaluated, once
    per use. As the variable of a one-element ``transform`` it is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
