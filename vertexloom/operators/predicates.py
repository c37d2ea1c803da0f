"""Predicates on property values; a property holds several values and any of them may match."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = str | int | float | dt.datetime | dt.date


@dataclass(frozen=True)
class P:
    """A test on one value, made by the class methods below."""

    test: Callable[[Column], Column]

    def __call__(self, value: Column) -> Column:
        return self.test(value)

    @staticmethod
    def eq(x: Value) -> P:
        return P(lambda c: _typed(c, x) == F.lit(x))

    @staticmethod
    def neq(x: Value) -> P:
        return P(lambda c: _typed(c, x) != F.lit(x))

    @staticmethod
    def gt(x: Value) -> P:
        return P(lambda c: _typed(c, x) > F.lit(x))

    @staticmethod
    def gte(x: Value) -> P:
        return P(lambda c: _typed(c, x) >= F.lit(x))

    @staticmethod
    def lt(x: Value) -> P:
        return P(lambda c: _typed(c, x) < F.lit(x))

    @staticmethod
    def lte(x: Value) -> P:
        return P(lambda c: _typed(c, x) <= F.lit(x))

    @staticmethod
    def between(low: Value, high: Value) -> P:
        """Both ends included."""
        return P(lambda c: _typed(c, low).between(F.lit(low), F.lit(high)))

    @staticmethod
    def within(*values: Value | list[Value]) -> P:
        """One of the values, given as arguments or as one list."""
        flat = list(values[0]) if len(values) == 1 and isinstance(values[0], list | tuple | set) else list(values)
        return P(lambda c: reduce(lambda a, b: a | b, [_typed(c, x) == F.lit(x) for x in flat], F.lit(False)))

    in_ = within

    @staticmethod
    def like(pattern: str) -> P:
        return P(lambda c: c.like(pattern))

    @staticmethod
    def or_(*tests: P) -> P:
        return P(lambda c: reduce(lambda a, b: a | b, [t(c) for t in tests]))

    @staticmethod
    def and_(*tests: P) -> P:
        return P(lambda c: reduce(lambda a, b: a & b, [t(c) for t in tests]))


def _typed(value: Column, literal: Value) -> Column:
    """Compare as the literal's type: numbers as numbers, times as times; what does not parse is null."""
    if isinstance(literal, dt.datetime):
        return value.try_cast("timestamp_ntz")
    if isinstance(literal, dt.date):
        return value.try_cast("date")
    return value if isinstance(literal, str) else value.try_cast("double")


def matches(test: P | Value) -> P:
    return test if isinstance(test, P) else P.eq(test)


def property_matches(column: str, key: str, test: P | Value) -> Column:
    """Whether any value of a property passes; a missing property does not, not even ``neq``."""
    values = F.try_element_at(F.col(column), F.lit(key))
    return F.coalesce(F.exists(values, lambda v: F.coalesce(matches(test)(v), F.lit(False))), F.lit(False))
