"""Plain Python values that behave like columns, for rules that must also run inside a stream's state.

A rule is written once, on columns, with the functions it needs taken from f: pyspark.sql.functions for a plan, or this
module's PLAIN for one row's values. Nulls are None and logic has three values, as in SQL. Strings compare by code point,
which is the byte order of UTF-8.
"""

from __future__ import annotations

import datetime
import operator
from types import SimpleNamespace
from typing import Any


def either_null(f):
    return lambda a, b: None if a is None or b is None else f(a, b)


def both(a, b):
    return False if a is False or b is False else None if a is None or b is None else True


def any_of(a, b):
    return True if a is True or b is True else None if a is None or b is None else False


def bare(x):
    return x.v if isinstance(x, Plain) else x


def binary(f):
    return lambda self, other: Plain(f(self.v, bare(other)))


class Plain:
    __slots__ = ("name", "v")
    __hash__ = None  # type: ignore[assignment]

    def __init__(self, v: Any, name: str = "") -> None:
        self.v, self.name = v, name

    __eq__ = binary(either_null(operator.eq))  # type: ignore[assignment]
    __ne__ = binary(either_null(operator.ne))  # type: ignore[assignment]
    __lt__, __le__, __gt__, __ge__ = (binary(either_null(f)) for f in (operator.lt, operator.le, operator.gt, operator.ge))
    __add__, __sub__ = binary(either_null(operator.add)), binary(either_null(operator.sub))
    __and__, __or__ = binary(both), binary(any_of)

    def __invert__(self) -> "Plain":
        return Plain(None if self.v is None else not self.v)

    def __getitem__(self, name: str) -> "Plain":
        return Plain(self.v[name])

    def isNull(self) -> "Plain":
        return Plain(self.v is None)

    def isNotNull(self) -> "Plain":
        return Plain(self.v is not None)

    def isin(self, *values) -> "Plain":
        return Plain(None if self.v is None else self.v in map(bare, values))

    def alias(self, name: str) -> "Plain":
        return Plain(self.v, name)

    def cast(self, kind: str) -> "Plain":
        return self


class Choice(Plain):
    """when(..), with the values of its branches; the first whose condition holds counts."""

    __slots__ = ("open",)

    def __init__(self, condition, value) -> None:
        self.open = bare(condition) is not True
        super().__init__(None if self.open else bare(value))

    def when(self, condition, value) -> "Choice":
        return Choice(condition, value) if self.open else self

    def otherwise(self, value) -> Plain:
        return Plain(bare(value)) if self.open else self


def first_known(*values) -> Plain:
    return Plain(next((v for v in map(bare, values) if v is not None), None))


def padded(x, width, fill) -> Plain:
    x, width, fill = bare(x), bare(width), bare(fill)
    return Plain(None if x is None or width is None else x.rjust(width, fill)[:width])


def of_one(f):
    return lambda x: Plain(None if bare(x) is None else f(bare(x)))


#: SQL constants that rules name, as values.
CONSTANTS = {
    "TIMESTAMP_NTZ '0001-01-01 00:00:00'": datetime.datetime.min,
    "INTERVAL '2' MINUTE": datetime.timedelta(minutes=2),
    "CAST(NULL AS TIMESTAMP_NTZ)": None,
    "CAST(0 AS BIGINT)": 0,
    "''": "",
    "'pending'": "pending",
    "0": 0,
}

PLAIN = SimpleNamespace(
    when=Choice,
    coalesce=first_known,
    lit=Plain,
    expr=lambda text: Plain(CONSTANTS[text]),
    struct=lambda *fields: Plain({x.name: x.v for x in fields}),
    lower=of_one(str.lower),
    length=of_one(len),
    lpad=padded,
    greatest=lambda *values: Plain(max((v for v in map(bare, values) if v is not None), default=None)),
)
