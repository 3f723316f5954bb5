"""Metadata predicates: a small tree of conditions turned into one column.

A row without a field satisfies no condition on it; ``Not`` is true negation, so it keeps such rows.
Numbers are compared as doubles; texts that are no numbers satisfy no range. Conditions on typed columns stay
plain comparisons, so that they reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import guarded_join

#: Ids beyond this are joined instead of listed in the predicate.
LISTED_IDS = 1_000


class Filter:
    def __and__(self, other: Filter) -> Filter:
        return And((self, other))

    def __or__(self, other: Filter) -> Filter:
        return Or((self, other))

    def __invert__(self) -> Filter:
        return Not(self)


@dataclass(frozen=True)
class Eq(Filter):
    field: str
    value: str


@dataclass(frozen=True)
class In(Filter):
    field: str
    values: Sequence[str]


@dataclass(frozen=True)
class Compare(Filter):
    """A numeric comparison: gt, gte, lt, lte or eq."""

    field: str
    op: str
    value: float


@dataclass(frozen=True)
class Range(Filter):
    """Bounds included, or left out with ``exclusive``."""

    field: str
    low: float
    high: float
    exclusive: bool = False


@dataclass(frozen=True)
class And(Filter):
    parts: Sequence[Filter]


@dataclass(frozen=True)
class Or(Filter):
    parts: Sequence[Filter]


@dataclass(frozen=True)
class Not(Filter):
    part: Filter


def from_map(conditions: dict[str, str]) -> Filter:
    """All of the given equalities."""
    return And(tuple(Eq(k, v) for k, v in conditions.items()))


def from_json(node: dict) -> Filter:
    """A filter from its JSON form, e.g. ``{"and": [{"eq": ["status", "sold"]}, {"not": {"gt": ["price", 5]}}]}``."""
    ((op, arg),) = node.items()
    if op in ("and", "or"):
        return (And if op == "and" else Or)(tuple(from_json(x) for x in arg))
    if op == "not":
        return Not(from_json(arg))
    if op == "eq":
        return Eq(*arg)
    if op == "in":
        return In(arg[0], tuple(arg[1]))
    if op in ("range", "between"):
        return Range(*arg, exclusive=op == "between")
    if op in ("gt", "gte", "lt", "lte", "num_eq"):
        return Compare(arg[0], op.removeprefix("num_"), arg[1])
    raise ValueError(f"unknown condition {op}")


_OPS: dict[str, Callable[[Column, float], Column]] = {
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "eq": lambda c, v: c == v,
}


#: Types whose columns are compared as numbers without a cast.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def condition(f: Filter, field: Callable[[str], Column] = F.col, kinds: dict[str, str] | None = None) -> Column:
    """The filter as a column for ``where``, null or false where it does not hold; ``field`` gives the column of a field.

    ``kinds`` (``dict(df.dtypes)``) names the fields' types: numeric columns are then compared as they are, other
    columns than strings as text. Fields without a known type are texts.
    """
    kinds = kinds or {}

    def number(name: str) -> Column:
        return field(name) if kinds.get(name, "").startswith(NUMBERS) else field(name).try_cast("double")

    def text(name: str) -> Column:
        return field(name) if kinds.get(name, "string") == "string" else field(name).cast("string")

    match f:
        case Eq(name, value):
            return text(name) == value
        case In(name, values):
            return text(name).isin(*values)
        case Compare(name, op, value):
            return _OPS[op](number(name), float(value))
        case Range(name, low, high, exclusive):
            x = number(name)
            return (x > float(low)) & (x < float(high)) if exclusive else (x >= float(low)) & (x <= float(high))
        case And(parts):
            return reduce(lambda a, b: a & b, (condition(p, field, kinds) for p in parts), F.lit(True))
        case Or(parts):
            return reduce(lambda a, b: a | b, (condition(p, field, kinds) for p in parts), F.lit(False))
        case Not(part):
            return ~F.coalesce(condition(part, field, kinds), F.lit(False))
        case _:
            raise TypeError(f"no filter: {f!r}")


def matching(df: DataFrame, f: Filter) -> DataFrame:
    """The rows of a typed table that satisfy the filter."""
    return df.where(condition(f, kinds=dict(df.dtypes)))


def map_field(column: str = "metadata") -> Callable[[str], Column]:
    """Fields of a map of strings."""
    return lambda name: F.try_element_at(F.col(column), F.lit(name))


def with_ids(df: DataFrame, ids: DataFrame | Sequence[int], key: str = "id") -> DataFrame:
    """Only rows whose key is listed: a predicate for few ids, a join for a table of them."""
    if isinstance(ids, DataFrame):
        return guarded_join(df, ids.select(key).distinct(), [key], "left_semi", salts=1)
    if len(ids) <= LISTED_IDS:
        return df.where(F.col(key).isin(*ids))
    return df.join(df.sparkSession.createDataFrame([(i,) for i in set(ids)], f"{key} long"), key, "left_semi")


def active(df: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    """Rows that are not deleted. Tombstones grow with the data, so they are joined by shuffle unless the optimizer knows them to be small."""
    return df.join(tombstones.select(key).distinct(), key, "left_anti")
