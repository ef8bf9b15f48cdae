"""Metadata filters: one boolean algebra, built into a Column that Catalyst pushes down."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Where:
    """``key op value``. A null or missing key satisfies only is_empty (and no comparison)."""

    key: str
    value: object = None
    op: str = "=="


@dataclass(frozen=True)
class Group:
    """``and``, ``or`` and ``not`` (none of the parts) over conditions and groups; an empty group is true."""

    parts: tuple = field(default_factory=tuple)
    how: str = "and"


def _listed(value: object) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else str(value).split(",")


def _one(c: Column, op: str, value: object) -> Column:
    match op:
        case "==" | "eq":
            return c == F.lit(value)
        case "!=" | "ne":
            return c.isNotNull() & (c != F.lit(value))
        case ">":
            return c > F.lit(value)
        case "<":
            return c < F.lit(value)
        case ">=":
            return c >= F.lit(value)
        case "<=":
            return c <= F.lit(value)
        case "in":
            return c.isin(_listed(value))
        case "nin":
            return c.isNotNull() & ~c.isin(_listed(value))
        case "contains" | "text_match":
            return c.contains(value)
        case "text_match_insensitive":
            return F.lower(c).contains(str(value).lower())
        case "is_empty":
            return c.isNull()
        case "is_empty_list":
            return c.isNull() | (F.size(c) == 0)
    raise ValueError(f"unknown filter operator {op!r}")


def condition(where: Where | Group | None, keys=F.col) -> Column:
    """The filter as a Column; null counts as false, also under ``not``. ``keys`` turns a key into a Column.

    Comparisons stay bare, so that Spark can push them into the scan.
    """
    if where is None:
        return F.lit(True)
    if isinstance(where, Where):
        return _one(keys(where.key), where.op.lower(), where.value)
    parts = [condition(p, keys) for p in where.parts]
    if not parts:
        return F.lit(True)
    match where.how.lower():
        case "and":
            return reduce(lambda a, b: a & b, parts)
        case "or":
            return reduce(lambda a, b: a | b, parts)
        case "not":
            return ~F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False))
    raise ValueError(f"unknown group {where.how!r}")


def searchable(vector: Column, dim: int) -> Column:
    """Rows that a filtered exact search may score: a vector of the index's dimension."""
    return vector.isNotNull() & (F.size(vector) == dim)


def scoped(ident: str = "id", doc: str = "doc_id", ids=None, doc_ids=None, where=None, override: Column | None = None) -> Column:
    """Query filter: ids and doc ids and conditions; ``override`` takes their place; nothing given filters nothing."""
    if override is not None:
        return override
    parts = [F.col(c).isin(list(v)) for c, v in ((ident, ids), (doc, doc_ids)) if v]
    return reduce(lambda a, b: a & b, [*parts, condition(where)])


def check_search(hybrid: bool, where) -> None:
    if hybrid and where is not None:
        raise ValueError("a metadata filter can't be used with hybrid search")
