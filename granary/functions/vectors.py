"""Vector expressions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    return dot(normalised(a), normalised(b))


def relevance(score: Column, metric: str, compat: bool = False) -> Column:
    """Score of a hit as a relevance. ``compat`` treats similarities as distances, which inverts cosine and ip."""
    if metric == "l2":
        return 1.0 - score / F.sqrt(F.lit(2.0))
    if metric not in ("cosine", "ip"):
        raise ValueError(f"unknown metric {metric!r}")
    if not compat:
        return score
    return 1.0 - score if metric == "cosine" else F.when(score > 0, 1.0 - score).otherwise(-score)


def store_score(score: Column, metric: str) -> Column:
    """The score scale of a graph store's vector index: (1 + cos) / 2, or 1 / (1 + d^2)."""
    return (1.0 + score) / 2.0 if metric == "cosine" else 1.0 / (1.0 + score)
