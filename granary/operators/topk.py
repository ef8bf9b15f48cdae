"""Ranking per query, with a total order: score, then id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(scored: DataFrame, k: int | None, score: str = "score", query: str = "query_id", ident: str = "id", ascending: bool = False) -> DataFrame:
    """The ``k`` best rows of each query (all, where k is None) with ``rank`` from 1.

    The rank filter directly over the window lets Spark keep only k rows a task before the shuffle.
    """
    order = [F.asc(score) if ascending else F.desc(score), F.asc(ident)]
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return out if k is None else out.filter(F.col("rank") <= k)


def max_normalised(score: Column, *keys: str) -> Column:
    return score / F.max(score).over(Window.partitionBy(*keys))


def min_max(score: Column, *keys: str) -> Column:
    """(s - min) / (max - min) per key; where all are equal, the score itself."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).otherwise(high)
