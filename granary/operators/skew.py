"""Joins with a table of one row a key, where one key may hold a third of all rows of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 1_000


def unused(columns: list[str], *names: str) -> list[str]:
    """Each name, with underscores before it until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def spread_join(big: DataFrame, small: DataFrame, on: list[str], rows: DataFrame, count: str, total: int, by: list[str], how: str = "inner", least: int = 20_000) -> DataFrame:
    """``big`` joined with ``small`` (one row a key) on ``on``; hot keys are spread over tasks.

    ``rows`` has ``on`` and how many rows of ``big`` a key has (``count``), of ``total`` in all. Keys
    of more than a thousandth of all rows (and ``least``) are cut into that many shares by a hash of
    ``by``, and their row of ``small`` is repeated for each. There are at most ``PARTS`` such keys and
    as many repeats, whatever the size, so the list of keys is broadcast. Null keys match nothing.
    """
    per = max(least, total // PARTS)
    if total <= per:
        return big.join(small, on, how)
    n, salt = unused([*big.columns, *small.columns], "shares", "salt")
    hot = F.broadcast(rows.filter(F.col(count) > per).select(*on, F.ceil(F.col(count) / per).cast("int").alias(n)))
    share = F.coalesce(F.col(n), F.lit(1))
    left = big.join(hot, on, "left").withColumn(salt, F.pmod(F.xxhash64(*by), share).cast("int")).drop(n)
    right = small.join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), share - 1))).drop(n)
    return left.join(right, [*on, salt], how).drop(salt)
