"""A document table with upserts and deletes, as snapshots.

A snapshot is a DataFrame; every change is a plan over the one before, and ``save`` writes it to a
table that ``load`` reads. Keys are compared by equi-joins.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` take the place of those with their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def merge_properties(old: DataFrame, new: DataFrame, key: str = "id", props: str = "metadata") -> DataFrame:
    """Upsert in which a row's map keeps old keys that the new map doesn't have; other columns are the new ones."""
    prior = old.select(key, F.col(props).alias("_old"))
    empty = F.create_map().cast(old.schema[props].dataType)
    left = F.map_filter(F.coalesce("_old", empty), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce(F.col(props), empty)), k))
    merged = new.join(prior, key, "left").withColumn(props, F.map_concat(left, F.coalesce(F.col(props), empty))).select(*old.columns)
    return old.join(new.select(key), key, "left_anti").unionByName(merged)


def with_ids(docs: DataFrame, key: str = "id") -> DataFrame:
    return docs.withColumn(key, F.coalesce(F.col(key), F.expr("uuid()")))


def delete_ids(docs: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Unknown ids are ignored."""
    return docs.join(ids.select(key), key, "left_anti")


def delete_all_or_none(docs: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, bool]:
    """Deletes only if every id is there; no ids is a success that changes nothing."""
    unknown = ids.select(key).distinct().join(docs.select(key), key, "left_anti").limit(1).count()
    return (docs, False) if unknown else (delete_ids(docs, ids, key), True)


def delete_where(docs: DataFrame, predicate: Column) -> DataFrame:
    return docs.filter(~F.coalesce(predicate, F.lit(False)))


def get_in_order(docs: DataFrame, requested: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """Rows for the requested (pos, id), in the order asked; unknown ids are skipped, repeated ones repeat."""
    return requested.join(docs, key).orderBy(order)


def scroll(docs: DataFrame, where: Column | None = None, ids: list | None = None, limit: int | None = None, key: str = "id", most: int = 9_999) -> DataFrame:
    """A bounded scan in the order of ids; given ids are alternatives to nothing else and bound the limit."""
    out = docs if where is None else docs.filter(where)
    if ids:
        out = out.filter(F.col(key).isin(ids))
        limit = min(len(ids), limit or most)
    return out.orderBy(key).limit(limit or most)


def without_keys(props: Column, *keys: str) -> Column:
    return F.map_filter(props, lambda k, v: ~k.isin(*keys))


def save(docs: DataFrame, path: str, config: dict | None = None, partition_by: tuple[str, ...] = ()) -> None:
    docs.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/rows")
    docs.sparkSession.createDataFrame([(json.dumps(config or {}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/config").first()[0])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
