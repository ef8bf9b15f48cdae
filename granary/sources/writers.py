"""Sinks: results, page manifests, sections and cleaning reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def results(df: DataFrame, folder: str, dataset: str, solution: str, n: int) -> str:
    path = f"{folder}/{dataset}/{solution}/{dataset}_{n}.json"
    df.write.mode("overwrite").json(path)
    return path


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def page_outputs(pages: DataFrame, path: str) -> DataFrame:
    """A page's Markdown and cells, partitioned by file, and a manifest row for each page in order."""
    pages.write.mode("overwrite").partitionBy("file").json(f"{path}/pages")
    manifest = pages.select("file", "page_no", "input_height", "input_width", "filtered", F.concat(F.lit(f"{path}/pages/file="), "file").alias("layout_path"))
    manifest.orderBy("file", "page_no").write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def create_table(spark, name: str, schema: str, partition: str | None = None) -> None:
    """A collection's table; one that is there stays as it is."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet" + (f" PARTITIONED BY ({partition})" if partition else ""))
