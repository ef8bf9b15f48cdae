"""Scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def contained(predicted: Column, truth: Column) -> Column:
    """1 where the truth is part of the answer, both in lower case; an empty truth always is."""
    return F.lower(predicted).contains(F.lower(truth)).cast("int")


def containment(answers: DataFrame, predicted: str = "answer", truth: str = "ground_truth") -> DataFrame:
    """Mean containment, null (not NaN) over no rows."""
    return answers.agg(F.avg(contained(F.col(predicted), F.col(truth))).alias("score"))


def cleaning_report(cases: DataFrame) -> DataFrame:
    """(original_type, cases, succeeded, objects, mean_length, success_rate) of cleaned cases."""
    ok = F.col("success").cast("int")
    return cases.groupBy("original_type").agg(F.count("*").alias("cases"), F.sum(ok).alias("succeeded"), F.sum("objects").alias("objects"), F.avg("original_length").alias("mean_length"), F.avg(ok).alias("success_rate"))


def page_index(rows: DataFrame, page: str = "page_idx", order: str = "pos") -> DataFrame:
    """A running number from 0 within each page."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(page).orderBy(order)) - 1)


def update_text(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Text rows take the result for their (page_idx, index), the last (seq) of several; other rows stay."""
    last = found.groupBy("page_idx", "index").agg(F.max_by("result", "seq").alias("result"))
    text = F.when(F.col("type") == "text", F.coalesce("result", "text")).otherwise(F.col("text"))
    return rows.join(last, ["page_idx", "index"], "left").withColumn("text", text).drop("result")


def drop_repeated_cells(cells: DataFrame, pairs: int = 5, boxes: int = 2) -> DataFrame:
    """Cells as rows (page, pos, category, text, bbox): the first stays of (category, text) pairs met ``pairs`` times or more on a page, and of boxes met ``boxes`` times or more."""
    p, b = Window.partitionBy("page", "category", "text"), Window.partitionBy("page", "bbox")
    first = lambda w: F.row_number().over(w.orderBy("pos"))
    has_pair = F.col("category").isNotNull() & F.col("text").isNotNull()
    has_box = F.col("bbox").isNotNull()
    late = (has_pair & (F.count("*").over(p) >= pairs) & (first(p) > 1)) | (has_box & (F.count("*").over(b) >= boxes) & (first(b) > 1))
    return cells.withColumn("_late", late).filter(~F.col("_late")).drop("_late")
