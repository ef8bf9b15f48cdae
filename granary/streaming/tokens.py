"""Token streams of chat models, and ingestion of new documents as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.store import upsert


def cumulative(deltas: DataFrame) -> DataFrame:
    """(message, seq, delta) -> with the content so far. A group is one message."""
    w = Window.partitionBy("message").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("content", F.array_join(F.collect_list("delta").over(w), ""))


def tool_calls(fragments: DataFrame) -> DataFrame:
    """(message, index, seq, name, arguments) -> one call for each message and index, its arguments joined in order."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", F.coalesce("arguments", F.lit("")).alias("a"))))
    name = F.min_by("name", F.when(F.col("name").isNotNull(), F.col("seq")))
    return fragments.groupBy("message", "index").agg(name.alias("name"), F.array_join(F.transform(ordered, lambda x: x["a"]), "").alias("arguments"))


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str = "id"):
    """Writes new documents over a table by key, batch by batch; a batch that runs again gives the same table.

    Versions of the table are written side by side under ``path`` and named by batch number.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, fresh = batch.sparkSession, batch.dropDuplicates([key])
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p)] if fs.exists(p) else []
        before = [n for n in done if n < number]
        now = upsert(spark.read.parquet(f"{path}/version={max(before)}"), fresh, key) if before else fresh
        now.write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
