"""Session and scratch-table helpers shared by all operators.

Lineage is cut only with tables written to the folder that the cluster names in
``spark.checkpoint.dir``; executors may be lost at any time, so nothing here keeps
the only copy of a result on one of them.
"""

from __future__ import annotations

import contextlib
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("granary")
    return builder.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, as the session names it.

    Set to a temporary folder only where the session names none and runs in a single
    local JVM, as in tests; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


class Scratch:
    """Tables of one query in the shared folder; the file system drops them when the driver ends.

    ``table`` writes a DataFrame and returns it as read back: a retried or speculative
    task can't change what later jobs see. ``drop`` frees a table that is not needed again. Python
    stages of the plan get Arrow batches of at most ``rows`` rows, as texts and sets can be long.
    """

    rows = 2_000

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/granary-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self._n = 0

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def table(self, df: DataFrame, name: str = "t", codec: str = "zstd", rows: int | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n}-{name}"
        with conf(self.spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows or self.rows)):
            df.write.option("compression", codec).parquet(path)
        fs, p = self._fs(path)
        fs.deleteOnExit(p)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._granary_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_granary_path", None)
        if path:
            fs, p = self._fs(path)
            fs.delete(p, True)


@contextlib.contextmanager
def conf(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings for the jobs started inside the block (dots written as ``__``)."""
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the session's workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root, data = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = f"{shared_dir(spark)}/granary-{app}/granary-package.zip"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(at, True)
    stream.write(data.getvalue())
    stream.close()
    fs.deleteOnExit(at)
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str, per: int = 20_000) -> DataFrame:
    """``df`` in partitions of about ``per`` rows by a hash of ``by``, for work that takes long a row: a small file is read by one task."""
    return df.repartition(max(1, -(-df.count() // per)), *by)


def global_index(scratch: Scratch, df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the row number from 0 in ``order``, by range partitions and their counts.

    No task sees more than its range; the driver gets one count a partition.
    """
    n = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    part = F.shiftright(F.col("_m"), 33)
    rows = scratch.table(ranged.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", part), "indexed")
    counts = {r["_p"]: r["count"] for r in rows.groupBy("_p").count().collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    offset = F.lit(0).cast("long")
    if before:
        offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_p")).cast("long")
    local = F.col("_m") - F.shiftleft(F.col("_p"), 33)
    return rows.withColumn(name, offset + local).drop("_m", "_p")
