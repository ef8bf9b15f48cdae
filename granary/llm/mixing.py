"""Mixing sources to target weights by capped water-filling.

Targets: sources share the corpus's size by weight; a source whose share exceeds ``epochs``
times its own size is clamped there, and the excess goes to the others by weight, again and
again until none is above. Each round is an aggregate over the table of sources; only its
level (one row) comes to the driver.

Repetitions: a source's documents are each taken ``floor(target / size)`` times; for the rest,
whole documents are taken once more in the order of a seeded hash, and the one at the border in
part. The running sum is kept in strata of the hash, so a source of any size is spread over
tasks, and the sums over strata join the parts exactly.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import samples
from granary.llm import words as W
from granary.operators.skew import unused

WEIGHTS = (5, 2, 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(9, 14)]] = True


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text, counted on the Arrow buffer: starts of runs of non-space bytes."""
    column = column.cast(pa.large_binary())
    n, o = len(column), np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if not n or data is None or o[-1] == o[0]:
        return np.zeros(n, dtype=np.int64)
    space = _SPACE[np.frombuffer(data, np.uint8)[o[0] : o[-1]]]
    begins = ~space
    begins[1:] &= space[:-1]
    o = o - o[0]
    firsts = o[:-1][(o[1:] > o[:-1])]
    begins[firsts] = ~space[firsts]
    total = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    return total[o[1:]] - total[o[:-1]]


def _sizes(batches):
    W.release()
    for b in W.slices(batches, max_bytes=1_000_000):
        cols = dict(zip(b.schema.names, b.columns))
        cols["size"] = pa.array(word_counts(cols.pop("text")))
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def source_targets(spark: SparkSession, sources: DataFrame, scratch: runtime.Scratch, weights=WEIGHTS, epochs: int = 3) -> DataFrame:
    """(source, source_size) -> with weight and target. Weights go round in code-point order, null last."""
    ranked = runtime.global_index(scratch, sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_i").drop("_null")
    pick = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = scratch.table(ranked.withColumn("weight", pick).drop("_i"), "sources")
    cap = F.col("source_size") * epochs
    level, capped = None, F.col("source_size") <= 0
    while True:
        r = ranked.agg(F.sum("source_size").alias("total"), F.sum(F.when(capped, cap)).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("open"), F.count(F.when(capped, 1)).alias("n")).first()
        if not r["open"]:
            break
        now = float((r["total"] or 0) - (r["full"] or 0)) / float(r["open"])
        if level is not None and n == r["n"]:
            break
        level, n = now, r["n"]
        capped = (F.col("source_size") <= 0) | (F.lit(level) * F.col("weight") > cap)
    return ranked.withColumn("target", F.when(capped, cap.cast("double")).otherwise(F.lit(level or 0.0) * F.col("weight")))


def row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of the whole row; rows that differ anywhere are told apart."""
    plain = [f"`{n}`" for n, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    other = [F.to_json(F.struct(F.col(f"`{n}`"))) for n, kind in docs.dtypes if "map<" in kind or kind == "variant"]
    return F.xxhash64(*plain, *other)


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, epochs: int = 3, seed: int = 17, text: str = "text", ident: str = "doc_id", source: str = "source", strata: int = 3, with_key: bool = False) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes of the document).

    Size is the number of words, however long the text; null and empty text has none. A null source is a source of its own, after
    the others; a null id is hashed as the empty string. Repeated rows are documents each; equal
    ids are ordered by size, so which of two equal rows comes first doesn't matter. Only the named
    columns are read. An empty table, or one without words, takes nothing. Reruns agree: the order
    depends on ``seed`` and the ids alone. ``strata`` is how many hex digits of the hash split a
    source.
    """
    scratch = runtime.Scratch(spark)
    names = [samples.long_id(docs, ident).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text")]
    key = ["_key"] * with_key
    own = docs.select(*names, *([row_key(docs).alias("_key")] if with_key else []))
    sized = own.mapInArrow(_sizes, "doc_id long, source string, " + "_key long, " * with_key + "size long")
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = scratch.table(sized.withColumn("_h", hashed), "sizes")
    stratum = F.substring("_h", 1, strata)
    parts = scratch.table(sized.groupBy("source", stratum.alias("_s")).agg(F.sum("size").alias("_part")), "strata")
    targets = source_targets(spark, parts.groupBy("source").agg(F.sum("_part").alias("source_size")), scratch, weights, epochs)
    before = Window.partitionBy("source").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_part").over(before), F.lit(0))).drop("_part")
    targets = targets.withColumnRenamed("source", "_source")
    parts = parts.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    parts = parts.withColumnsRenamed({"source": "_source", "_s": "_stratum"})
    run = Window.partitionBy("source", "_s").orderBy("_h", "size", *key).rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("_s", stratum).withColumn("_run", F.coalesce(F.sum("size").over(run), F.lit(0)))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_s") == F.col("_stratum")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    extra = F.floor(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long") - F.col("_before") - F.col("_run")
    taken = F.col("_whole") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), extra))
    return rows.withColumn("_whole", whole).select("doc_id", "size", "source_size", "target", taken.alias("taken"), *key)


def _cut(batches, text: str, words: str):
    """Texts of repetitions: whole, or their first words where there is a number of them."""
    for b in W.slices(batches, text, max_bytes=3_000_000):
        cols = dict(zip(b.schema.names, b.columns))
        least = cols.pop(words).to_pylist()
        if any(n is not None for n in least):
            out = []
            for t, n in zip(W.raw(cols[text].cast(pa.string())), least):
                if n is not None:
                    end = 0
                    for w in t.split(None, n)[:n]:
                        end = t.index(w, end) + len(w)
                    t = t[:end]
                out.append(t)
            cols[text] = pa.array(out, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def mixed_documents(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, epochs: int = 3, seed: int = 17, text: str = "text", ident: str = "doc_id", source: str = "source", run: int = 1024) -> DataFrame:
    """The mix itself: the rows of ``docs`` that are taken, as often as they are, all columns as they were.

    A row appears once for each whole repetition; the one document at a source's border has one
    more in part, its first words. Rows that aren't taken, or have no words (null and empty texts),
    are left out. Rows that are equal in every column can't be told apart: what is taken of them
    together comes as whole repetitions and at most one part. Rows that differ in any column, in
    the source alone as well, are each taken as ``mix`` says. Long texts are taken whole; columns
    may have any name. An empty table gives an empty table. Repetitions of one row beyond ``run``
    are made in runs of that many, by several tasks.
    """
    scratch = runtime.Scratch(spark)
    docs = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    marks = mix(spark, docs, weights, epochs, seed, text, ident, source, with_key=True)
    own, key, taken, size, n, begin, words, same = unused(docs.columns, "own", "key", "taken", "size", "n", "begin", "words", "same")
    marks = marks.groupBy(F.col("_key").alias(key)).agg(F.sum("taken").alias(taken), F.max("size").alias(size), F.count("*").alias(same))
    marks = scratch.table(marks.filter(F.col(taken) > 0), "marks")
    rows = docs.withColumn(own, row_key(docs)).join(marks.hint("merge"), F.col(own) == F.col(key))
    times = F.ceil(F.col(taken) / F.col(size)).cast("long")
    most = marks.agg(F.max(same), F.max(times)).first()
    if (most[0] or 1) > 1:  # one of equal rows, with what is taken of all
        rows = rows.filter(F.col(same) == 1).unionByName(rows.filter(F.col(same) > 1).dropDuplicates([key]))
    if (most[1] or 1) > run:
        long = rows.filter(times > run).withColumn(begin, F.explode(F.sequence(F.lit(1).cast("long"), times, F.lit(run).cast("long")))).repartition(key, begin)
        rows = rows.filter(times <= run).withColumn(begin, F.lit(1).cast("long")).unionByName(long)
    else:
        rows = rows.withColumn(begin, F.lit(1).cast("long"))
    rows = rows.withColumn(n, F.explode(F.sequence(F.col(begin), F.least(times, F.col(begin) + run - 1))))
    rest = F.col(taken) - (F.col(n) - 1) * F.col(size)
    rows = rows.withColumn(words, F.when(rest < F.col(size), rest)).select(*[f"`{c}`" for c in docs.columns], words)
    return samples.arrow_rows(rows, partial(_cut, text=text, words=words), docs.schema)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, runtime.table(spark, sf_dir, "documents"))


SQL = {
    "op6_mixing": """
WITH docs AS (
  SELECT doc_id, source, md5('17|' || coalesce(doc_id::VARCHAR, '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r
  FROM docs GROUP BY source),
weighted AS (
  SELECT source, source_size, 3 * source_size AS cap, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM ranked),
filled AS (
  SELECT *, cap / w AS ratio,
         sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_cap,
         sum(w) OVER (ORDER BY cap / w, w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM weighted),
level AS (
  SELECT arg_min((total - full_cap)::DOUBLE / open_w::DOUBLE, ratio) AS lvl
  FROM filled WHERE cap > 0 AND (total - full_cap)::DOUBLE / open_w <= ratio),
targets AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 WHEN lvl * w > cap THEN cap::DOUBLE ELSE lvl * w END AS target
  FROM weighted, level),
ordered AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target - whole * source_size)::BIGINT - run)))::BIGINT AS taken
FROM ordered""",
}
QUERIES = {"op6_mixing": op6_mixing}
