"""Exact top-k vector search, thresholds and maximal marginal relevance.

A stated set of queries is searched in passes of bounded size: the queries of a pass are one
matrix that is broadcast, each task multiplies its blocks of vectors by it and keeps k rows a
query and block, and Spark ranks what is left. Vectors are never shuffled.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from granary.functions import vectors as vx
from granary.operators.filters import condition
from granary.operators.topk import ranked

METRICS = ("cosine", "l2", "ip")


def _blocks(batches, shared, metric: str, k: int):
    qids, q = shared.value
    qn = np.sqrt((q * q).sum(axis=1))
    unit = q / np.where(qn > 0, qn, 1)[:, None]
    for b in batches:
        b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), q.shape[1]), False))
        for lo in range(0, b.num_rows, 4096):
            s = b.slice(lo, 4096)
            v = s.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(s.num_rows, -1)
            if metric == "cosine":
                n = np.sqrt((v * v).sum(axis=1))
                m = unit @ (v / np.where(n > 0, n, 1)[:, None]).T
            elif metric == "ip":
                m = q @ v.T
            else:
                m = -np.stack([((v - row[None]) ** 2).sum(axis=1) for row in q])
            take = min(k, s.num_rows)
            edge = np.partition(m, s.num_rows - take, axis=1)[:, s.num_rows - take][:, None]
            r, c = np.nonzero(m >= edge)  # ties at the edge stay, the ranking cuts by id
            score = m[r, c] if metric != "l2" else -m[r, c]
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(r)), s.column(0).take(pa.array(c)), pa.array(score)], names=["query_id", "id", "score"])


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int | None = 4, metric: str = "cosine", where=None, at_once: int = 4_096) -> DataFrame:
    """query_id, id, score and rank: the k nearest of ``vectors`` (id, vector, ...) for ``queries`` (query_id, vector).

    Score is the cosine, the inner product or the squared distance (ascending). ``where`` filters
    before the ranking. Vectors that are null or of another length than the queries take no part.
    ``at_once`` queries are searched in one pass over the vectors.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    rows = queries.select("query_id", vx.doubles(F.col("vector")).alias("vector")).filter(F.col("vector").isNotNull())
    own = vectors.filter(condition(where)) if where is not None else vectors
    schema = T.StructType([queries.schema["query_id"], vectors.schema["id"], T.StructField("score", T.DoubleType())])
    out, block = None, []

    def one_pass(block):
        ids = pa.array([r["query_id"] for r in block], to_arrow_type(queries.schema["query_id"].dataType))
        shared = spark.sparkContext.broadcast((ids, np.array([r["vector"] for r in block], np.float64)))
        # Vectors that don't fit are left out in Python: a filter here would run a model that makes them once more.
        return own.select("id", vx.doubles(F.col("vector")).alias("vector")).mapInArrow(partial(_blocks, shared=shared, metric=metric, k=k if k is not None else 1 << 30), schema)

    for r in rows.toLocalIterator():
        if block and (len(block) == at_once or len(r["vector"]) != len(block[0]["vector"])):
            part = one_pass(block)
            out, block = part if out is None else out.unionByName(part), []
        block.append(r)
    if block:
        part = one_pass(block)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return ranked(out, k, ascending=metric == "l2").select("query_id", "id", "score", "rank")


def with_relevance(hits: DataFrame, metric: str = "cosine", threshold: float | None = None, compat: bool = False) -> DataFrame:
    """Relevance of each hit and, after the top-k, those of ``threshold`` at least."""
    out = hits.withColumn("relevance", vx.relevance(F.col("score"), metric, compat))
    return out if threshold is None else out.filter(F.col("relevance") >= threshold)


def _select(pdf: pd.DataFrame, k: int, weight: float) -> pd.DataFrame:
    """Greedy selection over one query's candidates (at most fetch_k rows), in the order of their scores."""
    pdf = pdf.sort_values(["rank"], kind="stable").reset_index(drop=True)
    n = len(pdf)
    if n <= k:
        picked = list(range(n))
    else:
        v = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        norm = np.sqrt((v * v).sum(axis=1))
        unit = v / np.where(norm > 0, norm, 1)[:, None]
        near = unit @ unit.T
        gain = pdf["score"].to_numpy(np.float64)
        picked, most = [0], np.maximum(near[0], 0.0)
        while len(picked) < k:
            value = weight * gain - (1 - weight) * most
            value[picked] = -np.inf
            best = int(np.argmax(value))
            picked.append(best)
            most = np.maximum(most, near[best])
    return pd.DataFrame({"query_id": pdf["query_id"].iloc[picked].to_numpy(), "id": pdf["id"].iloc[picked].to_numpy(), "score": pdf["score"].iloc[picked].to_numpy(), "rank": np.arange(1, len(picked) + 1, dtype=np.int32)})


def marginal_relevance(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 4, fetch_k: int = 20, weight: float = 0.5, where=None) -> DataFrame:
    """Top ``fetch_k`` by cosine, then k picked one by one for weight * score - (1 - weight) * largest similarity to a pick.

    The first pick is the nearest; a similarity below 0 counts as 0; ties go to the nearer. With
    no more than k candidates all stay in the order of their scores.
    """
    hits = search(spark, vectors, queries, fetch_k, "cosine", where)
    held = hits.join(vectors.select("id", "vector"), "id")
    schema = T.StructType([hits.schema[c] for c in ("query_id", "id", "score")] + [T.StructField("rank", T.IntegerType())])
    return held.select("query_id", "id", "score", "rank", "vector").groupBy("query_id").applyInPandas(lambda pdf: _select(pdf, k, weight), schema)


def retrieve(spark: SparkSession, vectors: DataFrame, queries: DataFrame, search_type: str = "similarity", k: int = 5, metric: str = "cosine", score_threshold: float | None = None, fetch_k: int = 20, weight: float = 0.5, where=None) -> DataFrame:
    """The search types of a vector retriever."""
    if search_type == "similarity":
        return search(spark, vectors, queries, k, metric, where)
    if search_type == "similarity_score_threshold":
        if score_threshold is None or not 0 <= score_threshold <= 1:
            raise ValueError("score_threshold must be from 0 to 1")
        return with_relevance(search(spark, vectors, queries, k, metric, where), metric, score_threshold)
    if search_type == "mmr":
        return marginal_relevance(spark, vectors, queries, k, fetch_k, weight, where)
    raise ValueError(f"unknown search type {search_type!r}")


def cells(vectors: DataFrame, n: int = 100, seed: int = 1, bound: int = 20_000) -> tuple[DataFrame, np.ndarray]:
    """Inverted file: each vector with the nearest of ``n`` centroids, fitted on at most ``bound`` vectors (few vectors: one cell)."""
    drawn = [r["vector"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(bound).select("vector").collect()]
    x = np.array(drawn, np.float64)
    if len(x) < n:
        c = x[:1]
    else:
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), n, replace=False)]
        for _ in range(10):
            near = (x @ c.T - 0.5 * (c * c).sum(axis=1)[None]).argmax(axis=1)
            c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(n)])

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_numpy()).astype(np.float64)
        return pd.Series((m @ c.T - 0.5 * (c * c).sum(axis=1)[None]).argmax(axis=1).astype(np.int32))

    return vectors.withColumn("cell", cell(vx.doubles(F.col("vector")))), c


def search_cells(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 4, n: int = 100, probes: int = 10) -> DataFrame:
    """Approximate inner-product search: only the ``probes`` cells nearest to a query are scored."""
    held, c = cells(vectors, n)
    mids = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(c)], "id long, vector array<double>")
    opened = search(spark, mids, queries, probes, "l2").select("query_id", F.col("id").cast("int").alias("cell"))
    asks = opened.join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
    scored = held.select("id", "vector", "cell").join(asks, "cell").select("query_id", "id", vx.dot(F.col("vector"), F.col("q")).alias("score"))
    return ranked(scored, k).select("query_id", "id", "score", "rank")
