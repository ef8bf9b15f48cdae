"""Combining ranked lists: reciprocal ranks, relative scores, graph-store hybrid, several retrievers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import vectors as vx
from granary.operators.topk import max_normalised, min_max, ranked

#: (query_id, key, score or rank, ...) lists -> one list with score and rank.
FusionMethod = Callable[[Sequence[DataFrame], int | None], DataFrame]


def reciprocal_ranks(lists: Sequence[DataFrame], top_k: int | None = None, constant: int = 60, key: str = "id") -> DataFrame:
    """Sum of 1 / (constant + rank) over all lists for each query and key.

    Lists hold query_id, ``key`` and rank; ranks are taken again per list from 1, and a key that a
    list holds twice counts twice. ``top_k`` None keeps all.
    """
    tagged = [d.select("query_id", key, "rank").withColumn("_list", F.lit(i)) for i, d in enumerate(lists)]
    union = reduce(lambda a, b: a.unionByName(b), tagged)
    own = F.row_number().over(Window.partitionBy("query_id", "_list").orderBy("rank", key))
    fused = union.withColumn("_rank", own).groupBy("query_id", key).agg(F.sum(1.0 / (constant + F.col("_rank"))).alias("score"))
    return ranked(fused, top_k, ident=key)


def relative_scores(dense: DataFrame, sparse: DataFrame, alpha: float | None = None, top_k: int | None = None) -> DataFrame:
    """(1 - alpha) * sparse + alpha * dense of min-max scores per query; a list that lacks an id counts 0. Alpha None is 0.5."""
    alpha = 0.5 if alpha is None else alpha
    d = dense.select("query_id", "id", min_max(F.col("score"), "query_id").alias("d"))
    s = sparse.select("query_id", "id", min_max(F.col("score"), "query_id").alias("s"))
    both = d.join(s, ["query_id", "id"], "full_outer")
    return ranked(both.select("query_id", "id", (alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0))).alias("score")), top_k)


def best_of_branches(vector_hits: DataFrame, text_hits: DataFrame, k: int) -> DataFrame:
    """Scores over each branch's largest, united, the larger of an id's two, top k."""
    parts = [d.select("query_id", "id", max_normalised(F.col("score"), "query_id").alias("score")) for d in (vector_hits, text_hits)]
    merged = parts[0].union(parts[1]).distinct().groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return ranked(merged, k)


def sparse_search(docs: DataFrame, queries: DataFrame, k: int, idf: bool = False) -> DataFrame:
    """Top k by the product of sparse vectors (id or query_id, array<struct<index, value>>), by a join on the index.

    With ``idf`` a document's value is weighted by ln((N - n + 0.5) / (n + 0.5) + 1) of its index.
    """
    d = docs.select("id", F.inline("sparse"))
    q = queries.select("query_id", F.inline("sparse")).select("query_id", "index", F.col("value").alias("asked"))
    if idf:
        total = docs.count()
        n = d.join(q.select("index").distinct(), "index", "left_semi").groupBy("index").agg(F.countDistinct("id").alias("n"))
        weight = F.log((total - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1.0)
        q = q.join(n, "index").select("query_id", "index", (F.col("asked") * weight).alias("asked"))
    scored = d.join(q, "index").groupBy("query_id", "id").agg(F.sum(F.col("value").cast("double") * F.col("asked").cast("double")).alias("score"))
    return ranked(scored, k).select("query_id", "id", "score", "rank")


def term_frequencies(words) -> F.Column:
    """Sparse vector of a word array: hashed index and count of each word."""
    return F.transform(F.array_distinct(words), lambda w: F.struct(F.abs(F.hash(w)).alias("index"), F.size(F.filter(words, lambda x: x == w)).cast("float").alias("value")))


@dataclass
class MultiPath:
    """Several retrievers (queries, k -> hits with query_id, id, rank), fused.

    A retriever that raises while its plan is made gives nothing; with none left the result is empty.
    With ``texts`` (id, content) hits of equal content are one, as if their content were the key; the
    smallest id stands for them.
    """

    retrievers: list[tuple[str, Callable[[DataFrame, int], DataFrame]]]
    fusion: FusionMethod = reciprocal_ranks
    each: int = 50
    errors: dict[str, str] = field(default_factory=dict)
    texts: DataFrame | None = None

    def set_fusion(self, fusion: FusionMethod) -> None:
        self.fusion = fusion

    def _by_content(self, lists: list[DataFrame]) -> list[DataFrame]:
        first = self.texts.groupBy(F.xxhash64("content").alias("_content")).agg(F.min("id").alias("_first"))
        same = self.texts.select("id", F.xxhash64("content").alias("_content")).join(first, "_content").select("id", "_first")
        return [d.join(same, "id", "left").withColumn("id", F.coalesce("_first", "id")).drop("_first") for d in lists]

    def search(self, queries: DataFrame, top_k: int | None = 10) -> DataFrame:
        lists = []
        for name, find in self.retrievers:
            try:
                lists.append(find(queries, self.each))
            except Exception as e:  # any failure of one path leaves the others
                self.errors[name] = str(e)
        if not lists:
            return queries.select("query_id", F.lit(None).alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
        return self.fusion(lists if self.texts is None else self._by_content(lists), top_k)

    def add(self, name: str, find) -> None:
        self.retrievers.append((name, find))

    def remove(self, name: str) -> bool:
        at = next((i for i, (n, _) in enumerate(self.retrievers) if n == name), None)
        if at is not None:
            del self.retrievers[at]
        return at is not None


def scaled_store_score(hits: DataFrame, metric: str = "cosine") -> DataFrame:
    return hits.withColumn("score", vx.store_score(F.col("score"), metric))
