"""Retrieval queries over the driver's tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import vectors as vx
from granary.operators import dense, fusion
from granary.operators.filters import Group, Where, condition
from granary.operators.lexical import Bm25
from granary.operators.models import rerank
from granary.plans import pipelines
from granary.runtime import table

DIM = 64


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector a label: the largest value of each component among its vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.array(*[F.max(vx.doubles(F.col("embedding"))[i]) for i in range(DIM)]).alias("vector"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _six(hits: DataFrame, *extra: str) -> DataFrame:
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"), *extra)


def _search(metric: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(dense.search(spark, vectors(spark, sf_dir), label_queries(spark, sf_dir), 10, metric))


def vector_filtered(spark, sf_dir):
    where = Group((Where("label", [1, 3, 5], "in"), Group((Where("label", 7, ">"),))), "or")
    return _six(dense.search(spark, vectors(spark, sf_dir), label_queries(spark, sf_dir), 5, "cosine", where))


def vector_threshold(spark, sf_dir):
    hits = dense.retrieve(spark, vectors(spark, sf_dir), label_queries(spark, sf_dir), "similarity_score_threshold", 20, score_threshold=0.3)
    return _six(hits)


def vector_store_score(spark, sf_dir):
    hits = dense.search(spark, vectors(spark, sf_dir), label_queries(spark, sf_dir), 10, "cosine")
    return _six(fusion.scaled_store_score(hits))


def vector_mmr(spark, sf_dir):
    return dense.marginal_relevance(spark, vectors(spark, sf_dir), label_queries(spark, sf_dir), 4, 20, 0.5).select("query_id", "rank", "id")


def vector_cells(spark, sf_dir):
    return _six(dense.search_cells(spark, vectors(spark, sf_dir), label_queries(spark, sf_dir), 10))


def bm25_topk(spark, sf_dir):
    return _six(Bm25(corpus(spark, sf_dir)).search(questions(spark, sf_dir), 10))


def bm25_info(spark, sf_dir):
    return Bm25(corpus(spark, sf_dir)).info().select("document_count", "vocab_size", F.round("average_doc_length", 6).alias("average_doc_length"))


def both_queries(spark, sf_dir):
    """Each question with the vector of the label that its number picks."""
    q = questions(spark, sf_dir).withColumn("label", F.col("query_id") % 10)
    return q.join(label_queries(spark, sf_dir).withColumnRenamed("query_id", "label"), "label").select("query_id", "query", "vector")


def multipath_rrf(spark, sf_dir):
    own = vectors(spark, sf_dir).join(corpus(spark, sf_dir).select("id"), "id", "left_semi")
    return _six(pipelines.multi_path(spark, corpus(spark, sf_dir), own, both_queries(spark, sf_dir)))


def _branches(spark, sf_dir, k=20):
    q = both_queries(spark, sf_dir)
    return dense.search(spark, vectors(spark, sf_dir), q.select("query_id", "vector"), k), Bm25(corpus(spark, sf_dir)).search(q.select("query_id", "query"), k)


def hybrid_relative(spark, sf_dir):
    return _six(fusion.relative_scores(*_branches(spark, sf_dir), 0.3, 10))


def hybrid_best(spark, sf_dir):
    return _six(fusion.best_of_branches(*_branches(spark, sf_dir), 10))


def _sparse(v):
    return F.filter(F.transform(v, lambda x, i: F.struct(i.alias("index"), x.alias("value"))), lambda s: s["value"] > 0.1)


def sparse_topk(spark, sf_dir):
    d = vectors(spark, sf_dir).select("id", _sparse(F.col("vector")).alias("sparse"))
    q = label_queries(spark, sf_dir).select("query_id", _sparse(F.col("vector")).alias("sparse"))
    return _six(fusion.sparse_search(d, q, 10))


def sparse_idf_topk(spark, sf_dir):
    d = vectors(spark, sf_dir).select("id", _sparse(F.col("vector")).alias("sparse"))
    q = label_queries(spark, sf_dir).select("query_id", _sparse(F.col("vector")).alias("sparse"))
    return _six(fusion.sparse_search(d, q, 10, idf=True))


def rerank_overlap(spark, sf_dir):
    hits = Bm25(corpus(spark, sf_dir)).search(questions(spark, sf_dir), 10).join(questions(spark, sf_dir), "query_id").join(corpus(spark, sf_dir), "id")
    return rerank(hits, 5).select("query_id", F.col("new_rank").alias("rank"), "id", F.round("rerank_score", 6).alias("score"))


def filter_documents(spark, sf_dir):
    where = Group((Group((Where("lang", "en"), Where("n_chars", 2000, ">")), "and"), Group((Where("lang", "de,fr", "in"), Group((Where("source", ["src1", "src2"], "in"), Where("n_chars", 500, "<")), "not"))),), "or")
    return table(spark, sf_dir, "documents").filter(condition(where)).select("doc_id", "lang", "source", "n_chars")


def filter_events(spark, sf_dir):
    where = Group((Where("event_type", "click", "ne"), Where("value", 10.0, ">="), Group((Where("props", None, "is_empty"),), "not")))
    return table(spark, sf_dir, "events").filter(condition(where)).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_Q = f"""q AS (SELECT query_id, list(m ORDER BY i) AS v FROM (
  SELECT label::BIGINT AS query_id, i, max(embedding[i])::DOUBLE AS m FROM embeddings, unnest(range(1, {DIM + 1})) AS u(i) GROUP BY 1, 2) GROUP BY 1)"""
_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_COS = "list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v)))"


def _top(score: str, k: int, where: str = "true", desc: str = "DESC", out: str = "score", keep: str = "true") -> str:
    return f"""WITH {_Q}, {_E},
s AS (SELECT q.query_id, e.id, {score} AS score FROM q, e WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {desc}, id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, id, round({out}, 6) AS score FROM r WHERE rank <= {k} AND {keep}"""


_WORDS = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"
_BM25 = f"""d AS (SELECT doc_id AS id, {_WORDS.format("text")} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
tf AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY 1, 2),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
bq AS (SELECT query_id, term, count(*) AS n FROM (SELECT item_id AS query_id, unnest({_WORDS.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
bhit AS (SELECT bq.query_id, tf.id, round(sum(bq.n * idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * tf.dl / st.avgdl))), 9) AS score
  FROM bq JOIN tf USING (term) JOIN idf USING (term), st GROUP BY 1, 2),
ball AS (SELECT b.item_id AS query_id, d.id, coalesce(h.score, 0.0) AS score FROM benchmark b CROSS JOIN d LEFT JOIN bhit h ON h.query_id = b.item_id AND h.id = d.id),
btop AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ball)"""
_BOTH = f"""{_BM25}, {_Q}, {_E},
vq AS (SELECT item_id AS query_id, q.v FROM benchmark JOIN q ON q.query_id = item_id % 10)"""
_COSB = _COS.replace("q.v", "vq.v")


def _mmr() -> str:
    steps, picked = [], ["1"]
    base = f"""WITH {_Q}, {_E},
s AS (SELECT q.query_id, e.id, e.v, {_COS} AS score FROM q, e),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM s) WHERE rk <= 20),
sim AS (SELECT a.query_id, a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS m FROM c a JOIN c b USING (query_id)),
p1 AS (SELECT query_id, 1 AS rank, id FROM c WHERE rk = 1)"""
    for k in (2, 3, 4):
        seen = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, k))
        base += f""",
a{k} AS ({seen}),
g{k} AS (SELECT c.query_id, c.id, c.rk, 0.5 * any_value(c.score) - 0.5 * greatest(0, max(sim.m)) AS value
  FROM c JOIN a{k} p ON p.query_id = c.query_id JOIN sim ON sim.query_id = c.query_id AND sim.x = c.id AND sim.y = p.id
  WHERE NOT EXISTS (SELECT 1 FROM a{k} z WHERE z.query_id = c.query_id AND z.id = c.id) GROUP BY 1, 2, 3),
p{k} AS (SELECT query_id, {k} AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, rk) AS o FROM g{k}) WHERE o = 1)"""
    return base + "\n" + " UNION ALL ".join(f"SELECT query_id, rank::INT AS rank, id FROM p{i}" for i in (1, 2, 3, 4))


def _fuse(inner: str, k: int = 10) -> str:
    return f"""WITH {_BOTH},
{inner},
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)
SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM fr WHERE rank <= {k}"""


_DENSE = "vs AS (SELECT vq.query_id, e.id, {0} AS score FROM vq, e {1}), vtop AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs)"
_NORM = "CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE max(score) OVER w END"


def _sparse_sql(weight: str) -> str:
    return f"""WITH {_Q},
d AS (SELECT vec_id AS id, i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, {DIM + 1})) AS u(i) WHERE embedding[i] > 0.1::FLOAT OR embedding[i]::DOUBLE > 0.1),
dd AS (SELECT * FROM d WHERE x > 0.1),
qq AS (SELECT query_id, i, v[i] AS y FROM q, unnest(range(1, {DIM + 1})) AS u(i) WHERE v[i] > 0.1),
n AS (SELECT i, count(DISTINCT id) AS n FROM dd GROUP BY i),
t AS (SELECT count(*) AS total FROM embeddings),
s AS (SELECT query_id, id, sum(x * y * {weight}) AS score FROM dd JOIN qq USING (i) JOIN n USING (i), t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 10"""


QUERIES = {
    "vector_topk_cosine": partial(_search, "cosine"),
    "vector_topk_l2": partial(_search, "l2"),
    "vector_topk_ip": partial(_search, "ip"),
    "vector_filtered": vector_filtered,
    "vector_threshold": vector_threshold,
    "vector_store_score": vector_store_score,
    "vector_mmr": vector_mmr,
    "vector_cells": vector_cells,
    "bm25_topk": bm25_topk,
    "bm25_info": bm25_info,
    "multipath_rrf": multipath_rrf,
    "hybrid_relative": hybrid_relative,
    "hybrid_best": hybrid_best,
    "sparse_topk": sparse_topk,
    "sparse_idf_topk": sparse_idf_topk,
    "rerank_overlap": rerank_overlap,
    "filter_documents": filter_documents,
    "filter_events": filter_events,
}
SQL = {
    "vector_topk_cosine": _top(_COS, 10),
    "vector_topk_l2": _top("list_sum(list_transform(list_zip(e.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))", 10, desc="ASC"),
    "vector_topk_ip": _top("list_inner_product(e.v, q.v)", 10),
    "vector_filtered": _top(_COS, 5, "label IN (1, 3, 5) OR label > 7"),
    "vector_threshold": _top(_COS, 20, keep="score >= 0.3"),
    "vector_store_score": _top(_COS, 10, out="(1 + score) / 2"),
    "vector_mmr": _mmr(),
    "bm25_topk": f"WITH {_BM25} SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM btop WHERE rank <= 10",
    "bm25_info": f"WITH {_BM25} SELECT st.n AS document_count, (SELECT count(DISTINCT term) FROM tf) AS vocab_size, round(avgdl, 6) AS average_doc_length FROM st",
    "multipath_rrf": _fuse(_DENSE.format(_COSB, "WHERE e.id IN (SELECT doc_id FROM documents)") + """,
f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM btop WHERE rank <= 50 UNION ALL SELECT query_id, id, rank FROM vtop WHERE rank <= 50) GROUP BY 1, 2)"""),
    "hybrid_relative": _fuse(_DENSE.format(_COSB, "") + f""",
nd AS (SELECT query_id, id, {_NORM} AS d FROM (SELECT * FROM vtop WHERE rank <= 20) WINDOW w AS (PARTITION BY query_id)),
ns AS (SELECT query_id, id, {_NORM} AS s FROM (SELECT * FROM btop WHERE rank <= 20) WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, id, 0.3 * coalesce(d, 0) + 0.7 * coalesce(s, 0) AS score FROM nd FULL OUTER JOIN ns USING (query_id, id))"""),
    "hybrid_best": _fuse(_DENSE.format(_COSB, "") + """,
u AS (SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) AS score FROM vtop WHERE rank <= 20
  UNION SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) FROM btop WHERE rank <= 20),
f AS (SELECT query_id, id, max(score) AS score FROM u GROUP BY 1, 2)"""),
    "sparse_topk": _sparse_sql("1"),
    "sparse_idf_topk": _sparse_sql("ln((total - n + 0.5) / (n + 0.5) + 1)"),
    "rerank_overlap": f"""WITH {_BM25},
h AS (SELECT * FROM btop WHERE rank <= 10),
qw AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS term FROM benchmark),
dw AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '\\S+')) AS term FROM documents WHERE doc_id IN (SELECT id FROM h)),
sc AS (SELECT h.query_id, h.id, any_value(h.rank) AS old, count(dw.term)::DOUBLE / count(*) AS score
  FROM h JOIN qw USING (query_id) LEFT JOIN dw ON dw.id = h.id AND dw.term = qw.term GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank FROM sc)
SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "filter_documents": """SELECT doc_id, lang, source, n_chars FROM documents
WHERE coalesce((lang = 'en' AND n_chars > 2000) OR (lang IN ('de', 'fr') AND NOT (coalesce(source IN ('src1', 'src2'), false) OR coalesce(n_chars < 500, false))), false)""",
    "filter_events": "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_type <> 'click' AND value >= 10 AND props IS NOT NULL GROUP BY 1",
}
