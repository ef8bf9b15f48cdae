import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import vectors as vx
from granary.operators import dense, fusion, lexical, models
from granary.operators.filters import Group, Where, check_search, condition, scoped
from granary.operators.registry import Registry, defaults
from granary.plans import factory


def lists(spark, *ranked):
    return [spark.createDataFrame([(1, k, i + 1) for i, k in enumerate(r)], "query_id int, id string, rank int") for r in ranked]


def scores(df):
    return {r["id"]: r["score"] for r in df.collect()}


def test_reciprocal_ranks(spark):
    got = scores(fusion.reciprocal_ranks(lists(spark, "ab", "bc")))
    assert got == pytest.approx({"b": 1 / 62 + 1 / 61, "a": 1 / 61, "c": 1 / 62})
    assert scores(fusion.reciprocal_ranks(lists(spark, "aa"))) == pytest.approx({"a": 1 / 61 + 1 / 62})
    assert fusion.reciprocal_ranks(lists(spark, "abc", "cde"), None).count() == 5
    assert fusion.reciprocal_ranks(lists(spark, "abc", "cde"), 2).count() == 2
    one, two = fusion.reciprocal_ranks(lists(spark, "abc", "cde")), fusion.reciprocal_ranks(lists(spark, "cde", "abc"))
    assert scores(one) == pytest.approx(scores(two))


def test_relative_scores(spark):
    d = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0)], "query_id int, id string, score double")
    s = spark.createDataFrame([(1, "b", 10.0), (1, "c", 5.0)], "query_id int, id string, score double")
    assert scores(fusion.relative_scores(d, s, 0.25)) == pytest.approx({"a": 0.25, "b": 0.75, "c": 0.0})
    assert scores(fusion.relative_scores(d, s, 0.0)) == pytest.approx({"a": 0.0, "b": 1.0, "c": 0.0})
    assert scores(fusion.relative_scores(d, s)) == pytest.approx({"a": 0.5, "b": 0.5, "c": 0.0})
    assert scores(fusion.best_of_branches(d, s, 5)) == pytest.approx({"a": 1.0, "b": 1.0, "c": 0.5})


def test_multipath_survives_a_failing_path(spark):
    q = spark.createDataFrame([(1, "x")], "query_id int, query string")

    def broken(*_):
        raise ValueError("no index")

    m = fusion.MultiPath([("bad", broken), ("good", lambda q, k: lists(spark, "ab")[0])])
    assert m.search(q, 1).count() == 1 and m.errors == {"bad": "no index"}
    assert m.remove("good") and not m.remove("good") and m.search(q).count() == 0
    m.add("good", lambda q, k: lists(spark, "ab")[0])
    assert m.search(q, None).count() == 2


def test_multipath_by_content(spark):
    q = spark.createDataFrame([(1, "x")], "query_id int, query string")
    texts = spark.createDataFrame([("a", "same"), ("b", "same"), ("c", "other")], "id string, content string")
    m = fusion.MultiPath([("one", lambda q, k: lists(spark, "ac")[0]), ("two", lambda q, k: lists(spark, "cb")[0])], texts=texts)
    assert scores(m.search(q)) == pytest.approx({"a": 1 / 61 + 1 / 62, "c": 1 / 61 + 1 / 62})
    m.set_fusion(lambda found, k: found[0].withColumn("score", F.lit(0.5)))
    assert scores(m.search(q)) == {"a": 0.5, "c": 0.5}


def test_run_from_a_configuration(spark, tmp_path):
    (tmp_path / "docs.json").write_text('[{"id": 1, "content": "the cat sat on the mat"}, {"id": 2, "content": "rivers run to the sea"}, {"id": 3, "content": "stars are far away"}]')
    (tmp_path / "queries.json").write_text('[{"query_id": 1, "query": "where do rivers run"}]')
    (tmp_path / "run.yaml").write_text(f"dataset: {{path: {tmp_path}/docs.json, queries: {tmp_path}/queries.json}}\nrag: {{top_k: 1}}\n")
    path = str(tmp_path / "run.yaml")
    for store in ("flat", "bm25"):
        got = factory.run(spark, path, [f"storage.type={store}", "rag.chunk=false"]).collect()
        assert [r["query_id"] for r in got] == [1] and got[0]["evidence"] == ["rivers run to the sea"]
    assert [r["query_id"] for r in factory.run(spark, path, ["rag.solution=community"]).collect()] == [1]
    assert factory.read_config(path, ["rag.top_k=3"])["rag"]["top_k"] == 3
    (tmp_path / "run.ini").write_text("")
    for bad in (lambda: factory.read_config(str(tmp_path / "run.ini")), lambda: factory.read_config(path, ["rag.x=1"]), lambda: factory.run(spark, path, ["rag.solution=x"]), lambda: factory.run(spark, path, ["storage.type=x"])):
        with pytest.raises(ValueError):
            bad()


def test_bm25_against_formula(spark):
    texts = ["the cat sat", "the dog", "a cat and a dog and the bird", "fish"]
    index = lexical.from_texts(spark, texts, ids=[1, 2, 3, 4])
    tok = [t.split() for t in texts]
    n, avg = len(tok), np.mean([len(t) for t in tok])
    vocabulary = {w for t in tok for w in t}
    df = {w: sum(w in t for t in tok) for w in vocabulary}
    idf = {w: np.log(n - df[w] + 0.5) - np.log(df[w] + 0.5) for w in vocabulary}
    mean = np.mean(list(idf.values()))
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    score = lambda q, t: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in q.split())
    q = spark.createDataFrame([(1, "cat cat the"), (2, "nothing here")], "query_id int, query string")
    got = {(r["query_id"], r["id"]): r["score"] for r in index.search(q, 4).collect()}
    assert got == pytest.approx({(i, d + 1): score(t, tok[d]) for i, t in ((1, "cat cat the"), (2, "nothing here")) for d in range(4)})
    assert [r["id"] for r in index.search(q, 2).filter("query_id = 2").orderBy("rank").collect()] == [1, 2]
    assert index.all_scores(q).count() == 8
    index.update_k(3)
    assert index.search(q).count() == 6 and index.info().first()["k"] == 3
    less, hit = index.without(spark.createDataFrame([(4,), (9,)], "id long"))
    assert hit and less.docs.count() == 3 and less.added(index.docs.filter("id = 4")).docs.count() == 4
    assert index.info().first()["vocab_size"] == len(vocabulary)
    for bad in (lambda: lexical.from_texts(spark, []), lambda: lexical.from_texts(spark, ["a"], ids=[1, 2]), lambda: lexical.Bm25(index.docs, k=0)):
        with pytest.raises(ValueError):
            bad()
    chars = lexical.from_texts(spark, ["ab", "cd", "ef"], ids=[1, 2, 3], tokenizer="char")
    assert chars.search(spark.createDataFrame([(1, "dx")], "query_id int, query string"), 1).first()["id"] == 2


def test_bm25_scores_where_documents_are(spark, monkeypatch):
    """No task groups the words of a share of the corpus, and no (query, document) pair is grouped after a shuffle."""
    plans, table = [], lexical.Scratch.table

    def seen(self, df, *a, **b):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table(self, df, *a, **b)

    monkeypatch.setattr(lexical.Scratch, "table", seen)
    d = spark.createDataFrame([(i % 200, f"w{i % 7} w{i % 11} w{i} \n w{i % 7}") for i in range(200)], "id long, content string").repartition(3)
    q = spark.createDataFrame([(i, f"w{i} w{i + 1} w3 w3") for i in range(20)], "query_id int, query string")
    hits = lexical.Bm25(d).search(q, 4)
    plans.append(hits._jdf.queryExecution().executedPlan().toString())
    assert hits.count() == 80 and not any(re.search(r"Aggregate\(keys=\[(?=[^\]]*,)[^\]]*\bid#", p) for p in plans)
    every = {(r["query_id"], r["id"]): r["score"] for r in lexical.Bm25(d).all_scores(q).collect()}
    want = {i: sorted(((-every[i, j], j) for j in range(200)))[:4] for i in range(20)}
    got = {i: [(-r["score"], r["id"]) for r in sorted(hits.filter(F.col("query_id") == i).collect(), key=lambda r: r["rank"])] for i in range(20)}
    assert got == want


def test_bm25_of_odd_rows(spark):
    """Rows of one id are one document, scores below 0 stand after documents without a shared term, texts may be null."""
    d = spark.createDataFrame([(1, "x z"), (2, "x z"), (3, "x z"), (4, "x z"), (5, "y")], "id long, content string")
    q = spark.createDataFrame([(1, "x"), (2, "none")], "query_id int, query string")
    top = {r["query_id"]: (r["id"], r["score"]) for r in lexical.Bm25(d).search(q, 1).collect()}
    assert top == {1: (5, 0.0), 2: (1, 0.0)}
    twice = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, "c"), (None, "a"), (3, None), (4, "")], "id long, content string")
    index = lexical.Bm25(twice)
    rows = sorted(((r["id"] or 0, r["term"], r["tf"], r["dl"]) for r in index.postings.collect()))
    assert rows == [(0, "a", 1, 1), (1, "a", 1, 2), (1, "b", 2, 2), (1, "c", 1, 2), (2, "c", 1, 1)]
    assert lexical.Bm25(twice.limit(0)).search(q, 2).count() == 0 and index.search(q, 9).count() == 10


def test_search_makes_vectors_once(spark):
    """A model that makes the vectors searched runs once a text, also where some don't fit."""
    d = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "id long, t string")
    v = d.select("id", F.when(F.col("id") < 3, models.embedded(F.col("t"), models.hash_embedder(8))).alias("vector"))
    q = d.filter("id = 2").select(F.col("id").alias("query_id"), models.embedded(F.col("t"), models.hash_embedder(8)).alias("vector"))
    hits = dense.search(spark, v, q, 5)
    assert hits._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r["id"] for r in hits.orderBy("rank").collect()] == [2, 1]


def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(5)]) for i in range(60)] + [(60, [0.0] * 5), (61, None), (62, [1.0])]
    return spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)


def test_search_in_passes(spark):
    v = vectors(spark)
    q = v.filter("id < 7").select(F.col("id").alias("query_id"), "vector")
    for metric in dense.METRICS:
        one = sorted(map(tuple, dense.search(spark, v, q, 5, metric).collect()))
        two = sorted(map(tuple, dense.search(spark, v, q, 5, metric, at_once=2).collect()))
        assert [r[:2] for r in one] == [r[:2] for r in two] and len(one) == 35
    top = dense.search(spark, v, q, 1, "cosine").collect()
    assert all(r["id"] == r["query_id"] and r["score"] == pytest.approx(1) for r in top)
    expr = v.filter("id < 61").crossJoin(q.filter("query_id = 3").select(F.col("vector").alias("q"))).select("id", vx.squared_l2(F.col("vector"), F.col("q")).alias("d"))
    assert [r["id"] for r in expr.orderBy("d", "id").limit(4).collect()] == [r["id"] for r in dense.search(spark, v, q, 4, "l2").filter("query_id = 3").orderBy("rank").collect()]
    assert dense.search(spark, v, q.limit(0)).collect() == []
    with pytest.raises(ValueError):
        dense.search(spark, v, q, 3, "hamming")


def test_threshold_and_types(spark):
    v = vectors(spark)
    q = v.filter("id < 3").select(F.col("id").alias("query_id"), "vector")
    few = dense.retrieve(spark, v, q, "similarity_score_threshold", 10, score_threshold=0.9)
    more = dense.retrieve(spark, v, q, "similarity_score_threshold", 10, score_threshold=0.1)
    assert 3 <= few.count() <= more.count()
    odd = dense.with_relevance(dense.search(spark, v, q, 10), "cosine", 0.9, compat=True)
    assert odd.filter("score > 0.2").count() == 0
    for bad in (("similarity_score_threshold", None), ("similarity_score_threshold", 2.0), ("other", None)):
        with pytest.raises(ValueError):
            dense.retrieve(spark, v, q, bad[0], score_threshold=bad[1])


def test_marginal_relevance(spark):
    v = vectors(spark).filter("id < 60")
    q = spark.createDataFrame([(1, [1.0, 0.5, 0.0, -0.5, 0.2])], "query_id int, vector array<double>")
    near = [r["id"] for r in dense.search(spark, v, q, 8).orderBy("rank").collect()]
    order = lambda **k: [r["id"] for r in dense.marginal_relevance(spark, v, q, **k).orderBy("rank").collect()]
    assert order(k=8, fetch_k=8) == near and order(k=5, fetch_k=20, weight=1.0) == near[:5]
    assert order(k=4, fetch_k=20)[0] == near[0]
    held = {r["id"]: np.array(r["vector"], float) for r in v.collect()}
    unit = {i: x / np.linalg.norm(x) for i, x in held.items()}
    target = np.array([1.0, 0.5, 0.0, -0.5, 0.2])
    target /= np.linalg.norm(target)
    pool = [r["id"] for r in dense.search(spark, v, q, 20).orderBy("rank").collect()]
    picked = [pool[0]]
    while len(picked) < 4:
        picked.append(max((i for i in pool if i not in picked), key=lambda i: 0.5 * unit[i] @ target - 0.5 * max(0.0, *(unit[i] @ unit[p] for p in picked))))
    assert order(k=4, fetch_k=20) == picked


def test_cells_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.filter("id < 20").select(F.col("id").alias("query_id"), "vector")
    want = {(r["query_id"], r["id"]) for r in dense.search(spark, e, q, 5, "ip").collect()}
    got = {(r["query_id"], r["id"]) for r in dense.search_cells(spark, e, q, 5, n=20, probes=12).collect()}
    assert len(got & want) / len(want) > 0.8
    tiny = e.filter("id < 5")
    assert dense.search_cells(spark, tiny, q.filter("query_id < 1"), 3).count() == 3


def test_filters(spark):
    d = spark.createDataFrame([(1, "en", 5, ["x"]), (2, "de", 9, []), (3, None, 7, None)], "id int, lang string, n int, tags array<string>")
    ids = lambda w: [r["id"] for r in d.filter(condition(w)).orderBy("id").collect()]
    assert ids(Where("lang", "en,de", "in")) == [1, 2] and ids(Where("lang", ["en"], "nin")) == [2] and ids(Where("lang", "en", "ne")) == [2]
    assert ids(Where("lang", None, "is_empty")) == [3] and ids(Where("tags", None, "is_empty_list")) == [2, 3]
    assert ids(Where("lang", "E", "text_match_insensitive")) == [1, 2] and ids(Where("lang", "E", "text_match")) == []
    a, b = Where("n", 6, ">"), Where("lang", "de")
    assert ids(Group((Group((a, b), "or"),), "not")) == ids(Group((Group((a,), "not"), Group((b,), "not"))))
    assert ids(Group()) == [1, 2, 3] and ids(None) == [1, 2, 3]
    assert [r["id"] for r in d.filter(scoped(ids=[1, 3], where=a)).collect()] == [3]
    for bad in (Where("n", 1, "all"), Group((a,), "xor")):
        with pytest.raises(ValueError):
            condition(bad)
    with pytest.raises(ValueError):
        check_search(True, a)


def test_filters_reach_the_scan(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(condition(Group((Where("lang", "en"), Where("n_chars", 100, ">"))))).select("doc_id")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "GreaterThan(n_chars,100)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_models(spark):
    d = spark.createDataFrame([("a b\nc",), (None,), ("",)], "t string")
    v = d.select(models.embedded(F.col("t"), models.hash_embedder(8)).alias("v"), models.chat(F.col("t")).alias("r")).collect()
    assert np.linalg.norm(v[0]["v"]) == pytest.approx(1) and v[1]["v"] == [0.0] * 8 and v[0]["r"]["text"] == "c"

    def broken(_):
        raise RuntimeError("down")

    assert d.select(models.chat(F.col("t"), broken)["text"].alias("x")).filter("x IS NULL").count() == 3
    key = d.select(models.cache_key(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))).alias("k")).first()["k"]
    assert key == '{"a":"2","b":"1"}'
    assert spark.range(1).select(models.yes_probability(F.lit(2.0), F.lit(2.0))).first()[0] == 0.5


def test_cache_asks_once(spark):
    cache = spark.createDataFrame([("m", "t", "p", "old", 1), ("m", "t", "p", "new", 2), ("m", "u", "q", "other", 3)], "llm string, template string, prompt string, reply string, seq long")
    prompts = spark.createDataFrame([("p",), ("q",), ("q",)], "prompt string")
    replies, fresh = models.cached_replies(prompts, cache, "m", "t")
    assert {tuple(r) for r in replies.collect()} == {("p", "new"), ("q", "q")} and fresh.count() == 1
    assert models.put(cache, fresh).filter("seq = 4").count() == 1


def test_registry():
    r = Registry("thing")
    r.register("A", dict)
    assert r.create("a", x=1) == {"x": 1} and r.is_registered("A") and r.names() == ["a"]
    with pytest.raises(ValueError):
        r.register("a", dict)
    with pytest.raises(TypeError):
        r.register("b", 3)
    assert r.unregister("a") and not r.unregister("a")
    with pytest.raises(ValueError):
        r.create("a")
    all_ = defaults()
    assert all_["retriever"].names() == ["bm25", "multipath", "vectorstore"]
    with pytest.raises(NotImplementedError):
        all_["llm"].create("openai")(None)
    all_["llm"].clear()
    assert all_["llm"].names() == []
