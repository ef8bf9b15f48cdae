import json
import re
import time

import pytest
from pyspark.sql import functions as F

from granary import runtime
from granary.functions import layout as ly
from granary.functions import prompts
from granary.functions import text as tx
from granary.operators import evaluate, graph, store
from granary.operators.components import connected_components
from granary.operators.skew import spread_join, unused
from granary.plans import pipelines
from granary.sources import readers, writers
from granary.streaming import tokens


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens(spark):
    text = " a b　c\td "
    assert one(spark, text, lambda c: tx.tokens(c, "unicode")) == text.split()
    assert one(spark, "a b", lambda c: tx.tokens(c, "char")) == ["a", " ", "b"]
    assert one(spark, " 　x\n ", tx.strip) == "x" and one(spark, None, tx.clean) == "" and one(spark, "a \n b", tx.clean) == "a b"


def test_text_helpers(spark):
    assert one(spark, "a+b:(c)", tx.query_safe) == "a b  c" and one(spark, "()", tx.query_safe) is None
    rules = {r"(\w+) cat": r"\1 dog", "a": "z"}
    assert one(spark, "a cat, b cat", lambda c: tx.rewrite(c, rules)) == "a dog, b dog"
    assert one(spark, "xyz", lambda c: tx.rewrite(c, rules)) == "xyz"
    assert one(spark, "a cat", lambda c: tx.decompose(c, rules)) == ["a dog", "z czt"] and one(spark, "xyz", lambda c: tx.decompose(c, rules)) == ["xyz"]
    assert one(spark, "assistant:  hi \n", tx.answer_only) == "hi" and one(spark, "```json\n{}\n```", tx.without_fences) == "{}"
    assert one(spark, " ", lambda c: tx.valid_input(c, 5)) is False and one(spark, "ok", lambda c: tx.valid_input(c, 5)) is True


@pytest.mark.parametrize("text,want", [("$$x+1$$", "$$\nx+1\n$$"), ("\\[ y \\]", "$$\ny\n$$"), ("a $b$ c", "a $b$ c"), ("plain", "plain"), ("\\frac{1}{2}", "$$\n\\frac{1}{2}\n$$"), ("\\usepackage{x}\\alpha", "$$\n\\alpha\n$$"), ("`\\beta`", "$$\n\\beta\n$$"), ("see \\[x\\] there", "see \\[x\\] there")])
def test_formula(spark, text, want):
    assert one(spark, text, tx.formula) == want


def test_spaced_formulas(spark):
    assert one(spark, "a $$x$$ b $$\ny\n$$", tx.spaced_formulas) == "a $$\nx\n$$ b $$\ny\n$$"


def test_chunks(spark):
    got = one(spark, " ".join(map(str, range(10))), lambda c: tx.chunks(tx.tokens(c), 4, 1))
    assert [r["text"] for r in got] == ["0 1 2 3", "3 4 5 6", "6 7 8 9"]
    assert one(spark, "", lambda c: tx.chunks(tx.tokens(c), 4, 1)) is None
    with pytest.raises(ValueError):
        tx.chunks(F.col("x"), 4, 4)


def python_entities(text):
    name, arrow = r"(\w+(?:\s+\w+)*)", r"\s*->\s*"
    found = re.findall(f"^{name}{arrow}([a-zA-Z\\s]+?){arrow}{name}$", text, re.M | re.I)
    return {x for s, _, o in found for x in (s, o)}


@pytest.mark.parametrize("text", ["A b -> likes -> C", "X -> rel_1 -> Y", "a -> b -> c -> d", "Zoë -> knows\nof -> Ünal\nx -> y -> z", ""])
def test_entities(spark, text):
    assert set(one(spark, text, tx.entities)) == python_entities(text)


@pytest.mark.parametrize("h,w,want", [(28, 28, (56, 56)), (10, 4000, None), (1000, 700, (1008, 700)), (8000, 8000, (3360, 3360)), (14, 14, (56, 56)), (42, 70, (56, 56))])
def test_smart_resize(spark, h, w, want):
    r = spark.range(1).select(ly.smart_resize(F.lit(h), F.lit(w)).alias("s")).first()["s"]
    assert (None if r is None else (r["height"], r["width"])) == want


def cells(spark, raw, how=ly.cleaned):
    return [(c["bbox"], c["category"], c["text"]) for c in one(spark, raw, how)]


def test_layout_repair(spark):
    a, b = '{"bbox":[1,2,3,4],"category":"Text","text":"a"}', '{"bbox":[5,6,7,8],"category":"Title","text":"b"}'
    first, second = ([1, 2, 3, 4], "Text", "a"), ([5, 6, 7, 8], "Title", "b")
    assert cells(spark, f"[{a},{b}]") == [first, second]
    assert cells(spark, f"[{a},{b},{a}") == [first, second]
    assert cells(spark, f"{a},{b}]") == [first, second]
    assert cells(spark, f'[{a},{b},{{"bbox":[9,') == [first, second]
    assert cells(spark, '[{"bbox":[1,2,3,4],"text":"open') == [([1, 2, 3, 4], "Text", "open]")]  # the bracket that closes the list is part of what is left
    assert cells(spark, "no cells") == []
    assert one(spark, f"[{a}]", ly.output_text)["filtered"] is False
    bad = one(spark, f"[{a},{b}", ly.output_text)
    assert bad["filtered"] is True and bad["cells"] is None


def test_usable_and_repeats(spark):
    rows = [([1, 2, 3], "Text", "x"), ([1, 2, 3, 4], "Text", "y"), ([1], "Text", "z"), (None, "Title", None), (None, None, "w")]
    got = one(spark, rows, ly.usable, ly.CELL)
    assert [(c["bbox"], c["category"], c["text"]) for c in got] == [(None, "Text", "x"), ([1, 2, 3, 4], "Text", "y"), (None, "Title", None)]
    for n, want in ((5, 1), (4, 4)):
        assert len(one(spark, [([i, 0, 9, 9], "T", "same") for i in range(n)], ly.without_repeats, ly.CELL)) == want
    assert len(one(spark, [([1, 1, 2, 2], "T", "a"), ([1, 1, 2, 2], "T", "b")], ly.without_repeats, ly.CELL)) == 1


def test_layout_boxes(spark):
    r = spark.range(1).select(
        ly.flipped(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), F.lit(10)).alias("f"),
        ly.to_input(F.array(F.lit(100), F.lit(100), F.lit(200), F.lit(300)), F.lit(1000), F.lit(700), F.lit(500), F.lit(350)).alias("i"),
        ly.picture_text(F.array(F.lit(0), F.lit(0), F.lit(100), F.lit(100)), F.lit("t")).alias("small"),
    ).first()
    assert r["f"] == [1, 6, 3, 8] and r["small"] == "" and len(r["i"]) == 4
    c = [([0, 0, 1, 1], "Page-header", "h"), ([0, 0, 1, 1], "Text", " a  b "), ([0, 0, 1, 1], "Formula", "\\x"), ([0, 0, 1, 1], "Picture", None)]
    assert one(spark, c, lambda x: ly.to_markdown(x, headers=False), ly.CELL) == "a b\n\n$$\n\\x\n$$\n\n![]()"
    assert one(spark, c, ly.legal, ly.CELL) is True


def test_parse_triples(spark):
    e = '"entities":[{"entity_name":"a","entity_type":"t","entity_description":"d"}]'
    ok = one(spark, 'x {%s,"relationships":[{"source_entity":"a","target_entity":"b","relation":"r","relationship_description":"d"}]} y' % e, graph.parse_triples)
    assert len(ok["entities"]) == 1 and ok["relationships"][0]["relation"] == "r"
    part = one(spark, '{%s,"relationships":[{"source_entity":"a"}]}' % e, graph.parse_triples)
    assert len(part["entities"]) == 1 and part["relationships"] == []
    assert one(spark, "none", graph.parse_triples)["entities"] == [] and one(spark, "{broken", graph.parse_triples)["entities"] == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_the_join(spark, how):
    big = spark.createDataFrame([(0 if i % 3 else i % 7, i, "x") for i in range(400)] + [(None, 999, "x")], "k int, v int, salt string")
    small = spark.createDataFrame([(k, f"s{k}") for k in range(6)], "k int, name string")
    rows = big.groupBy("k").count()
    got = spread_join(big, small, ["k"], rows, "count", 401, ["v"], how, least=20)
    assert sorted(map(str, got.collect())) == sorted(map(str, big.join(small, ["k"], how).collect()))
    assert "Generate" in got._jdf.queryExecution().toString()


def test_predictions_and_crops(spark):
    cell = '[{"bbox": [0, 0, 10, 10], "category": "Text", "text": "a"} {"bbox": [0, 20, 10, 30], "category": "Text", "text": "b"}]'
    got = ly.cleaned_predictions(spark.createDataFrame([(1, cell), (2, None)], "id int, predict string")).orderBy("id").collect()
    assert [c["text"] for c in got[0]["predict_resized"]] == ["a", "b"] and got[0]["predict"] == cell
    row = spark.createDataFrame([([100.0, 50.0, 300.0, 150.0],)], "b array<double>")
    assert row.select(ly.crop_points(F.col("b"), F.lit(1000), F.lit(500), F.lit(500), F.lit(1000))).first()[0] == [50.0, 100.0, 150.0, 300.0]


def test_unused_names():
    assert unused(["a", "_A", "n"], "a", "N", "x") == ["__a", "_N", "x"]


def test_components_of_a_hub(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(i, i + 1000) for i in range(1, 400, 7)] + [(5000, 5001), (5001, 5002)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(edges, runtime.Scratch(spark)).collect()}
    assert {c for n, c in got.items() if n < 5000} == {0} and {c for n, c in got.items() if n >= 5000} == {5000} and len(got) == 460


def test_simple_graph_and_components(spark):
    t = spark.createDataFrame([("a", "b", "r1", "d1", 1), ("b", "a", "r2", "d2", 2), ("c", "c", "self", "d", 3), ("d", "e", "x", "y", 4), ("e", "f", "x", "y", 5)], "src string, dst string, relation string, description string, seq long")
    g = graph.simple_graph(t)
    assert g.filter("a = 'a'").collect()[0]["relation"] == "r2" and g.count() == 4
    member = spark.createDataFrame([("a", 1), ("c", 1)], "node string, community long")
    assert sorted(r["detail"] for r in graph.community_details(g, member).collect()) == ["a -> b -> r2 -> d2", "c -> c -> self -> d"]
    got = {r["node"]: r["component"] for r in connected_components(g, runtime.Scratch(spark), "a", "b").collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", "f": "d"}
    path = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["component"] for r in connected_components(path, runtime.Scratch(spark)).collect()} == {0}


def test_communities_nest(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(6) for j in range(i)] + [("a0", "b0")]
    e = spark.createDataFrame([(min(p), max(p), "r", "d") for p in pairs], "a string, b string, relation string, description string")
    rows = graph.communities(e, runtime.Scratch(spark), max_size=6).collect()
    final = [r for r in rows if r["final"]]
    assert len({r["node"] for r in final}) == len(final) == 12
    by = {}
    for r in final:
        by.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, by.values())) == [[f"{g}{i}" for i in range(6)] for g in "ab"]
    assert {r["parent"] for r in final} <= {r["community"] for r in rows}


def test_communities_stop_when_nothing_moves(spark):
    """Stars settle in few rounds; the rest, which can't change anything, is left out."""
    rounds = []

    class Counted(runtime.Scratch):
        def table(self, df, name="t", *a, **b):
            rounds.append(name)
            return super().table(df, name, *a, **b)

    e = spark.createDataFrame([(f"a{i}", f"b{i % 2}", "r", "d") for i in range(20)] + [("b0", "b1", "r", "d")], "a string, b string, relation string, description string")
    rows = graph.communities(e, Counted(spark), max_size=12, levels=1).collect()
    by = {}
    for r in rows:
        if r["final"]:
            by.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, by.values())) == [sorted([f"b{k}", *[f"a{i}" for i in range(k, 20, 2)]]) for k in (0, 1)]
    assert rounds.count("labels") < 8


def test_named_entity(spark):
    q = spark.createDataFrame([(1, "in New York now"), (2, "yorkshire"), (3, "nothing")], "query_id int, query string")
    n = spark.createDataFrame([("New York", 2), ("York", 1)], "name string, seq int")
    assert {r["query_id"]: r["name"] for r in graph.named_entity(q, n).collect()} == {1: "York", 2: "York", 3: None}


def test_named_entity_of_names_with_one_first_word(spark):
    """Names that share their first word don't meet every query, and names may begin with any character."""
    names = spark.range(20_000).select(F.format_string("Shop#%06d", "id").alias("name"), F.col("id").alias("seq")).union(spark.createDataFrame([("#x Y", -1), ("shop#000007", 7)], "name string, seq long"))
    q = spark.range(20_000).select(F.col("id").alias("query_id"), F.format_string("by shop#%06d now", "id").alias("query"))
    q = q.union(spark.createDataFrame([(-1, "see #X y"), (-2, None)], "query_id long, query string"))
    began = time.time()
    got = {r["query_id"]: r["name"] for r in graph.named_entity(q, names).collect()}
    assert time.time() - began < 60
    assert got == {i: f"Shop#{i:06d}" for i in range(20_000)} | {7: got[7], -1: "#x Y", -2: None} and got[7].lower() == "shop#000007"


def test_layout_repair_is_spread(spark, tmp_path):
    """Rows of one small file are repaired by several tasks."""
    from granary.plans import knowledge

    p = spark.range(50_000).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"), F.lit(3).alias("p_size"))
    p.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = knowledge.layout_repair(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 3
    assert [tuple(r) for r in out.filter("p_partkey = 7").collect()] == [(7, 2, "n|b")]


def test_store(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", {"x": "1", "y": "2"}), (2, "b", None)], "id long, text string, metadata map<string,string>")
    new = spark.createDataFrame([(2, "c", {"z": "3"}), (1, "d", {"x": "9"})], "id long, text string, metadata map<string,string>")
    assert {r["text"] for r in store.upsert(d, new).collect()} == {"c", "d"}
    twice = store.upsert(store.upsert(d, new), new)
    assert sorted(r["text"] for r in twice.collect()) == ["c", "d"]
    assert {r["id"]: r["metadata"] for r in store.merge_properties(d, new).collect()} == {1: {"x": "9", "y": "2"}, 2: {"z": "3"}}
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "id long")
    kept, ok = store.delete_all_or_none(d, ids(1, 7))
    assert not ok and kept.count() == 2
    assert store.delete_all_or_none(d, ids(1))[0].count() == 1 and store.delete_all_or_none(d, ids())[1]
    assert store.delete_ids(d, ids(1, 7)).count() == 1
    want = spark.createDataFrame([(0, 2), (1, 1), (2, 5), (3, 2)], "pos int, id long")
    assert [r["id"] for r in store.get_in_order(d, want).collect()] == [2, 1, 2]
    assert store.scroll(d, ids=[1, 2, 3], limit=1).count() == 1 and store.with_ids(d.withColumn("id", F.lit(None).cast("string"))).filter("id IS NULL").count() == 0
    store.save(d, f"{tmp_path}/s", {"k": 1})
    back, config = store.load(spark, f"{tmp_path}/s")
    assert back.count() == 2 and config == {"k": 1} and store.exists(spark, f"{tmp_path}/s") and not store.exists(spark, f"{tmp_path}/t")


def test_readers(spark, tmp_path):
    qa = [{"_id": "1", "type": "c", "question": "q", "answer": "a", "context": [["T", ["s1", "s2"]], ["U", ["s1", "s2"]]], "supporting_facts": [["T", 0]]}]
    (tmp_path / "qa.json").write_text(json.dumps(qa))
    rows = readers.qa_rows(spark, f"{tmp_path}/qa.json")
    r = rows.first()
    assert r["evidence"][0]["idx"] == 0 and r["context"][1]["title"] == "U"
    p = readers.passages(rows.withColumn("seq", F.lit(1))).collect()
    assert [(x["title"], x["text"]) for x in p] == [("U", "s1\ns2")]
    html = '<html><body><p>before</p><article><p>lost</p><h2>One <b>x</b></h2><p> a </p><pre> c </pre><img src="u/My_pic.png"><figcaption>Cap</figcaption><h3>Empty</h3><h4>Two</h4><span>b</span></article><p>after</p></body></html>'
    got = readers.split_html(html)
    assert [(s["header"], s["content"]) for s in got] == [("One x", "a\n```c```\n"), ("Two", "b\n")] and got[0]["images"] == ["u/My_pic.png"]
    assert readers.split_html("<p>x</p>") == [] and readers.split_html(None) == []
    assert readers.split_html('<section data-field="body" class="e-content"><h1>H</h1><p>t</p></section>', "section", {"data-field": "body", "class": "e-content"})[0]["header"] == "H"
    (tmp_path / "h" / "sub").mkdir(parents=True)
    (tmp_path / "h" / "sub" / "x.html").write_text(html)
    assert readers.html_files(spark, f"{tmp_path}/h").first()["source"] == "x.html"
    (tmp_path / "My_pic.png").write_bytes(b"1")
    meta = spark.createDataFrame([("My_pic", "c", "u"), ("other", "c", "u")], "file_name string, caption string, image_url string")
    assert readers.existing_images(spark, meta, str(tmp_path)).count() == 1
    c = spark.createDataFrame([(" ", "http://x/a_b.png"), ("cap", "y")], "f string, u string").select(readers.caption(F.col("f"), F.col("u")).alias("c")).collect()
    assert [x["c"] for x in c] == ["a b", "cap"]
    pages = spark.range(5).select(F.col("id").alias("page_no"))
    assert readers.page_slice(pages, 1, 2).count() == 2 and readers.page_slice(pages, 3, -1).count() == 2


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([("f", 1, 10, 20, False, "md"), ("f", 0, 10, 20, False, "md")], "file string, page_no int, input_height int, input_width int, filtered boolean, md string")
    m = writers.page_outputs(d, str(tmp_path))
    assert m.count() == 2 and spark.read.json(f"{tmp_path}/pages").count() == 2
    path = writers.results(d, str(tmp_path), "set", "naive", 2)
    assert path.endswith("set/naive/set_2.json") and spark.read.json(path).count() == 2


def test_scores(spark):
    d = spark.createDataFrame([("The Answer", "answer"), ("x", ""), ("x", "y")], "answer string, ground_truth string")
    assert evaluate.containment(d).first()["score"] == pytest.approx(2 / 3)
    assert evaluate.containment(d.limit(0)).first()["score"] is None
    rows = spark.createDataFrame([(0, 0, "text", "a"), (0, 1, "image", "b")], "page_idx int, index int, type string, text string")
    found = spark.createDataFrame([(0, 0, 1, "old"), (0, 0, 2, "new"), (0, 1, 1, "no")], "page_idx int, index int, seq int, result string")
    assert {r["text"] for r in evaluate.update_text(rows, found).collect()} == {"new", "b"}


def test_streams(spark, tmp_path):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "message int, seq int, delta string")
    assert sorted(r["content"] for r in tokens.cumulative(d).collect()) == ["a", "ab", "c"]
    f = spark.createDataFrame([(1, 0, 1, "f", '{"a'), (1, 0, 2, None, '":1}')], "message int, index int, seq int, name string, arguments string")
    assert tuple(tokens.tool_calls(f).first())[2:] == ("f", '{"a":1}')
    schema = "id long, text string"
    for n in (1, 2):
        spark.createDataFrame([(1, f"v{n}"), (10 + n, "x")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = tokens.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check")
        q.awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/out/version=1")
    assert {(r["id"], r["text"]) for r in last.collect()} == {(1, "v2"), (11, "x"), (12, "x")}


def test_prompts_and_pipelines(spark):
    assert spark.range(1).select(prompts.render("answer", context="c", query="q")).first()[0].endswith("Question: q")
    docs = spark.createDataFrame([(1, "paris is in france"), (2, "berlin is in germany")], "id long, content string")
    q = spark.createDataFrame([(1, "where is paris")], "query_id int, query string")
    got = pipelines.dense_answers(spark, docs, q, 1).first()
    assert got["evidence"] == ["paris is in france"] and got["answer"] == "Question: where is paris"
    images = spark.createDataFrame([("p.png", "paris"), ("b.png", "berlin")], "path string, caption string")
    assert pipelines.with_images(spark, pipelines.dense_answers(spark, docs, q, 1), images, q, 1).first()["evidence"] == ["paris is in france", "p.png"]
    reply = '{"entities":[{"entity_name":"a","entity_type":"t","entity_description":"d"}],"relationships":[{"source_entity":"a","target_entity":"b","relation":"knows","relationship_description":"d"}]}'
    es, ts = pipelines.extract(docs, lambda p: p.map(lambda _: reply))
    assert es.count() == 1 and ts.count() == 2
    index = pipelines.community_index(ts, runtime.Scratch(spark))
    hits = spark.createDataFrame([(1, "a -> knows -> b")], "query_id int, text string")
    assert pipelines.community_answers(index, hits, q).count() == 1
    assert pipelines.scored(pipelines.dense_answers(spark, docs, q, 1), spark.createDataFrame([(1, "PARIS")], "query_id int, ground_truth string")).first()["score"] == 1
    assert pipelines.local_context(es, index["edges"], q, spark, 1).count() == 1
