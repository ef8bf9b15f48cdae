"""Graph, text, layout, store and evaluation queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import layout as ly
from granary.functions import text as tx
from granary.operators import evaluate, graph, models, store
from granary.operators.components import connected_components
from granary.plans import pipelines
from granary.runtime import Scratch, spread, table
from granary.sources import readers
from granary.streaming import tokens


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers in nations, nations in regions: (src, dst, relation, description, seq)."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    p = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    row = lambda d, a, b, rel, text, seq: d.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(rel).alias("relation"), text.alias("description"), seq.cast("long").alias("seq"))
    out = row(c, "c_name", "n_name", "lives in", F.col("c_mktsegment"), F.col("c_custkey"))
    out = out.unionByName(row(s, "n_name", "s_name", "hosts", F.lit("supplier"), F.col("s_suppkey")))
    return out.unionByName(row(p, "n_name", "r_name", "part of", F.lit("region"), F.col("n_nationkey")))


def edges(spark, sf_dir):
    return graph.simple_graph(triples(spark, sf_dir))


def members(spark, sf_dir):
    """A fixed membership: customers and nations belong to their nation's number, regions to 100 and theirs."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("node"), F.col("c_nationkey").cast("long").alias("community"))
    own = n.select(F.col("n_name").alias("node"), F.col("n_nationkey").cast("long").alias("community"))
    up = n.select(F.col("n_name").alias("node"), (F.col("n_regionkey") + 100).cast("long").alias("community"))
    return c.unionByName(own).unionByName(up)


def graph_details(spark, sf_dir):
    return graph.community_details(edges(spark, sf_dir), members(spark, sf_dir))


def graph_texts(spark, sf_dir):
    return graph.community_texts(graph_details(spark, sf_dir)).select("community", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def graph_entity_communities(spark, sf_dir):
    return graph.entity_communities(members(spark, sf_dir)).select("node", F.array_join("communities", ",").alias("communities"))


def graph_components(spark, sf_dir):
    return connected_components(edges(spark, sf_dir), Scratch(spark), "a", "b")


def graph_clusters(spark, sf_dir):
    return graph.communities(edges(spark, sf_dir), Scratch(spark), 50)


def graph_global(spark, sf_dir):
    """Communities of the entities named in edge lines, one query a region."""
    e = edges(spark, sf_dir).filter("relation = 'part of'")
    hits = e.select(F.when(F.col("b").rlike("^[A-Z ]+$") & F.col("a").rlike("^[A-Z ]+$"), F.greatest("a", "b")).alias("query_id"), F.concat_ws(" -> ", "a", "relation", "b").alias("text"))
    return graph.communities_of(graph.entities_in_hits(hits), members(spark, sf_dir))


def graph_answers(spark, sf_dir):
    scratch = Scratch(spark)
    index = pipelines.community_index(triples(spark, sf_dir), scratch, 50)
    q = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.col("r_name").alias("query"))
    lines = index["edges"].filter("relation = 'part of'").select(F.concat_ws(" -> ", "a", "relation", "b").alias("text"), "a", "b")
    hits = lines.join(q, (F.col("a") == F.col("query")) | (F.col("b") == F.col("query"))).select("query_id", "text")
    return pipelines.community_answers(index, hits, q)


def triples_parsed(spark, sf_dir):
    """A reply as a model gives it for each customer, parsed."""
    c = table(spark, sf_dir, "customer")
    e = F.format_string('{"entity_name":"%s","entity_type":"customer","entity_description":"%s"}', "c_name", "c_mktsegment")
    r = F.format_string('{"source_entity":"%s","target_entity":"%s","relation":"in"%s}', "c_name", "c_mktsegment", F.when(F.col("c_nationkey") > 5, F.lit(',"relationship_description":"d"')).otherwise(F.lit("")))
    reply = F.concat(F.lit('Sure:\n{"entities":['), e, F.lit('],"relationships":['), r, F.lit("]}\nDone."))
    p = c.select("c_custkey", graph.parse_triples(reply).alias("p"))
    return p.select("c_custkey", F.size("p.entities").cast("long").alias("n_entities"), F.size("p.relationships").cast("long").alias("n_relationships"), F.element_at("p.entities.entity_name", 1).alias("name"))


def text_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return pipelines.chunked(d, 64, 8).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("content").alias("md5"))


def text_passages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("seq"), F.array(F.struct(F.col("source").alias("title"), F.split("text", "\n").alias("sentences"))).alias("context"))
    return readers.passages(rows).select("title", F.md5("text").alias("md5"), F.col("seq._row").alias("first_id"))


def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.clean(F.col("text")).alias("clean"), tx.query_safe(F.col("text")).alias("safe"))



def text_rewrite(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tx.rewrite(F.col("text"), {"[0-9]+": "#", "the": "THE"}).alias("rewritten"), F.size(tx.decompose(F.col("text"), {"the": "A", "and": "B"})).cast("long").alias("n_parts"))


def text_latex(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.has_latex(F.col("text")).alias("latex"), F.md5(tx.spaced_formulas(F.col("text"))).alias("md5"))


def html_headings(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.posexplode(readers.headings(F.col("html"))).alias("pos", "heading")).withColumn("pos", F.col("pos").cast("long"))


def html_sections(spark, sf_dir):
    return readers.html_sections(table(spark, sf_dir, "pages"))


def html_articles(spark, sf_dir):
    return readers.articles(html_sections(spark, sf_dir))


def entity_named(spark, sf_dir):
    """The first nation that each article of a page names."""
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("goods of "), F.col("s_name"), F.lit(" by "), F.col("s_nationkey").cast("string")).alias("query"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"))
    return graph.named_entity(q, names)


def layout_sizes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    h, w = F.col("p_size") * 37, (F.col("p_partkey") % 977 + 1).cast("int")
    return p.select("p_partkey", ly.smart_resize(h, w).alias("s")).select("p_partkey", F.col("s.height").alias("height"), F.col("s.width").alias("width"))


def layout_boxes(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    box = F.array(*[(F.col(c) * k).cast("int") for c, k in (("l_quantity", 3), ("l_linenumber", 11), ("l_quantity", 9), ("l_linenumber", 40))])
    out = l.select("l_orderkey", "l_linenumber", ly.to_original(box, F.lit(1700), F.lit(2200), F.lit(850), F.lit(1100)).alias("b"))
    return out.select("l_orderkey", "l_linenumber", *[F.col("b")[i].alias(f"b{i}") for i in range(4)])


def layout_repair(spark, sf_dir):
    """Replies with a repeated object and a last one that breaks off."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    one = F.format_string('{"bbox": [%d, 2, 30, 40], "category": "Text", "text": "%s"}', F.col("p_size"), F.col("p_name"))
    two = F.format_string('{"bbox": [1, %d, 30, 40], "category": "Title", "text": "%s"}', F.col("p_size"), F.col("p_brand"))
    raw = F.concat(F.lit("["), one, F.lit(", "), two, F.lit(", "), one, F.lit(', {"bbox": [1, 2'))
    raw = F.replace(raw, F.lit('{"bbox": '), F.lit('{"bbox":'))
    return p.select("p_partkey", ly.cleaned(raw).alias("c")).select("p_partkey", F.size("c").cast("long").alias("n"), F.array_join(F.transform("c", lambda x: x["text"]), "|").alias("texts"))


def layout_repeats(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    cells = l.select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("text"), F.col("l_partkey").alias("bbox"))
    return evaluate.drop_repeated_cells(cells).select("page", "pos")


def layout_pages(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_idx"), F.col("l_linenumber").alias("pos"))  # noqa: E741
    return evaluate.page_index(l).select("page_idx", "pos", F.col("index").cast("long").alias("index"))


def store_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    new = d.filter("lang <> 'en'").select((F.col("id") + F.when(F.col("lang") == "de", 0).otherwise(10_000_000)).alias("id"), F.lit("new").alias("text"), "lang")
    return store.upsert(d, new).select("id", F.md5("text").alias("md5"), "lang")


def store_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.select(F.col("doc_id").alias("id"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.create_map(F.lit("lang"), F.lit("xx"), F.lit("quality"), F.col("quality").cast("string")).alias("metadata"))
    m = store.merge_properties(old, new)
    return m.select("id", *[F.col("metadata")[k].alias(k) for k in ("lang", "source", "quality")])


def store_delete(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return store.delete_where(store.delete_ids(d, toxic), F.col("lang") == "es")


def store_requested(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    want = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), (F.col("doc_id") * 3).alias("id"))
    return store.get_in_order(d, want)


def store_scroll(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    return store.scroll(d, F.col("event_type") != "view")


def cache_replies(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    prompts = c.select(F.col("text").alias("prompt"))
    cache = c.filter("role = 'user'").select(F.lit("m").alias("llm"), F.lit("t").alias("template"), F.col("text").alias("prompt"), F.concat(F.lit("cached "), F.col("conv_id").cast("string")).alias("reply"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    replies, _ = models.cached_replies(prompts, cache, "m", "t")
    return replies.select(F.md5("prompt").alias("md5"), F.when(F.col("reply").startswith("cached "), F.col("reply")).otherwise("asked").alias("reply"))


def chat_streams(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("message"), F.col("turn").alias("seq"), F.col("text").alias("delta"))
    return tokens.cumulative(c).select("message", "seq", F.md5("content").alias("md5"))


def chat_tool_calls(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    parts = c.select(F.col("conv_id").alias("message"), F.col("role").alias("index"), F.col("turn").alias("seq"), F.when(F.col("turn") < 2, F.col("role")).alias("name"), F.col("text").alias("arguments"))
    return tokens.tool_calls(parts).select("message", "index", "name", F.md5("arguments").alias("md5"))


def chat_usage(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(models.chat(F.col("text")).alias("reply"))
    return models.Usage(c).totals().select("input_tokens")


def score_containment(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.join(b, "doc_id").select("lang", F.col("text").alias("answer"), F.when(F.col("toxic") == 1, F.lit("IDIOT")).otherwise("The").alias("ground_truth"))
    return rows.groupBy("lang").agg(F.round(F.avg(evaluate.contained(F.col("answer"), F.col("ground_truth"))), 6).alias("score"))


def score_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cases = d.select(F.col("lang").alias("original_type"), (F.col("n_chars") > 500).alias("success"), F.size(F.split("text", "\n")).cast("long").alias("objects"), F.col("n_chars").alias("original_length"))
    return evaluate.cleaning_report(cases).select("original_type", "cases", "succeeded", "objects", F.round("mean_length", 6).alias("mean_length"), F.round("success_rate", 6).alias("success_rate"))


def answers_dense(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return pipelines.dense_answers(spark, d, q, 3)


_TRIPLES = """t AS (
  SELECT c_name AS src, n_name AS dst, 'lives in' AS relation, c_mktsegment AS description, c_custkey::BIGINT AS seq FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_name, s_name, 'hosts', 'supplier', s_suppkey::BIGINT FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, r_name, 'part of', 'region', n_nationkey::BIGINT FROM nation JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_max(relation, (seq, relation, description)) AS relation, arg_max(description, (seq, relation, description)) AS description FROM t GROUP BY 1, 2),
nb AS (SELECT a AS node, b AS other, relation, description FROM g UNION ALL SELECT b, a, relation, description FROM g WHERE a <> b),
m AS (SELECT c_name AS node, c_nationkey::BIGINT AS community FROM customer UNION ALL SELECT n_name, n_nationkey::BIGINT FROM nation UNION ALL SELECT n_name, (n_regionkey + 100)::BIGINT FROM nation)"""
_DETAILS = _TRIPLES + ", x AS (SELECT community, node || ' -> ' || other || ' -> ' || relation || ' -> ' || description AS detail FROM m JOIN nb USING (node))"
_W = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"

QUERIES = {f.__name__: f for f in (graph_details, graph_texts, graph_entity_communities, graph_components, graph_clusters, graph_global, graph_answers, triples_parsed, text_chunks, text_passages, text_clean, text_rewrite, text_latex, html_headings, html_sections, html_articles, entity_named, layout_sizes, layout_boxes, layout_repair, layout_repeats, layout_pages, store_upsert, store_merge, store_delete, store_requested, store_scroll, cache_replies, chat_streams, chat_tool_calls, chat_usage, score_containment, score_report, answers_dense)}
QUERIES["graph_edges"] = edges
SQL = {
    "graph_edges": f"WITH {_TRIPLES} SELECT a, b, relation, description FROM g",
    "graph_details": f"WITH {_DETAILS} SELECT community, detail FROM x",
    "graph_texts": f"WITH {_DETAILS} SELECT community, md5(string_agg(detail, chr(10) ORDER BY detail) || '.') AS text_md5, (length(string_agg(detail, chr(10) ORDER BY detail)) + 1)::BIGINT AS n_chars FROM x GROUP BY 1",
    "graph_entity_communities": f"WITH {_TRIPLES} SELECT node, array_to_string(list(DISTINCT community ORDER BY community), ',') AS communities FROM m GROUP BY 1",
    "graph_components": f"""WITH RECURSIVE {_TRIPLES},
hub AS (SELECT n_name AS node, min(r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
labelled AS (SELECT node, region FROM hub UNION SELECT DISTINCT region, region FROM hub UNION SELECT nb.node, hub.region FROM nb JOIN hub ON hub.node = nb.other WHERE nb.relation <> 'part of')
SELECT node, min(node) OVER (PARTITION BY region) AS component FROM labelled""",
    "graph_global": f"""WITH {_TRIPLES},
h AS (SELECT greatest(a, b) AS query_id, a, b FROM g WHERE relation = 'part of' AND regexp_full_match(a, '[A-Z ]+') AND regexp_full_match(b, '[A-Z ]+')
  UNION ALL SELECT NULL, a, b FROM g WHERE relation = 'part of' AND NOT (regexp_full_match(a, '[A-Z ]+') AND regexp_full_match(b, '[A-Z ]+'))),
n AS (SELECT query_id, a AS node FROM h WHERE regexp_full_match(a, '\\w+(\\s+\\w+)*') AND regexp_full_match(b, '\\w+(\\s+\\w+)*')
  UNION SELECT query_id, b FROM h WHERE regexp_full_match(a, '\\w+(\\s+\\w+)*') AND regexp_full_match(b, '\\w+(\\s+\\w+)*'))
SELECT DISTINCT query_id, community FROM n JOIN m USING (node)""",
    "triples_parsed": "SELECT c_custkey, 1::BIGINT AS n_entities, (c_nationkey > 5)::BIGINT AS n_relationships, c_name AS name FROM customer",
    "text_chunks": f"""WITH d AS (SELECT doc_id, {_W} AS w FROM documents)
SELECT doc_id, pos, md5(array_to_string(w[pos * 56 + 1 : pos * 56 + 64], ' ')) AS md5
FROM d, unnest(range(0, greatest(0, ceil((len(w) - 64) / 56.0))::BIGINT + 1)) AS u(pos) WHERE len(w) > 0""",
    "text_passages": "SELECT arg_max(source, doc_id) AS title, md5(text) AS md5, min(doc_id) AS first_id FROM documents GROUP BY text",
    "text_clean": """SELECT conv_id, turn, coalesce(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '') AS clean,
nullif(trim(translate(text, '+-&|!(){}[]^"~*?:\\', '                  ')), '') AS safe FROM conversations""",
    "text_rewrite": """SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[0-9]+') THEN regexp_replace(text, '[0-9]+', '#', 'g') ELSE replace(text, 'the', 'THE') END AS rewritten,
greatest(1, (text LIKE '%the%')::INT + (text LIKE '%and%')::INT)::BIGINT AS n_parts FROM conversations""",
    "text_latex": """SELECT doc_id, regexp_matches(text, '\\$\\$.*?\\$\\$', 's') OR regexp_matches(text, '\\$[^$\\n]+?\\$') OR regexp_matches(text, '\\\\[a-zA-Z]+') OR regexp_matches(text, '\\\\\\[.*?\\\\\\]', 's') OR regexp_matches(text, '\\\\\\(.*?\\\\\\)', 's') AS latex,
md5(regexp_replace(text, '\\$\\$\\n?(.*?)\\n?\\$\\$', '$$' || chr(10) || '\\1' || chr(10) || '$$', 'gs')) AS md5 FROM documents""",
    "html_headings": """WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-4][^>]*>(.*?)</h[1-4]>', 1) AS hs FROM pages)
SELECT page_id, pos - 1 AS pos, regexp_replace(regexp_replace(hs[pos], '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS heading FROM h, unnest(range(1, len(hs) + 1)) AS u(pos)""",
    "entity_named": """WITH q AS (SELECT s_suppkey AS query_id, lower('goods of ' || s_name || ' by ' || s_nationkey) AS q FROM supplier)
SELECT query_id, (SELECT arg_min(s_name, s_suppkey) FROM supplier WHERE contains(q, lower(s_name))) AS name FROM q""",
    "layout_sizes": """WITH p AS (SELECT p_partkey, p_size * 37 AS h, (p_partkey % 977 + 1)::INT AS w FROM part),
s AS (SELECT *, greatest(28, round_even(h / 28, 0)::BIGINT * 28) AS hb, greatest(28, round_even(w / 28, 0)::BIGINT * 28) AS wb, sqrt((h * w)::DOUBLE / 11289600) AS shrink, sqrt(3136.0::DOUBLE / (h * w)::DOUBLE) AS grow FROM p)
SELECT p_partkey, CASE WHEN greatest(h, w) / least(h, w) > 200 THEN NULL WHEN hb * wb > 11289600 THEN greatest(28, floor(h / shrink / 28)::BIGINT * 28) WHEN hb * wb < 3136 THEN ceil(h * grow / 28)::BIGINT * 28 ELSE hb END AS height,
CASE WHEN greatest(h, w) / least(h, w) > 200 THEN NULL WHEN hb * wb > 11289600 THEN greatest(28, floor(w / shrink / 28)::BIGINT * 28) WHEN hb * wb < 3136 THEN ceil(w * grow / 28)::BIGINT * 28 ELSE wb END AS width FROM s""",
    "layout_boxes": """SELECT l_orderkey, l_linenumber, trunc(trunc(l_quantity * 3)::INT / (840 / 1700))::INT AS b0, trunc((l_linenumber * 11) / (1092 / 2200))::INT AS b1,
trunc(trunc(l_quantity * 9)::INT / (840 / 1700))::INT AS b2, trunc((l_linenumber * 40) / (1092 / 2200))::INT AS b3 FROM lineitem""",
    "layout_repair": "SELECT p_partkey, 2::BIGINT AS n, p_name || '|' || p_brand AS texts FROM part",
    "layout_repeats": """WITH c AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS pos, l_returnflag AS a, l_linestatus AS b, l_partkey AS x FROM lineitem),
w AS (SELECT *, count(*) OVER (PARTITION BY page, a, b) AS n, row_number() OVER (PARTITION BY page, a, b ORDER BY pos) AS i, row_number() OVER (PARTITION BY page, x ORDER BY pos) AS k FROM c)
SELECT page, pos FROM w WHERE NOT (n >= 5 AND i > 1) AND k = 1""",
    "layout_pages": "SELECT l_orderkey AS page_idx, l_linenumber AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS index FROM lineitem",
    "store_upsert": """WITH n AS (SELECT doc_id + CASE WHEN lang = 'de' THEN 0 ELSE 10000000 END AS id, lang FROM documents WHERE lang <> 'en')
SELECT doc_id AS id, md5(text) AS md5, lang FROM documents WHERE doc_id NOT IN (SELECT id FROM n) UNION ALL SELECT id, md5('new'), lang FROM n""",
    "store_merge": "SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN lang ELSE 'xx' END AS lang, source, quality::VARCHAR AS quality FROM documents d LEFT JOIN labels l USING (doc_id)",
    "store_delete": "SELECT doc_id AS id, lang FROM documents WHERE lang <> 'es' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "store_requested": "SELECT l.doc_id AS pos, d.doc_id AS id, source FROM labels l JOIN documents d ON d.doc_id = l.doc_id * 3",
    "store_scroll": "SELECT event_id AS id, event_type FROM events WHERE event_type <> 'view' ORDER BY event_id LIMIT 9999",
    "cache_replies": """WITH k AS (SELECT text, arg_max('cached ' || conv_id, conv_id * 1000 + turn) AS reply FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT md5(c.text) AS md5, coalesce(k.reply, 'asked') AS reply FROM (SELECT DISTINCT text FROM conversations) c LEFT JOIN k USING (text)""",
    "chat_streams": "SELECT conv_id AS message, turn AS seq, md5(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS md5 FROM conversations",
    "chat_tool_calls": "SELECT conv_id AS message, role AS index, arg_min(role, turn) FILTER (WHERE turn < 2) AS name, md5(string_agg(text, '' ORDER BY turn)) AS md5 FROM conversations GROUP BY 1, 2",
    "chat_usage": "SELECT sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS input_tokens FROM conversations",
    "score_containment": "SELECT lang, round(avg(contains(lower(text), CASE WHEN toxic = 1 THEN 'idiot' ELSE 'the' END)::INT), 6) AS score FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "score_report": "SELECT lang AS original_type, count(*) AS cases, count_if(n_chars > 500)::BIGINT AS succeeded, sum(len(string_split(text, chr(10))))::BIGINT AS objects, round(avg(n_chars), 6) AS mean_length, round(avg((n_chars > 500)::INT), 6) AS success_rate FROM documents GROUP BY 1",
}
