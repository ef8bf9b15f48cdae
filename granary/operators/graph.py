"""Property graphs as tables: triples, simple graph, communities, and what is looked up in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators.components import connected_components
from granary.runtime import Scratch

ENTITY = "array<struct<entity_name:string,entity_type:string,entity_description:string>>"
RELATION = "array<struct<source_entity:string,target_entity:string,relation:string,relationship_description:string>>"


def _complete(items: Column, fields: tuple[str, ...]) -> Column:
    return F.forall(items, lambda e: sum((e[f].isNull().cast("int") for f in fields), F.lit(0)) == 0)


def parse_triples(reply: Column) -> Column:
    """struct<entities, relationships> of a model's JSON reply.

    The JSON is what lies between the first { and the last }. Broken JSON gives two empty lists; if
    an entity lacks a field both are empty, if only a relationship does, the entities stay.
    """
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    data = F.from_json(F.when(body != "", body), f"entities {ENTITY}, relationships {RELATION}", {"mode": "PERMISSIVE"})
    none_e, none_r = F.array().cast(ENTITY), F.array().cast(RELATION)
    es, rs = F.coalesce(data["entities"], none_e), F.coalesce(data["relationships"], none_r)
    ok_e = _complete(es, ("entity_name", "entity_type", "entity_description"))
    ok_r = _complete(rs, ("source_entity", "target_entity", "relation", "relationship_description"))
    return F.struct(F.when(ok_e, es).otherwise(none_e).alias("entities"), F.when(ok_e & ok_r, rs).otherwise(none_r).alias("relationships"))


def simple_graph(triples: DataFrame) -> DataFrame:
    """(a, b, relation, description) with a <= b: one undirected edge a pair, the last triple (seq) wins."""
    pair = triples.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.struct("seq", "relation", "description").alias("t"))
    return pair.groupBy("a", "b").agg(F.max("t").alias("t")).select("a", "b", "t.relation", "t.description")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other, relation, description), both ways; a loop once."""
    there = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "relation", "description")
    return there.unionByName(edges.filter("a <> b").select(F.col("b").alias("node"), F.col("a").alias("other"), "relation", "description"))


def community_details(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(community, detail): a line for every edge of every member, also those that leave the community."""
    line = F.concat_ws(" -> ", "node", "other", F.coalesce("relation", F.lit("")), F.coalesce("description", F.lit("")))
    return membership.join(neighbours(edges), "node").select("community", line.alias("detail"))


def community_texts(details: DataFrame) -> DataFrame:
    """(community, text): its lines in order, one a row of text, and a full stop."""
    return details.groupBy("community").agg(F.concat(F.array_join(F.sort_array(F.collect_list("detail")), "\n"), F.lit(".")).alias("text"))


def entity_communities(membership: DataFrame) -> DataFrame:
    return membership.groupBy("node").agg(F.sort_array(F.collect_set("community")).alias("communities"))


def entities_in_hits(hits: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, node) of the triples written in retrieved texts."""
    return hits.select("query_id", F.explode(tx.entities(F.col(text))).alias("node")).distinct()


def communities_of(entities: DataFrame, membership: DataFrame) -> DataFrame:
    """Distinct (query_id, community); entities that are in none are skipped."""
    return entities.join(membership, "node").select("query_id", "community").distinct()


def summaries_for(found: DataFrame, summaries: DataFrame) -> DataFrame:
    return found.join(summaries, "community").select("query_id", "community", "summary")


def named_entity(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, name) of the first name (by seq) that a query contains, whatever the case; null if none.

    Names meet queries by all parts of a query that are as long as some name, an equi-join on the
    whole name: no start or word that many names share brings pairs together.
    """
    keyed = names.select("name", "seq", F.lower("name").alias("n")).filter(F.col("n").isNotNull()).groupBy("n").agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq"))
    lengths = F.broadcast(keyed.select(F.length("n").alias("l")).distinct())
    asked = queries.select("query_id", F.lower("query").alias("q")).join(lengths, F.col("l") <= F.length("q"))
    parts = F.transform(F.sequence(F.lit(1), F.length("q") - F.col("l") + 1), lambda i: F.substring(F.col("q"), i, F.col("l")))
    found = asked.select("query_id", F.explode(F.array_distinct(parts)).alias("n")).join(keyed, "n")
    best = found.groupBy("query_id").agg(F.min_by("name", "seq").alias("name"))
    return queries.select("query_id").join(best, "query_id", "left")


def communities(edges: DataFrame, scratch: Scratch, max_size: int = 5, rounds: int = 8, levels: int = 6) -> DataFrame:
    """(node, community, parent, level, final): clusters that nest, split while larger than ``max_size``.

    Level 0 are connected components. A cluster over the size is split by rounds of local moves:
    each node takes the label of largest modularity gain (links to it less those expected), ties to
    its own and then the smallest label, and nodes of one hash parity move at a time so that labels
    don't swap for ever; once neither parity moves, later rounds can't either. A part
    that doesn't split stays, as the only case over the size. Deterministic.
    """
    near = scratch.table(neighbours(edges).select("node", "other").filter("node <> other").distinct(), "neighbours")
    parity = F.pmod(F.xxhash64("node"), F.lit(2))
    base = connected_components(edges, scratch, "a", "b").select("node", F.col("component").alias("label"))
    now = scratch.table(base.select("node", F.xxhash64(F.lit(0), "label").alias("community"), F.lit(None).cast("long").alias("parent")), "level")
    out = []
    for level in range(levels + 1):
        size = now.groupBy("community").agg(F.count("*").alias("size"))
        sized = scratch.table(now.join(size, "community"), "sized")
        big = sized.filter(F.col("size") > max_size)
        more = level < levels and big.limit(1).count() > 0
        if not more:
            out.append(sized.select("node", "community", "parent", F.lit(level).alias("level"), F.lit(True).alias("final")))
            break
        # Links inside a cluster were links inside its parent; each row has what a node's gains need.
        ends = big.select("node", "community")
        inner = near.join(ends, "node").join(ends.select(F.col("node").alias("other"), F.col("community").alias("c")), "other").filter("community = c").select("node", "other")
        near = inner = scratch.table(inner, "inner")
        degree = ends.join(inner.groupBy("node").agg(F.count("*").alias("deg")), "node", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
        degree = scratch.table(degree, "degree")
        weight = degree.groupBy("community").agg(F.sum("deg").alias("all"))
        labels = scratch.table(degree.join(weight, "community").select("node", "community", "deg", "all", F.col("node").alias("label"), F.lit(True).alias("moved")), "labels")
        still = 0
        for step in range(rounds):
            # A label is a node of its cluster, so it tells the cluster.
            total = labels.groupBy(F.col("label").alias("to")).agg(F.sum("deg").alias("tot"))
            movers, others = labels.filter(parity == step % 2), labels.filter(parity != step % 2)
            held = labels.select(F.col("node").alias("other"), F.col("label").alias("to"))
            links = inner.filter(parity == step % 2).join(held, "other").groupBy("node", "to").agg(F.count("*").alias("n"))
            tried = links.join(movers, "node").select("node", "community", "deg", "all", "label", "to", "n")
            tried = tried.unionByName(movers.select("node", "community", "deg", "all", "label", F.col("label").alias("to"), F.lit(0).cast("long").alias("n")))
            tried = tried.join(total, "to")
            stays = F.col("to") == F.col("label")
            gain = F.round(F.col("n") - F.col("deg") * (F.col("tot") - F.when(stays, F.col("deg")).otherwise(0)) / F.greatest(F.col("all"), F.lit(1)), 9)
            # Of the two rows of a node's own label the one with its links is the better.
            best = Window.partitionBy("node").orderBy(F.desc("gain"), F.desc(stays), "to")
            pick = tried.withColumn("gain", gain).withColumn("r", F.row_number().over(best)).filter("r = 1")
            pick = pick.select("node", "community", "deg", "all", F.col("to").alias("label"), (~stays).alias("moved"))
            labels = scratch.table(pick.unionByName(others.withColumn("moved", F.lit(False))), "labels")
            still = 0 if labels.filter("moved").limit(1).count() else still + 1
            if still == 2:
                break
        parts = labels.groupBy("community").agg(F.countDistinct("label").alias("parts"))
        split = labels.join(parts, "community").filter("parts > 1")
        settled = sized.join(split.select("node"), "node", "left_anti")
        out.append(settled.select("node", "community", "parent", F.lit(level).alias("level"), F.lit(True).alias("final")))
        out.append(sized.join(split.select("node"), "node", "left_semi").select("node", "community", "parent", F.lit(level).alias("level"), F.lit(False).alias("final")))
        now = scratch.table(split.select("node", F.xxhash64(F.lit(level + 1), "community", "label").alias("community"), F.col("community").alias("parent")), "level")
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result
