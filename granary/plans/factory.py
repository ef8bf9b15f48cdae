"""Question answering from a configuration: sections of a file, overrides, and the plan that they name."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import dense
from granary.operators.lexical import Bm25
from granary.operators.models import embedded
from granary.plans import pipelines
from granary.runtime import Scratch
from granary.sources import readers

DEFAULTS: dict[str, dict[str, Any]] = {
    "dataset": {"path": None, "queries": None, "subset": 0},
    "rag": {"solution": "dense", "top_k": 10, "chunk": True, "max_cluster_size": 5},
    "storage": {"type": "flat", "metric": "cosine"},
}


def _value(text: str) -> Any:
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


def read_config(path: str, overrides: list[str] = ()) -> dict[str, dict[str, Any]]:
    """Sections of a JSON or YAML file over the defaults; ``section.key=value`` entries come last.

    A file of another kind, a section or a key that isn't known raises ValueError.
    """
    text = Path(path).read_text()
    match Path(path).suffix:
        case ".json":
            given = json.loads(text)
        case ".yaml" | ".yml":
            import yaml

            given = yaml.safe_load(text) or {}
        case kind:
            raise ValueError(f"no reader for {kind or 'a file without suffix'}")
    out = {section: dict(values) for section, values in DEFAULTS.items()}
    pairs = [(s, k, v) for s, values in given.items() for k, v in (values or {}).items()]
    for entry in overrides:
        name, _, value = entry.partition("=")
        section, _, key = name.partition(".")
        pairs.append((section, key, _value(value)))
    for section, key, value in pairs:
        if section not in out or key not in out[section]:
            raise ValueError(f"unknown setting {section}.{key}")
        out[section][key] = value
    return out


def _flat(spark: SparkSession, docs: DataFrame, queries: DataFrame, config: dict) -> DataFrame:
    vectors = docs.select("id", embedded(F.col("content")).alias("vector"))
    asked = queries.select("query_id", embedded(F.col("query")).alias("vector"))
    return dense.search(spark, vectors, asked, config["rag"]["top_k"], config["storage"]["metric"])


#: Hits (query_id, rank, id, score) by kind of storage.
STORES: dict[str, Callable[[SparkSession, DataFrame, DataFrame, dict], DataFrame]] = {
    "flat": _flat,
    "bm25": lambda spark, docs, queries, config: Bm25(docs).search(queries, config["rag"]["top_k"]),
}


def _dense(spark: SparkSession, docs: DataFrame, queries: DataFrame, config: dict) -> DataFrame:
    nodes = pipelines.chunked(docs).select("id", "content") if config["rag"]["chunk"] else docs.select(F.col("id").cast("string").alias("id"), "content")
    nodes = Scratch(spark).table(nodes, "nodes")
    hits = STORES[config["storage"]["type"]](spark, nodes, queries, config)
    return pipelines.answers(hits.join(nodes, "id"), queries)


def _community(spark: SparkSession, docs: DataFrame, queries: DataFrame, config: dict) -> DataFrame:
    entities, triples = pipelines.extract(docs)
    index = pipelines.community_index(triples, Scratch(spark), config["rag"]["max_cluster_size"])
    hits = pipelines.local_context(entities, index["edges"], queries, spark, config["rag"]["top_k"])
    return pipelines.community_answers(index, hits, queries)


SOLUTIONS = {"dense": _dense, "community": _community}


def answer(spark: SparkSession, docs: DataFrame, queries: DataFrame, config: dict) -> DataFrame:
    """Answers (query_id, answer, ...) of the solution and storage that ``config`` names; unknown ones raise ValueError."""
    if (solution := config["rag"]["solution"]) not in SOLUTIONS:
        raise ValueError(f"unknown solution {solution!r}")
    if (kind := config["storage"]["type"]) not in STORES:
        raise ValueError(f"unknown storage type {kind!r}")
    return SOLUTIONS[solution](spark, docs, queries, config)


def run(spark: SparkSession, path: str, overrides: list[str] = ()) -> DataFrame:
    """The whole run: corpus (id, content) and queries (query_id, query) are JSON files that the configuration names."""
    config = read_config(path, overrides)
    data = config["dataset"]
    docs = readers.json_rows(spark, data["path"], data["subset"], order="id" if data["subset"] else None)
    return answer(spark, docs, readers.json_rows(spark, data["queries"]), config)
