"""Model boundaries: embedders, chat models, rerankers and page parsers as Arrow UDFs.

Providers are plain callables over pandas Series, so a real model is one function. The defaults are
deterministic and need no network.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as tx

Embedder = Callable[[pd.Series], pd.Series]
Chat = Callable[[pd.Series], pd.Series]
Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def hash_embedder(dim: int = 64) -> Embedder:
    """Signed counts of hashed words, at unit length; a text without words is all zeros."""

    def embed(texts: pd.Series) -> pd.Series:
        lines = [(t or "").replace("\n", " ").lower().split() for t in texts]
        place: dict[str, int] = {}  # each word is hashed once a batch
        code = np.array([place.setdefault(w, len(place)) for line in lines for w in line], np.int64)
        hashes = [xxhash.xxh3_64_intdigest(w) for w in place]
        slot, sign = np.array([h % dim for h in hashes], np.int64), np.array([1.0 if h >> 63 else -1.0 for h in hashes])
        row = np.repeat(np.arange(len(lines)), [len(line) for line in lines])
        out = np.bincount(row * dim + slot[code], sign[code], len(lines) * dim).astype(np.float64).reshape(-1, dim)
        norm = np.sqrt((out * out).sum(axis=1))
        return pd.Series(list(out / np.where(norm > 0, norm, 1)[:, None]))

    return embed


def embedded(text: Column, embedder: Embedder | None = None) -> Column:
    run = embedder or hash_embedder()

    @F.pandas_udf("array<double>")
    def udf(t: pd.Series) -> pd.Series:
        return run(t)

    return udf(tx.one_line(text))


def extractive(prompts: pd.Series) -> pd.Series:
    """The default chat model: the last line of a prompt that isn't blank."""
    last = lambda p: next((x.strip() for x in reversed((p or "").split("\n")) if x.strip()), "")
    return prompts.map(last)


REPLY = "struct<text:string,input_tokens:long,output_tokens:long,total_tokens:long>"


def chat(prompt: Column, model: Chat | None = None) -> Column:
    """A model's reply with token counts (words); a failing batch gives null replies, not a failed job."""
    run = model or extractive

    @F.pandas_udf(REPLY)
    def udf(p: pd.Series) -> pd.DataFrame:
        try:
            r = run(p)
        except Exception:  # a provider may raise anything; the row shows it by a null reply
            r = pd.Series([None] * len(p))
        n, m = p.fillna("").str.split().str.len().astype("int64"), r.fillna("").str.split().str.len().astype("int64")
        return pd.DataFrame({"text": r, "input_tokens": n, "output_tokens": m, "total_tokens": n + m})

    return udf(prompt)


def cached_replies(prompts: DataFrame, cache: DataFrame, llm: str, template: str, model: Chat | None = None) -> tuple[DataFrame, DataFrame]:
    """(replies by prompt, rows new to the cache): each distinct prompt that the cache lacks is asked once.

    The key is model, template and prompt, so that two templates over one text don't share replies.
    """
    asked = prompts.select("prompt").distinct().withColumn("llm", F.lit(llm)).withColumn("template", F.lit(template))
    known = asked.join(latest(cache), ["llm", "template", "prompt"])
    fresh = asked.join(cache, ["llm", "template", "prompt"], "left_anti")
    fresh = fresh.withColumn("reply", chat(F.col("prompt"), model)["text"])
    return known.select("prompt", "reply").unionByName(fresh.select("prompt", "reply")), fresh


def latest(cache: DataFrame, seq: str = "seq") -> DataFrame:
    """One row a key: the last one written."""
    keys = ["llm", "template", "prompt"]
    return cache.groupBy(*keys).agg(F.max_by("reply", seq).alias("reply"))


def put(cache: DataFrame, fresh: DataFrame, seq: str = "seq") -> DataFrame:
    top = cache.agg(F.max(seq)).first()[0] or 0
    return cache.unionByName(fresh.withColumn(seq, F.lit(top + 1).cast("long")).select(*cache.columns))


def cache_key(params: Column) -> Column:
    """Parameters (a map of strings) as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def yes_probability(yes: Column, no: Column) -> Column:
    return 1.0 / (1.0 + F.exp(no - yes))


def overlap_scorer(queries: pd.Series, docs: pd.Series) -> pd.Series:
    """The default reranker: share of a query's words that a document has."""

    def one(q: str | None, d: str | None) -> float:
        own = set((q or "").lower().split())
        return len(own & set((d or "").lower().split())) / len(own) if own else 0.0

    return pd.Series([one(q, d) for q, d in zip(queries, docs)])


def rerank(hits: DataFrame, k: int | None = None, scorer: Scorer | None = None, query: str = "query", content: str = "content") -> DataFrame:
    """Hits in the order of a model's score, ties in the order they had; ``k`` cuts."""
    run = scorer or overlap_scorer

    @F.pandas_udf("double")
    def udf(q: pd.Series, d: pd.Series) -> pd.Series:
        return run(q, d)

    scored = hits.withColumn("rerank_score", udf(F.col(query), F.col(content)))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    out = scored.withColumn("new_rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("new_rank") <= k)


@dataclass(frozen=True)
class Usage:
    """Sums of token counts over replies."""

    replies: DataFrame
    reply: str = "reply"

    def totals(self) -> DataFrame:
        return self.replies.agg(*[F.sum(f"{self.reply}.{c}").alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")])


@dataclass(frozen=True)
class Remote:
    """A provider that needs a service or weights that aren't here; says so when it is called."""

    name: str

    def __call__(self, *_):
        raise NotImplementedError(f"{self.name} needs its own client: pass a callable over pandas Series instead")
