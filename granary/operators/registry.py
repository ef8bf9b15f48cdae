"""Registries of plan builders and providers by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    """name -> factory. Names are compared in lower case; a name can't be registered twice unless asked."""

    def __init__(self, kind: str):
        self.kind = kind
        self._made: dict[str, Callable[..., Any]] = {}

    def register(self, name: str, factory: Callable[..., Any], replace: bool = False) -> None:
        if not callable(factory):
            raise TypeError(f"a {self.kind} factory must be callable")
        if name.lower() in self._made and not replace:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self._made[name.lower()] = factory

    def create(self, name: str, *args: Any, **kwargs: Any) -> Any:
        if name.lower() not in self._made:
            raise ValueError(f"unknown {self.kind} {name!r}; there are {self.names()}")
        return self._made[name.lower()](*args, **kwargs)

    def names(self) -> list[str]:
        return sorted(self._made)

    def is_registered(self, name: str) -> bool:
        return name.lower() in self._made

    def unregister(self, name: str) -> bool:
        return self._made.pop(name.lower(), None) is not None

    def clear(self) -> None:
        self._made.clear()


def defaults() -> dict[str, Registry]:
    """The five registries with what is built in."""
    from granary.operators import dense, fusion, lexical, models, store

    kinds = {k: Registry(k) for k in ("retriever", "store", "embedding", "llm", "reranker")}
    kinds["retriever"].register("bm25", lexical.Bm25)
    kinds["retriever"].register("vectorstore", dense.retrieve)
    kinds["retriever"].register("multipath", fusion.MultiPath)
    kinds["store"].register("flat", dense.search)
    kinds["store"].register("ivf", dense.search_cells)
    kinds["store"].register("saved", store.load)
    kinds["embedding"].register("hash", models.hash_embedder)
    kinds["llm"].register("extractive", lambda: models.extractive)
    for name in ("openai", "openai-compatible", "dashscope"):
        kinds["llm"].register(name, lambda n=name: models.Remote(n))
    for name in ("huggingface", "openai-compatible", "clip"):
        kinds["embedding"].register(name, lambda n=name: models.Remote(n))
    kinds["reranker"].register("overlap", lambda: models.overlap_scorer)
    kinds["reranker"].register("qwen3", lambda: models.Remote("qwen3"))
    return kinds
