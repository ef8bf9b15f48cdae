"""Bounded training samples; everything that is scored is scored whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import runtime
from granary.operators.skew import unused


def held_out(ident: str, mod: int, rest: int) -> Column:
    """crc32 of the id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(ident).cast("string")) % mod == rest, F.lit(False))


def long_id(docs: DataFrame, ident: str) -> Column:
    """The id as a long: whole numbers as they are, also those written as text; other values by their hash, null as null."""
    kind, name = dict(docs.dtypes)[ident], F.col(f"`{ident}`")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return name.cast("long")
    text = name.cast("string")
    value = F.coalesce(text.try_cast("long"), F.xxhash64(text)) if kind == "string" else F.xxhash64(text)
    return F.when(name.isNotNull(), value)


def arrow_rows(docs: DataFrame, step, schema: T.StructType) -> DataFrame:
    """``docs.mapInArrow(step, schema)`` for columns of any name: ``step`` sees dots and backticks as underscores, made unlike the others."""
    def plain(names: list[str]) -> list[str]:
        odd = [i for i, n in enumerate(names) if "." in n or "`" in n]
        new = dict(zip(odd, unused([n for i, n in enumerate(names) if i not in odd], *(names[i].replace(".", "_").replace("`", "_") for i in odd))))
        return [new.get(i, n) for i, n in enumerate(names)]

    named = T.StructType([T.StructField(n, f.dataType) for n, f in zip(plain(schema.names), schema.fields)])
    return docs.toDF(*plain(docs.columns)).mapInArrow(step, named).toDF(*schema.names)


def mark(*columns: str) -> Column:
    """A hash of the columns, even over 0 .. 2^53 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11)


def share(part: float) -> int:
    """The number below which ``part`` of all marks lie."""
    return int(min(1.0, part) * 2**53)


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, mod: int, rest: int, total: int = 40_000_000, text: str = "text", ident: str = "doc_id") -> list[tuple[int, str, object]]:
    """At most ``bound`` (id, text, label) rows whose ids are not held out, in the order of a hash of the id.

    Rows without label or id are not drawn. Of several labels or texts of one id the largest label
    and the smallest text count. Texts are whole; those that don't fit in what the texts before
    leave of ``total`` characters are passed over, which bounds the sample as ``bound`` does.
    """
    own = labels.select(long_id(labels, ident).alias("doc_id"), F.col(label).alias("label"))
    own = own.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", mod, rest))
    # Twice what is wanted passes the threshold, so only that much is grouped and ordered.
    known = own.agg(F.approx_count_distinct("doc_id")).first()[0]
    if known > 2 * bound:
        own = own.filter(mark("doc_id") < share(2 * bound / known))
    own = own.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(mark("doc_id"), "doc_id").limit(bound)
    texts = docs.select(long_id(docs, ident).alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    scratch = runtime.Scratch(docs.sparkSession)
    rows = scratch.table(texts.join(F.broadcast(own), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")), "sample")
    fit, left = [], total
    sizes = rows.select("doc_id", F.length("text").alias("n"), mark("doc_id").alias("mark")).collect()
    for r in sorted(sizes, key=lambda r: (r["mark"], r["doc_id"])):
        if r["n"] <= left:
            fit.append(r["doc_id"])
            left -= r["n"]
    drawn = rows if len(fit) == len(sizes) else rows.filter(F.col("doc_id").isin(fit))
    out = sorted((r["doc_id"], r["text"], r["label"]) for r in drawn.collect())
    scratch.drop(rows)
    return out


class WordTable(dict):
    """word -> row of ``matrix``, whose rows ``encode(words)`` makes for new words in bulk.

    Between slices at most ``bound`` words stay, the first met.
    """

    def __init__(self, encode, width: int, bound: int = 300_000):
        super().__init__()
        self.encode, self.bound, self.new = encode, bound, []
        self.matrix, self.used = np.zeros((4096, width), np.float32), 0

    def __missing__(self, word: bytes) -> int:
        i = self[word] = self.used + len(self.new)
        self.new.append(word)
        return i

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Row numbers for ``matrix``, good until the next call."""
        if self.used > self.bound:
            for w in self.late:
                del self[w]
            self.used = self.bound
        i = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            end = self.used + len(self.new)
            if end > len(self.matrix):
                self.matrix = np.concatenate([self.matrix[: self.used], np.zeros((max(end, 2 * self.used) - self.used, self.matrix.shape[1]), np.float32)])
            for lo in range(0, len(self.new), 20_000):
                part = self.new[lo : lo + 20_000]
                self.matrix[self.used + lo : self.used + lo + len(part)] = self.encode(part)
            self.late = self.new[max(0, self.bound - self.used) :]
            self.used, self.new = end, []
        return i


def sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of ``x`` between ``starts`` (n + 1 numbers); empty spans give 0."""
    out = np.zeros((len(starts) - 1, *x.shape[1:]), x.dtype)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(x, starts[:-1][full], axis=0)
    return out


