"""Line dedup: two Bloom filters mark the lines that may repeat; only those are shuffled for exact counts.

Pass 1 builds, per task, one filter of keys seen once and one of keys seen twice, and merges
them with bounded fan-in: ``twice = t1 | t2 | (o1 & o2)``, ``once = o1 | o2``. A key of two
documents always passes the merged ``twice`` filter, so nothing is lost; a false positive only
costs a shuffled digest. Pass 2 counts documents of the suspects exactly, by 128-bit digest and
pre-aggregated per task. Pass 3 rewrites the texts, with the repeated digests broadcast while
they are within ``hot_bound`` and joined by document otherwise.

The filters have about a bit for every eight bytes of input, up to ``MOST_BITS``, so what is merged and
broadcast is bounded; past their capacity more lines are suspects, and the result stays the same.
A task ships the set bits of a slice of its filters by number while that is shorter.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import runtime
from granary.llm import samples
from granary.llm import words as W
from granary.operators.skew import spread_join, unused

WS = b" \t\n\x0b\x0c\r"
SLICE = 1 << 17
FAN_IN = 32
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
UNNAMED = (1 << 63) - 1  #: stands for a null id, after all others


def keys(text: bytes) -> list[bytes]:
    """The keys of a text's lines: stripped of ASCII white space at both ends, A-Z lower-cased."""
    return [line.strip(WS) for line in text.lower().split(b"\n")]


def _wide(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def _positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(33)) & mask).astype(np.int64)


def _test(bitmap: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0


def _set(bitmap: np.ndarray, p: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))


def _packed(slice_: np.ndarray) -> bytes:
    """A slice's bytes, or the numbers of its set bits (and a mark) where those are shorter."""
    at = np.flatnonzero(np.unpackbits(slice_, bitorder="little"))
    return at.astype("<u4").tobytes() + b"s" if 4 * len(at) < len(slice_) else slice_.tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    if len(data) == size:
        return np.frombuffer(data, np.uint8).copy()
    bits = np.zeros(8 * size, np.uint8)
    bits[np.frombuffer(data, "<u4", len(data) // 4)] = 1
    return np.packbits(bits, bitorder="little")


def _filters(batches, bits: int, min_chars: int):
    from pyspark import TaskContext

    W.release()
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for b in W.slices(batches):
        found: list[int] = []
        for t in W.raw(b.column(0)):
            found += {xxhash.xxh3_64_intdigest(k) for k in set(keys(t)) if _wide(k, min_chars)}
        h, n = np.unique(np.array(found, dtype=np.uint64), return_counts=True)
        p, q = _positions(h, bits)
        again = (_test(once, p) & _test(once, q)) | (n > 1)
        _set(twice, p[again]), _set(twice, q[again])
        _set(once, p), _set(once, q)
    part = TaskContext.get().partitionId()
    for i in range(0, len(once), SLICE):
        o, t = once[i : i + SLICE], twice[i : i + SLICE]
        if o.any():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i // SLICE], pa.int32()), "part": pa.array([part], pa.int32()), "once": [_packed(o)], "twice": [_packed(t)]})


def _merge(table: pa.Table) -> pa.Table:
    once = twice = None
    for o, t in zip(table["once"].to_pylist(), table["twice"].to_pylist()):
        o, t = _unpacked(o, SLICE), _unpacked(t, SLICE)
        if once is None:
            once, twice = o, t
        else:
            twice |= t | (once & o)
            once |= o
    return pa.table({"slice": table["slice"][:1], "part": table["part"][:1], "once": pa.array([_packed(once)], pa.binary()), "twice": pa.array([_packed(twice)], pa.binary())})


def filter_bits(docs: DataFrame, text: str) -> int:
    """A power of two: a bit for every eight bytes of the texts or more, by the optimizer's estimate, between ``LEAST_BITS`` and ``MOST_BITS``.

    A line has some tens or hundreds of bytes, so that is several bits a line. Where nothing is known of the
    size (a table made in memory) it is 2^26.
    """
    size = int(str(docs.select(text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:
        return 1 << 26
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(0, size - 1) >> 3).bit_length()))


def twice_seen(docs: DataFrame, text: str = "text", bits: int = 1 << 26, min_chars: int = 1) -> bytes:
    """The merged filter of keys that two or more rows may hold: ``bits / 8`` bytes, whatever the input."""
    schema = "slice int, part int, once binary, twice binary"
    level = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(partial(_filters, bits=bits, min_chars=min_chars), schema)
    width = docs.rdd.getNumPartitions()
    while True:  # the last round leaves one row a slice, whatever the plan made of the partitions
        level = level.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int") if width > FAN_IN else F.lit(0))
        level = level.groupBy("slice", "part").applyInArrow(_merge, schema)
        if width <= FAN_IN:
            break
        width = -(-width // FAN_IN)
    out = np.zeros(bits // 8, np.uint8)
    for r in level.select("slice", "twice").toLocalIterator():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = _unpacked(bytes(r["twice"]), SLICE)
    return out.tobytes()


def _suspects(texts: list[bytes], twice: np.ndarray, bits: int, min_chars: int):
    """Per text: the digests of its distinct keys that pass the filter."""
    for t in texts:
        own = [k for k in set(keys(t)) if _wide(k, min_chars)]
        if not own:
            yield []
            continue
        p, q = _positions(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)), bits)
        yield [xxhash.xxh3_128_digest(own[i]) for i in np.flatnonzero(_test(twice, p) & _test(twice, q))]


def _count(batches, shared, bits: int, min_chars: int, flush: int = 200_000):
    twice = np.frombuffer(shared.value, np.uint8)
    n: Counter = Counter()
    first: dict[bytes, int] = {}

    def out():
        return pa.RecordBatch.from_pydict({"digest": pa.array(list(n), pa.binary()), "docs": pa.array(list(n.values()), pa.int64()), "first": pa.array([first[k] for k in n], pa.int64())})

    for b in W.slices(batches):
        ids = b.column(1).to_pylist()
        for i, found in zip(ids, _suspects(W.raw(b.column(0)), twice, bits, min_chars)):
            n.update(found)
            i = UNNAMED if i is None else i
            for d in found:
                if i < first.get(d, 1 << 63):
                    first[d] = i
        if len(n) > flush:
            yield out()
            n.clear(), first.clear()
    if n:
        yield out()


def _per_doc(batches, shared, bits: int, min_chars: int):
    twice = np.frombuffer(shared.value, np.uint8)
    for b in W.slices(batches):
        keep, digests = [], []
        for k, found in zip(b.column(1).to_pylist(), _suspects(W.raw(b.column(0)), twice, bits, min_chars)):
            keep += [k] * len(found)
            digests += found
        yield pa.RecordBatch.from_pydict({"doc_key": pa.array(keep, pa.int64()), "digest": pa.array(digests, pa.binary())})


def _rewrite_one(text: bytes, own: int | None, hot, first: bool) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    low = keys(text)
    if len(low) != len(lines):  # pragma: no cover - lower() keeps every newline
        raise AssertionError("lines and keys differ")
    out, met = [], set()
    for line, k in zip(lines, low):
        d = xxhash.xxh3_128_digest(k) if k else None
        if d is None or d not in hot or (first and hot[d] == own and not (d in met or met.add(d))):
            out.append(line)
    return b"\n".join(out), len(lines), len(lines) - len(out)


def _rewrite(batches, text: str, own: str, names: tuple[str, str], first: bool, found: str | None = None, shared=None):
    for b in W.slices(batches, text):
        cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        ids = [UNNAMED if i is None else i for i in cols.pop(own).to_pylist()]
        if shared is None:
            hots = [{x["digest"]: x["first"] for x in d or []} for d in cols.pop(found).to_pylist()]
        else:
            hots = [shared.value] * b.num_rows
        done = [_rewrite_one(t, i, h, first) for t, i, h in zip(W.raw(cols[text]), ids, hots)]
        cols[text] = pa.array([d[0] for d in done], pa.binary()).cast(pa.string())
        cols[names[0]], cols[names[1]] = pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def dedup_lines(spark: SparkSession, docs: DataFrame, text: str = "text", ident: str = "doc_id", min_docs: int = 2, keep: str = "first", min_chars: int = 1, bits: int | None = None, hot_bound: int = 500_000, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the lines dropped whose key ``min_docs`` rows or more hold.

    keep="first" leaves the first such line of the row with the smallest ``ident`` (null counts as
    the largest; rows that share that id each keep one), keep="none" leaves none. Rows count as
    documents, so an exactly repeated row counts twice; within a row a key counts once.

    Null text is an empty text, an empty text is one empty line, empty keys (and those of fewer
    than ``min_chars`` code points) never repeat. Texts of any length are read and written whole.
    Ids are compared as numbers; those that aren't whole numbers (also as text) by their 64-bit
    hash. All columns of ``docs`` stay, whatever their names, with ``text`` rewritten and the two
    ``counts`` added, in place of columns of those names. An empty table gives an empty table.

    ``bits`` is the size of the filters (a power of two at least), by the size of the input where
    None. Up to ``hot_bound`` digests of repeated lines are broadcast, beyond that they are joined.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep must be 'first' or 'none'")
    docs = docs.drop(*counts)
    bits = 1 << max(20, int((bits or filter_bits(docs, text)) - 1).bit_length())
    sc, scratch = spark.sparkContext, runtime.Scratch(spark)
    shared = sc.broadcast(twice_seen(docs, text, bits, min_chars))
    body = F.col(f"`{text}`").cast("string")
    narrow = docs.select(body.alias("text"), samples.long_id(docs, ident).alias("id"))
    hot = narrow.mapInArrow(partial(_count, shared=shared, bits=bits, min_chars=min_chars), "digest binary, docs long, first long")
    hot = scratch.table(hot.groupBy("digest").agg(F.sum("docs").alias("docs"), F.min("first").alias("first")).filter(F.col("docs") >= min_docs), "hot")
    fields = [T.StructField(text, T.StringType()) if f.name == text else f for f in docs.schema.fields]
    schema = T.StructType(fields + [T.StructField(n, T.LongType()) for n in counts])
    own, key, per_key, found = unused([*docs.columns, *counts], "own", "key", "per_key", "found")
    rows = docs.withColumn(own, samples.long_id(docs, ident)).withColumn(text, F.coalesce(body, F.lit("")))
    step = partial(_rewrite, text=text, own=own, names=counts, first=keep == "first")
    known = hot.agg(F.count("*"), F.sum("docs")).first()
    if known[0] <= hot_bound:
        few = sc.broadcast({bytes(r["digest"]): r["first"] for r in hot.select("digest", "first").collect()})
        return samples.arrow_rows(rows, partial(step, shared=few), schema)
    # A row's own hot lines are joined to it by what its id and text are; a line of nearly all texts is spread.
    mark = F.xxhash64(F.col(own), F.col(f"`{text}`"))
    held = rows.select(F.col(f"`{text}`").alias("text"), mark.alias("doc_key")).mapInArrow(partial(_per_doc, shared=shared, bits=bits, min_chars=min_chars), "doc_key long, digest binary").distinct()
    held = spread_join(held, hot.select("digest", "first"), ["digest"], hot, "docs", known[1], ["doc_key"])
    held = held.groupBy(F.col("doc_key").alias(per_key)).agg(F.collect_list(F.struct("digest", "first")).alias(found))
    joined = rows.withColumn(key, mark).join(held, F.col(key) == F.col(per_key), "left").drop(key, per_key)
    return samples.arrow_rows(joined, partial(step, found=found), schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(spark, docs, min_docs=10, keep="none")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


_STRIP = "regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')"
_LOWER = f"translate({_STRIP}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op9_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, i, list_extract(parts, i) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)),
keyed AS (SELECT doc_id, i, line, {_LOWER} AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, hot.k IS NOT NULL AS dropped FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
QUERIES = {"op9_line_dedup": op9_line_dedup}
