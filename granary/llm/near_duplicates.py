"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts with equal shingle sets are one class. A class's tokens have a global order, rarest first,
and two classes that are similar enough share at least ``l`` tokens of their ``l``-prefixes. Each
class picks its own ``l``: a longer prefix costs more list entries but leaves fewer candidates,
and the estimated cost of both decides. A pair must share the smaller ``l`` of its two.

The order comes from a sketch of fixed size (hashed counts of all tokens of all texts); any
order is right, a good one is cheap. Groups of many near copies would still meet in every list,
so classes that share bands of minimum hashes form blocks of bounded size first: blocks take the place
of classes in the lists (union of prefixes, smallest ``l``), each block pair that qualifies is
verified once, exactly, by matrix products over the sets, and only link counts and a spanning
forest leave the task. No pair of rows is ever emitted within a group.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import samples
from granary.llm import words as W
from granary.operators.components import connected_components
from granary.operators.skew import spread_join, unused

BUCKETS, SLICE, FAN_IN, BANDS, ROWS = 1 << 20, 1 << 16, 32, 4, 3
BYTES = 1_000_000  #: of text at once, so that the arrays stay in a core's cache
MOST = 8  #: the largest l that is considered
TOKENS = 4_000_000  #: of the sets that are verified together


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each lower-cased text."""
    ids, starts = W.hash_words(column, lower=True)
    g = W.grams(ids, n)
    out = []
    for a, b in zip(starts.tolist(), starts[1:].tolist()):
        if b - a >= n:
            s = np.sort(g[a : b - n + 1])
            new = np.empty(len(s), bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            out.append(s[new])
        else:
            out.append(W.grams(ids[a:b], b - a) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def class_key(tokens: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """``BANDS`` numbers a set, each of ``ROWS`` minimum hashes: near copies share most of them."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k in range(BANDS * ROWS):
            low = np.minimum.reduceat(flat * W._MULT[40 + k], at)
            out[full, k // ROWS] = W.mix(out[full, k // ROWS] + low)
    return out.view(np.int64)


def _first(batches, n: int):
    """Rows of kind 0: a text's class and bands; rows of kind 1: the task's sketch."""
    from pyspark import TaskContext

    W.release()
    sketch = np.zeros(BUCKETS, np.int64)
    schema = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("class_key", pa.binary()), ("hashes", pa.list_(pa.int64())), ("part", pa.int32()), ("counts", pa.binary())])
    for b in W.slices(batches, max_bytes=BYTES):
        sets = shingle_sets(b.column(1), n)
        flat = np.concatenate(sets)
        sketch += np.bincount((flat & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        hashes = pa.FixedSizeListArray.from_arrays(pa.array(bands(sets).ravel()), BANDS).cast(pa.list_(pa.int64()))
        k = len(sets)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int8)), b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) for s in sets], pa.binary()), hashes, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
    part = TaskContext.get().partitionId()
    for i in range(0, BUCKETS, SLICE):
        if sketch[i : i + SLICE].any():
            one = lambda t, v: pa.array([v], t)
            yield pa.RecordBatch.from_arrays([one(pa.int8(), 1), one(pa.int64(), i // SLICE), one(pa.int64(), None), one(pa.int64(), None), one(pa.binary(), None), one(pa.list_(pa.int64()), None), one(pa.int32(), part), one(pa.binary(), sketch[i : i + SLICE].tobytes())], schema=schema)


def _add(t: pa.Table) -> pa.Table:
    total = np.zeros(SLICE, np.int64)
    for c in t["counts"].to_pylist():
        total += np.frombuffer(c, np.int64)
    return pa.table({"slice": t["slice"][:1], "part": t["part"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _sketch(first: DataFrame, parts: int) -> np.ndarray:
    """The corpus's token counts by bucket, merged with bounded fan-in: ``BUCKETS`` numbers whatever the input."""
    level = first.filter("kind = 1").select(F.col("doc_id").alias("slice"), "part", "counts")
    while True:  # the last round leaves one row a slice, whatever the plan made of the partitions
        group = F.floor(F.col("part") / FAN_IN).cast("int") if parts > FAN_IN else F.lit(0)
        level = level.withColumn("part", group).groupBy("slice", "part").applyInArrow(_add, "slice long, part int, counts binary")
        if parts <= FAN_IN:
            break
        parts = -(-parts // FAN_IN)
    out = np.zeros(BUCKETS, np.int64)
    for r in level.toLocalIterator():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    return out


def prefix(tokens: np.ndarray, counts: np.ndarray, base: float, percent: int, verify: float = 4.0) -> tuple[np.ndarray, int]:
    """A class's prefix and its ``l``. Costs: a unit per list entry met, ``verify`` per estimated candidate.

    A candidate has ``l`` entries of the prefix's lists at least, so there are at most
    (sum of list lengths) / l of them.
    """
    n = len(tokens)
    overlap = -(-percent * n // 100)
    short = n - overlap
    most = min(MOST, overlap)
    c = counts[(tokens & np.uint64(BUCKETS - 1)).astype(np.int64)]
    k = min(short + most, n)
    order = np.lexsort((tokens, c))[:k]
    lists = np.cumsum(np.maximum(c[order] - base, 0.0))
    ls = np.arange(1, most + 1)
    cost = lists[short + ls - 1] * (1 + verify / ls) + ls
    best = int(ls[int(np.argmin(cost))])
    return tokens[order[: short + best]], best


def _prefixes(batches, shared, n: int, percent: int):
    counts = np.frombuffer(shared.value[0], np.int64)
    seen: set[bytes] = set()
    for b in W.slices(batches, max_bytes=BYTES):
        rows = []
        for s in shingle_sets(b.column(0), n):
            key = class_key(s)
            if key is None or key in seen:
                continue
            if len(seen) < 500_000:
                seen.add(key)
            p, need = prefix(s, counts, shared.value[1], percent)
            rows.append((key, len(s), need, p.view(np.int64)))
        if rows:
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.list_(pa.int64()))], names=["class_key", "size", "need", "tokens"])


def _sets(batches, n: int, shared=None):
    wanted = None if shared is None else shared.value
    seen: set[bytes] = set()
    for b in W.slices(batches, max_bytes=BYTES):
        if wanted is not None:
            keys = b.column(1).to_numpy()
            at = np.minimum(np.searchsorted(wanted, keys), max(0, len(wanted) - 1))
            b = b.filter(pa.array(wanted[at] == keys if len(wanted) else np.zeros(len(keys), bool)))
        rows = []
        for s in shingle_sets(b.column(0), n) if b.num_rows else []:
            key = class_key(s)
            if key is None or key in seen:
                continue
            if len(seen) < 500_000:
                seen.add(key)
            rows.append((key, s.tobytes()))
        if rows:
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), pa.array(c[1], pa.binary())], names=["class_key", "tokens"])


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Intersection sizes of sorted sets, exactly: 0/1 matrices over the tokens both sides have."""
    if len(a) == 1 and len(b) == 1:
        return np.array([[len(np.intersect1d(a[0], b[0], assume_unique=True))]])
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    vocabulary = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(vocabulary):
        return out.astype(np.int64)
    coded = []
    for side, flat in ((a, flat_a), (b, flat_b)):
        row = np.repeat(np.arange(len(side)), [len(s) for s in side])
        at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
        own = vocabulary[at] == flat
        order = np.argsort(at[own], kind="stable")
        coded.append((row[own][order], at[own][order]))
    for lo in range(0, len(vocabulary), width):
        m = []
        for side, (row, at) in zip((a, b), coded):
            i, j = np.searchsorted(at, [lo, lo + width])
            x = np.zeros((len(side), min(width, len(vocabulary) - lo)), np.float32)
            x[row[i:j], at[i:j] - lo] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _roots(links: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each node's component among ``n`` nodes with the given links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[links[:, 0]], root[links[:, 1]])
        new = root.copy()
        np.minimum.at(new, links[:, 0], low)
        np.minimum.at(new, links[:, 1], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


FULL, REST, CROSS = 0, 1, 2  #: pairs a unit checks: all; all but those within side 0; those between the sides


def _check(rows: list[tuple], mode: int, percent: int) -> list[tuple[bytes, bytes, int]]:
    """(class, a class it is linked with through the unit, linked documents) of one unit."""
    rows = list({(r[0], r[1]): r for r in rows}.values())  # a text may have been read by several tasks
    side = np.array([r[0] for r in rows])
    sets, docs = [np.frombuffer(r[3], np.uint64) for r in rows], np.array([r[2] for r in rows])
    size = np.array([len(s) for s in sets])
    at = []
    for x, y in {FULL: ((0, 0), (0, 1), (1, 1)), REST: ((0, 1), (1, 1)), CROSS: ((0, 1),)}[mode]:
        i, j = np.flatnonzero(side == x), np.flatnonzero(side == y)
        if not len(i) or not len(j) or (x == y and len(i) == 1):
            continue
        inter = overlaps([sets[k] for k in i], [sets[k] for k in j])
        r, c = np.nonzero(100 * inter >= percent * (size[i][:, None] + size[j][None, :] - inter))
        at.append(np.stack([i[r], j[c]], axis=1)[(r < c) if x == y else slice(None)])
    links = np.concatenate(at) if at else np.zeros((0, 2), np.int64)
    if not len(links):
        return []
    roots, got = _roots(links, len(rows)), np.zeros(len(rows), np.int64)
    np.add.at(got, links[:, 0], docs[links[:, 1]])
    np.add.at(got, links[:, 1], docs[links[:, 0]])
    return [(rows[i][1], rows[roots[i]][1], int(got[i])) for i in np.flatnonzero(got)]


def _verify(batches, percent: int):
    """Streams rows sorted by unit; a unit's rows are contiguous and of bounded number."""
    now, rows, out = None, [], []

    def batch():
        c = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.int64())], names=["class_key", "root", "n"])

    for b in batches:
        for u, v, mode, side, key, docs, tokens in zip(*(c.to_pylist() for c in b.columns)):
            if (u, v, mode) != now:
                out += _check(rows, now[2], percent) if rows else []
                now, rows = (u, v, mode), []
            rows.append((side, key, docs, tokens))
        if len(out) > 10_000:
            yield batch()
            out = []
    out += _check(rows, now[2], percent) if rows else []
    if out:
        yield batch()


def _units(pairs: DataFrame, size: DataFrame, scratch: runtime.Scratch) -> DataFrame:
    """(u, v, mode, side, block): what is verified together, from candidate block pairs (a, b).

    ``size`` has the classes ``n`` of each block and ``fill``, the part of a unit's bounds (number of
    classes, and of tokens) that they take.

    A block joins its largest candidate partner, if that is larger and joins no other itself; so a
    group's left-over blocks travel with its main block once instead of meeting it pair by pair.
    Those that join one block are cut into parts that fill a unit. Candidate pairs that
    no such unit covers are units of their own.
    """
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("block")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("block")))
    best = both.join(size, "block").groupBy("x").agg(F.max(F.struct("n", "block")).alias("best")).withColumnRenamed("x", "block")
    joins = best.join(size, "block").filter(F.col("best") > F.struct("n", "block")).select("block", "fill", F.col("best.block").alias("main"))
    joins = scratch.table(joins, "joins")
    joins = joins.join(joins.select(F.col("block").alias("main")), "main", "left_anti")
    parts = joins.groupBy("main").agg(F.ceil(F.sum("fill")).alias("parts"))
    joins = scratch.table(joins.join(parts, "main").select("block", "main", F.pmod(F.xxhash64("block"), "parts").alias("part")), "units")
    used = joins.select("main", "part").distinct().unionByName(joins.select("main", F.lit(0).cast("long").alias("part")).distinct()).distinct()
    mode = F.when(F.col("part") == 0, FULL).otherwise(REST)
    row = lambda d, u, v, m, side, own: d.select(F.col(u).alias("u"), F.col(v).alias("v"), m.cast("int").alias("mode"), F.lit(side).cast("byte").alias("side"), F.col(own).alias("block"))
    out = row(used, "main", "part", mode, 0, "main").unionByName(row(joins, "main", "part", mode, 1, "block"))
    taken = joins.select("block").union(joins.select("main")).distinct()
    alone = size.filter("n > 1").join(taken, "block", "left_anti").withColumn("part", F.lit(0).cast("long"))
    out = out.unionByName(row(alone, "block", "part", F.lit(FULL), 0, "block"))
    mine = lambda c: joins.select(F.col("block").alias(c), F.struct("main", "part").alias(f"unit_{c}"))
    left = pairs.join(mine("a"), "a", "left").join(mine("b"), "b", "left")
    covered = (F.col("unit_a.main") == F.col("b")) | (F.col("unit_b.main") == F.col("a")) | (F.col("unit_a") == F.col("unit_b"))
    left = scratch.table(left.filter(~F.coalesce(covered, F.lit(False))).select("a", "b"), "cross")
    cross = F.lit(CROSS)
    return out.unionByName(row(left, "a", "b", cross, 0, "a")).unionByName(row(left, "a", "b", cross, 1, "b"))


def near_duplicates(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 90, block: int = 1024, tokens: int = TOKENS, text: str = "text", ident: str = "doc_id", wanted_bound: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, n_similar and component_id for every row of ``docs``.

    Two rows are linked when 100 * |intersection| >= ``percent`` * |union| of their sets of n-word
    shingles (lower-cased A-Z; a shorter text is one shingle). n_similar counts the other rows
    linked directly; component_id is the smallest id reachable. Rows with null or empty text have
    no shingles and no links, and are their own component. Repeated rows are linked with each
    other. A null id stays null: it is counted, and leaves no id to its component unless another
    row has one. Only the two named columns are read. An empty table gives an empty table. All
    links are exact up to collisions of 64-bit shingle hashes within a pair of texts.

    Texts of any length are read whole. ``block`` classes, or ``tokens`` shingles where those are
    fewer classes, are verified against each other at once (two texts at least); up to
    ``wanted_bound`` 8-byte keys of texts to verify are broadcast, beyond that they are joined.
    """
    scratch = runtime.Scratch(spark)
    rows, known, total = _linked(spark, docs, scratch, n, percent, block, tokens, text, ident, wanted_bound)
    out = spread_join(rows.drop("text_key"), known.drop("docs", "component"), ["class_key"], known, "docs", total, ["doc_id", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _linked(spark: SparkSession, docs: DataFrame, scratch: runtime.Scratch, n: int, percent: int, block: int, tokens: int, text: str, ident: str, wanted_bound: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (doc_id, text_key, n_shingles, class_key); classes (class_key, docs, n_similar, component, component_id); rows in all."""
    own = docs.select(samples.long_id(docs, ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = own.withColumn("text_key", F.xxhash64("text"))
    parts = own.rdd.getNumPartitions()
    kinds = "kind byte, doc_id long, text_key long, n_shingles long, class_key binary, hashes array<long>, part int, counts binary"
    first = scratch.table(own.mapInArrow(partial(_first, n=n), kinds), "first")
    sketch = _sketch(first, parts)
    shared = spark.sparkContext.broadcast((sketch.tobytes(), float(np.median(sketch))))
    rows = first.filter("kind = 0").select("doc_id", "text_key", "n_shingles", "class_key", "hashes")

    full = rows.filter(F.col("class_key").isNotNull())
    classes = full.groupBy("class_key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), F.min("hashes").alias("hashes"), F.max("n_shingles").alias("size"))
    classes = scratch.table(classes, "classes")
    # Near copies share most bands. A class goes to its most common band, and then to where most
    # of the classes that share a band with it went, so a group ends in one cluster.
    tried = scratch.table(classes.select("class_key", F.posexplode("hashes").alias("i", "h")), "bands")
    total = rows.count()
    shared_by = scratch.table(tried.groupBy("i", "h").count().filter("count > 1"), "shared")
    common = scratch.table(spread_join(tried, shared_by, ["i", "h"], shared_by, "count", BANDS * total, ["class_key"]), "common")
    went = common.groupBy("class_key").agg(F.max(F.struct("count", -F.col("i"), "h")).alias("b")).select("class_key", F.xxhash64("b").alias("c"))
    most = common.join(went, "class_key").groupBy("i", "h", "c").agg(F.count("*").alias("n")).groupBy("i", "h").agg(F.max(F.struct("n", "c")).alias("m"))
    cluster = spread_join(common, most, ["i", "h"], shared_by, "count", BANDS * total, ["class_key"]).groupBy("class_key").agg(F.max("m").alias("m")).select("class_key", F.col("m.c").alias("c"))
    cluster = scratch.table(cluster, "clusters")
    sized = cluster.join(classes.select("class_key", "size"), "class_key")
    room = scratch.table(sized.groupBy("c").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / block, F.sum("size") / tokens)).alias("blocks")), "room")
    salted = spread_join(cluster, room.drop("n"), ["c"], room, "n", total, ["class_key"]).select("class_key", F.xxhash64("c", F.pmod(F.xxhash64("class_key", F.lit(1)), "blocks")).alias("block"))
    blocks = classes.select("class_key", "text_key", "docs", "size").join(salted, "class_key", "left")
    blocks = blocks.withColumn("block", F.coalesce("block", F.xxhash64("class_key")))
    blocks = scratch.table(blocks, "blocks")

    prefixes = own.select("text").mapInArrow(partial(_prefixes, shared=shared, n=n, percent=percent), "class_key binary, size long, need int, tokens array<long>")
    prefixes = prefixes.join(blocks.select("class_key", "block"), "class_key")
    lists = prefixes.select(F.explode("tokens").alias("token"), "block", "size", "need").repartition("token").groupBy("token", "block")
    lists = lists.agg(F.min("need").alias("need"), F.min("size").alias("low"), F.max("size").alias("high"))
    a, b = (lists.select("token", *[F.col(c).alias(s + c) for c in ("block", "need", "low", "high")]) for s in "ab")
    near = (100 * F.col("ahigh") >= percent * F.col("blow")) & (100 * F.col("bhigh") >= percent * F.col("alow"))
    met = a.join(b, "token").filter((F.col("ablock") < F.col("bblock")) & near)
    met = met.groupBy("ablock", "bblock").agg(F.count("*").alias("shared"), F.min(F.least("aneed", "bneed")).alias("need"))
    pairs = scratch.table(met.filter("shared >= need").select(F.col("ablock").alias("a"), F.col("bblock").alias("b")), "pairs")

    size = scratch.table(blocks.groupBy("block").agg(F.count("*").alias("n"), F.greatest(F.count("*") / block, F.sum("size") / tokens).alias("fill")), "sizes")
    wanted = blocks.join(_units(pairs, size, scratch), "block").select("class_key", "text_key", "docs", "u", "v", "mode", "side")
    wanted = scratch.table(wanted, "wanted")
    keys = wanted.select("text_key").distinct()
    if keys.count() <= wanted_bound:
        few = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in keys.toLocalIterator()], dtype=np.int64)))
        sets = own.filter(F.col("text").isNotNull()).select("text", "text_key").mapInArrow(partial(_sets, n=n, shared=few), "class_key binary, tokens binary")
    else:
        sets = own.join(keys, "text_key", "left_semi").select("text", "text_key").mapInArrow(partial(_sets, n=n), "class_key binary, tokens binary")
    held = sets.hint("merge").join(wanted.drop("text_key"), "class_key").select("u", "v", "mode", "side", "class_key", "docs", "tokens")
    held = held.repartition("u", "v", "mode").sortWithinPartitions("u", "v", "mode")
    links = scratch.table(held.mapInArrow(partial(_verify, percent=percent), "class_key binary, root binary, n long"), "links")

    parts_of = connected_components(links, scratch, "class_key", "root")
    count = links.groupBy("class_key").agg(F.sum("n").alias("others"))
    joined = classes.select("class_key", "docs", "least").join(count, "class_key", "left").join(parts_of.withColumnRenamed("node", "class_key"), "class_key", "left")
    joined = joined.withColumn("component", F.coalesce("component", "class_key"))
    lowest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    known = joined.join(lowest, "component").select("class_key", (F.col("docs") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), "docs", "component", "component_id")
    return rows.select("doc_id", "text_key", "n_shingles", "class_key"), scratch.table(known, "known"), total


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, runtime.table(spark, sf_dir, "documents"))


SQL = {
    "op2_ngram_jaccard": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS s
  FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS u(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(g.n, 0)::BIGINT AS n_similar, l.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN degree g ON g.x = d.doc_id LEFT JOIN least l ON l.x = d.doc_id""",
}
QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}


def keep_one(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 90, text: str = "text", ident: str = "doc_id", bound: int = 2_000_000) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one of the smallest id; all columns stay.

    Of rows of that id in the group, the one whose text has the smallest hash stays; of equal rows,
    one. Rows that share an id but not a text are looked at each. Rows with a null id can't be named
    as dropped, and stay; so do null and empty texts, which are like nothing. Long texts are
    compared whole; columns may have any name. An empty table gives an empty table. Up to ``bound``
    dropped rows are broadcast by id and text hash, beyond that they are joined.
    """
    scratch = runtime.Scratch(spark)
    rows, known, total = _linked(spark, docs, scratch, n, percent, 1024, TOKENS, text, ident, 2_000_000)
    named = rows.filter(F.col("doc_id").isNotNull() & F.col("class_key").isNotNull())
    named = spread_join(named, known.select("class_key", "component"), ["class_key"], known, "docs", total, ["doc_id", "text_key"])
    held = scratch.table(named.groupBy("component", "doc_id", "text_key").count(), "held")
    first = held.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    lost = scratch.table(held.join(first, ["doc_id", "text_key"], "left_anti").select("doc_id", "text_key"), "lost")
    own, key, lost_id, lost_key = unused(docs.columns, "own", "key", "lost_id", "lost_key")
    out = docs.withColumn(own, samples.long_id(docs, ident)).withColumn(key, F.xxhash64(F.col(f"`{text}`").cast("string")))

    def match(marks: DataFrame, how: str, of: DataFrame) -> DataFrame:
        marks = marks.select(F.col("doc_id").alias(lost_id), F.col("text_key").alias(lost_key))
        marks = F.broadcast(marks) if marks.count() <= bound else marks.hint("merge")
        return of.join(marks, (F.col(own) == F.col(lost_id)) & (F.col(key) == F.col(lost_key)), how)

    out = match(lost, "left_anti", out)
    again = held.join(first, ["doc_id", "text_key"], "left_semi").filter("count > 1")
    if again.limit(1).count():
        again = scratch.table(again, "again")
        out = match(again, "left_anti", out).unionByName(match(again, "left_semi", out).dropDuplicates([own, key]))
    return out.drop(own, key)
