"""Approximate nearest neighbours by balanced posting lists.

Centroids come from balanced bisecting k-means on a bounded sample, evened out by rounds in which
full lists charge a price, and are searched through an in-memory neighbour graph. Every vector is
indexed: in its nearest list, and a vector near a boundary in its second nearest as well. A query
opens the lists whose centroids are within a distance ratio of its nearest one; both ratios are
calibrated on the sample, one for the share of boundary vectors, one for the recall.

There are about ``per_root`` * sqrt(N) lists, so a smaller share of the rows is scored as N grows.
Neighbouring lists are searched together, in groups of bounded size; a list that holds a third of
all rows is split over groups by a hash of the id. A query is sent once to each group that has a
list it opens, and groups are repeated for blocks of queries, so no task has more than a bounded
number of either.

Inner products are turned into distances with one more coordinate, sqrt(M^2 - |x|^2) for vectors
(M the largest norm) and 0 for queries, so larger inner product is smaller distance.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import samples

DEGREE, BEAM, EXPAND, ANCHOR = 16, 24, 2, 8


def _bisect(x: np.ndarray, leaf: float, rng: np.random.Generator, out: list[np.ndarray]) -> None:
    """Splits evenly along 2-means directions until a cell holds at most ``leaf`` sample points."""
    if len(x) <= leaf or (x == x[0]).all():
        out.append(x.mean(axis=0))
        return
    c = x[rng.choice(len(x), 2, replace=False)].copy()
    near = np.zeros(len(x), bool)
    for _ in range(6):
        gap = x @ (c[1] - c[0])
        near[:] = False
        near[np.argsort(gap, kind="stable")[: len(x) // 2]] = True
        c = np.stack([x[near].mean(axis=0), x[~near].mean(axis=0)])
    _bisect(x[near], leaf, rng, out)
    _bisect(x[~near], leaf, rng, out)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * (x @ c.T), 0)


def _even(x: np.ndarray, c: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Lloyd rounds in which a list's price rises while it holds more than its share."""
    price = np.zeros(len(c))
    for _ in range(rounds):
        near, far = np.zeros(len(x), np.int64), 0.0
        for lo in range(0, len(x), 2048):
            d = _squares(x[lo : lo + 2048], c)
            near[lo : lo + 2048] = (d + price).argmin(axis=1)
            far += float(d.min(axis=1).sum())
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        price += 0.1 * far / len(x) * np.clip(n * len(c) / len(x) - 1, -0.5, 1)
    return c


@dataclass
class Router:
    """Centroids in the order of the splits, their neighbour graph, the largest norm, and both ratios."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    norm: float
    copy_ratio: float = 1.0
    open_ratio: float = 1.0

    @cached_property
    def halves(self) -> np.ndarray:
        return ((self.centroids**2).sum(axis=1) / 2).astype(np.float32)

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        n = np.sqrt((x * x).sum(axis=1))
        if query:
            return np.concatenate([x * (self.norm / n)[:, None], np.zeros((len(x), 1))], axis=1)
        return np.concatenate([x, np.sqrt(np.maximum(self.norm**2 - n * n, 0))[:, None]], axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two nearest centroids met by a beam over the graph, and their distances, for each row."""
        k, c, half = len(self.centroids), self.centroids.astype(np.float32), self.halves
        width = min(BEAM, k)
        x32 = x.astype(np.float32)
        out_at, out_d = np.zeros((len(x), min(2, k)), np.int64), np.zeros((len(x), min(2, k)))
        live = np.arange(len(x))
        seen = np.zeros((len(x), k), bool)
        seen[:, self.entries] = True
        d = half[self.entries] - x32 @ c[self.entries].T  # half the squared distance, less the row's own part
        pick = np.argsort(d, axis=1, kind="stable")[:, :width]
        d, at = np.take_along_axis(d, pick, axis=1), self.entries[pick]
        done = np.zeros(d.shape, bool)
        while True:
            own = np.where(done, np.inf, d)
            pick = np.argpartition(own, min(EXPAND, own.shape[1]) - 1, axis=1)[:, :EXPAND]
            go = np.isfinite(np.take_along_axis(own, pick, axis=1))
            end = ~go.any(axis=1)
            if end.any():
                first = np.argsort(d[end], axis=1, kind="stable")[:, : out_at.shape[1]]
                out_at[live[end]] = np.take_along_axis(at[end], first, axis=1)
                live, d, at, done, pick, go = live[~end], d[~end], at[~end], done[~end], pick[~end], go[~end]
            if not len(live):
                break
            rows = np.arange(len(live))[:, None]
            done[rows, pick] = True
            near = np.sort(self.graph[at[rows, pick]].reshape(len(live), -1), axis=1)
            fresh = ~seen[live[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[live[:, None], near] = True
            far = np.full(near.shape, np.inf, np.float32)
            r, j = np.nonzero(fresh)
            to = near[r, j]
            far[r, j] = half[to] - np.einsum("nd,nd->n", x32[live[r]], c[to])
            d, at, done = np.concatenate([d, far], axis=1), np.concatenate([at, near], axis=1), np.concatenate([done, ~fresh], axis=1)
            keep = np.argpartition(d, width - 1, axis=1)[:, :width]
            d, at, done = d[rows, keep], at[rows, keep], done[rows, keep]
            done |= ~np.isfinite(d)
        for i in range(out_at.shape[1]):
            out_d[:, i] = np.sqrt(((x - self.centroids[out_at[:, i]]) ** 2).sum(axis=1))
        return out_at, out_d

    def within(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Which lists lie within ``ratio`` of the distance to the ``ANCHOR``-th nearest centroid.

        Best-first over the graph until all those are expanded.
        """
        k = len(self.centroids)
        d, done = np.full((len(x), k), np.inf), np.zeros((len(x), k), bool)
        d[:, self.entries] = np.sqrt(_squares(x, self.centroids[self.entries]))
        rows, b = np.arange(len(x)), min(k, max(8, k // 16))
        anchor = min(ANCHOR, k) - 1
        while len(rows):
            own = np.where(done[rows], np.inf, d[rows])
            nodes = np.argpartition(own, b - 1, axis=1)[:, :b]
            value = np.take_along_axis(own, nodes, axis=1)
            go = np.isfinite(value) & (value <= np.partition(d[rows], anchor, axis=1)[:, anchor : anchor + 1] * ratio)
            r, c = np.nonzero(go)
            if not len(r):
                break
            node = nodes[r, c]
            done[rows[r], node] = True
            near = self.graph[node]
            i, j = np.nonzero(np.isinf(d[rows[r][:, None], near]))
            qi, to = np.divmod(np.unique(rows[r][i] * np.int64(k) + near[i, j]), k)
            for lo in range(0, len(qi), 65_536):
                own_q, own_c = qi[lo : lo + 65_536], to[lo : lo + 65_536]
                d[own_q, own_c] = np.sqrt(((x[own_q] - self.centroids[own_c]) ** 2).sum(axis=1))
            rows = rows[go.any(axis=1)]
        return d <= np.partition(d, anchor, axis=1)[:, anchor : anchor + 1] * ratio

    def members(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of lifted vectors: the nearest list, and the second one of boundary vectors."""
        at, d = self.nearest(x)
        ok = d <= d[:, :1] * self.copy_ratio
        ok[:, 0] = True
        r, c = np.nonzero(ok)
        return r, at[r, c]


def build(sample: np.ndarray, norm: float, total: int, per_root: float, copy_share: float, target: float, k: int, seed: int = 11) -> Router:
    rng = np.random.default_rng(seed)
    router = Router(np.zeros((0, 0)), np.zeros((0, 0), np.int64), np.zeros(0, np.int64), norm)
    lifted = router.lift(sample, False)
    lists = int(np.clip(round(per_root * total**0.5), 1, max(1, len(sample) // 4)))
    cells: list[np.ndarray] = []
    _bisect(lifted, max(1.0, len(lifted) / lists), rng, cells)
    c = _even(lifted, np.stack(cells))
    c = c[np.sort(np.unique(c, axis=0, return_index=True)[1])]
    degree = min(DEGREE, len(c) - 1)
    graph = np.zeros((len(c), degree), np.int64)
    for lo in range(0, len(c), 512):
        gap = _squares(c[lo : lo + 512], c)
        gap[np.arange(len(gap)), np.arange(lo, lo + len(gap))] = -1  # itself first
        graph[lo : lo + 512] = np.argsort(gap, axis=1, kind="stable")[:, 1 : degree + 1]
    ring = np.stack([(np.arange(len(c)) + s) % len(c) for s in (1, len(c) - 1)], axis=1)  # keeps the graph connected
    router.centroids, router.graph = c, np.concatenate([graph, ring], axis=1)
    router.entries = np.unique(np.linspace(0, len(c) - 1, min(len(c), 16 + int(4 * len(c) ** 0.5))).astype(np.int64))
    if len(c) == 1:
        return router
    # Calibration: first the share of boundary vectors, then the ratio at which ``target`` of near pairs are met.
    some = lifted[rng.choice(len(lifted), min(len(lifted), 8192), replace=False)]
    far = np.concatenate([router.nearest(some[lo : lo + 1024])[1] for lo in range(0, len(some), 1024)])
    router.copy_ratio = float(np.quantile(far[:, 1] / np.maximum(far[:, 0], 1e-12), copy_share))
    asks = np.sort(rng.choice(len(sample), min(len(sample), 512), replace=False))
    take = min(max(1, round(k * len(sample) / max(total, 1))), len(sample) - 1)
    need = []
    for lo in range(0, len(asks), 64):
        own = asks[lo : lo + 64]
        dots = sample[own] @ sample.T
        dots[np.arange(len(own)), own] = -np.inf
        best = np.argpartition(-dots, take - 1, axis=1)[:, :take]
        r, member = router.members(lifted[best.ravel()])
        q = np.sqrt(_squares(router.lift(sample[own], True), c))
        reach = np.full(best.size, np.inf)
        np.minimum.at(reach, r, q[r // take, member])
        anchor = min(ANCHOR, len(c)) - 1
        need.append(reach.reshape(len(own), take) / np.maximum(np.partition(q, anchor, axis=1)[:, anchor], 1e-12)[:, None])
    router.open_ratio = float(np.quantile(np.concatenate(need), target))
    return router


def valid(vector: Column) -> Column:
    """Not null, not empty, finite throughout, not zero."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _assign(batches, shared):
    router = shared.value
    step = max(16, 2_000_000 // len(router.centroids))
    for b in batches:
        for lo in range(0, b.num_rows, min(step, 1024)):
            s = b.slice(lo, min(step, 1024))
            r, c = router.members(router.lift(_matrix(s.column(1)), False))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), s.column(0).take(pa.array(r)), s.column(1).take(pa.array(r))], names=["list", "vec_id", "vector"])


def groups(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Each list's first group and how many groups it takes: short lists share one while they fit."""
    first, count, at, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, block
    for i, n in enumerate(sizes.tolist()):
        if n > block:  # on its own
            at += room < block
            first[i], count[i] = at, -(-n // block)
            at, room = at + count[i], block
            continue
        if n > room:
            at, room = at + 1, block
        first[i], room = at, room - n
    return first, count


def _open(batches, shared, sizes, first, count, least: int):
    router = shared.value
    step = max(8, 2_000_000 // len(router.centroids))
    for b in batches:
        for lo in range(0, b.num_rows, min(step, 512)):
            s = b.slice(lo, min(step, 512))
            x = router.lift(_matrix(s.column(1)), True)
            ok = router.within(x, router.open_ratio)
            for i in np.flatnonzero((ok * sizes[None]).sum(axis=1) < least).tolist():  # too few rows behind the ratio: the nearest lists that hold enough
                order = np.argsort(((router.centroids - x[i]) ** 2).sum(axis=1), kind="stable")
                ok[i, order[: int(np.searchsorted(np.cumsum(sizes[order]), least)) + 1]] = True
            r, c = np.nonzero(ok & (sizes > 0)[None])
            n = count[c]
            r, c, sub = np.repeat(r, n), np.repeat(c, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            group = first[c] + sub
            order = np.lexsort((c, group, r))
            r, c, group = r[order], c[order], group[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(r) != 0) | (np.diff(group) != 0)])) if len(r) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(r)), pa.int32()), pa.array(c, pa.int32()))
            take = pa.array(r[new])
            yield pa.RecordBatch.from_arrays([pa.array(group[new], pa.int64()), s.column(0).take(take), s.column(1).take(take), lists], names=["group", "vec_id", "vector", "lists"])


class Group:
    """The vectors of a group by list; equal vectors of a list are one run, scored once, so their ties are exact."""

    def __init__(self, ids: np.ndarray, lists: np.ndarray, vectors: np.ndarray):
        vectors = np.ascontiguousarray(vectors) + 0.0  # -0.0 is 0.0
        kind = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
        order = np.lexsort((ids, kind, lists))
        ids, kind, lists = ids[order], kind[order], lists[order]
        new = np.ones(len(ids), bool)
        new[1:] = (lists[1:] != lists[:-1]) | (kind[1:] != kind[:-1])
        self.ids, self.begin = ids, np.append(np.flatnonzero(new), len(ids))
        self.vectors, run_list = vectors[order][new], lists[new]
        self.lists, start = np.unique(run_list, return_index=True)
        self.start = np.append(start, len(run_list))

    def top(self, ids: np.ndarray, q: np.ndarray, opened: list[np.ndarray], k: int) -> list[tuple[int, int, float]]:
        """The k best distinct ids for each query among the lists it opens."""
        row = np.repeat(np.arange(len(q)), [len(o) for o in opened])
        lst = np.searchsorted(self.lists, np.concatenate(opened))
        score = np.full((len(q), len(self.vectors)), -np.inf)
        order = np.argsort(lst, kind="stable")
        cuts = np.searchsorted(lst[order], np.arange(len(self.lists) + 1))
        for i in range(len(self.lists)):
            own, a, b = row[order[cuts[i] : cuts[i + 1]]], self.start[i], self.start[i + 1]
            if len(own):
                score[own, a:b] = q[own] @ self.vectors[a:b].T
        out, n = [], score.shape[1]
        first = np.argpartition(-score, 2 * k + 1, axis=1)[:, : 2 * k + 2] if n > 2 * k + 2 else np.tile(np.arange(n), (len(q), 1))
        for i in range(len(q)):
            best, m = first[i], 2 * k + 2
            while True:
                best = best[np.isfinite(score[i, best])]
                exact = (self.vectors[best] * q[i][None]).sum(axis=1)
                rows = {}
                for s, u in sorted(zip((-exact).tolist(), best.tolist())):
                    for x in self.ids[self.begin[u] : self.begin[u + 1]][: k + 1].tolist():
                        if x != ids[i] and (x not in rows or rows[x] > s):
                            rows[x] = s
                found = sorted((s, x) for x, s in rows.items())[:k]
                # Nothing beyond the best m may reach the last of them.
                if m >= n or len(best) < m or (len(found) == k and -found[-1][0] > score[i, best].min() + 1e-9):
                    break
                m = min(n, 2 * m)
                best = np.argpartition(-score[i], m - 1)[:m] if m < n else np.arange(n)
            out += [(int(ids[i]), x, -s) for s, x in found]
        return out


def _search(batches, k: int, most: int = 512):
    """Streams groups: the vectors of a group first, then its queries in blocks."""
    now, group, out = None, None, []
    held: list[tuple] = []  # (ids, lists, vectors) of the group
    asks: list[tuple] = []

    def flush():
        nonlocal group, out
        if asks and held:
            if group is None:
                group = Group(*(np.concatenate(x) for x in zip(*held)))
            ids, opened, q = (([y for x in asks for y in x[i]]) for i in range(3))
            for lo in range(0, len(ids), most):
                out += group.top(np.array(ids[lo : lo + most], np.int64), np.stack(q[lo : lo + most]), opened[lo : lo + most], k)
        asks.clear()

    def batch():
        c = list(zip(*out)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
        cuts = [0, *(np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = b.slice(lo, hi - lo)
            if tuple(key[:2, lo]) != now:
                flush()
                now, group = tuple(key[:2, lo]), None
                held.clear()
            ids, vectors = part.column(3).to_numpy(zero_copy_only=False), _matrix(part.column(4))
            at = part.column(5)
            if key[2, lo] == 0:
                held.append((ids, at.flatten().to_numpy(), vectors))
            else:
                asks.append((ids.tolist(), [np.array(x, np.int64) for x in at.to_pylist()], list(vectors)))
                if sum(len(x[0]) for x in asks) >= most:
                    flush()
        if len(out) > 50_000:
            yield batch()
            out = []
    flush()
    yield batch()


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 20, ident: str = "vec_id", vector: str = "embedding", sample: int = 32_768, values: int = 16_000_000, per_root: float = 8.0, copy_share: float = 0.2, target: float = 0.94, block: int = 8_192, asks: int = 65_536) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (inner product in double) of each query's ``k`` nearest.

    Candidates are all rows of ``vectors`` but those with the query's own id; ties go to smaller
    ids. Vectors that are null, empty, zero, hold null or non-finite components, or are not as
    long as most of the valid ones take no part, nor do rows with a null id. Repeated rows of one
    id count once, with their best score. Fewer than ``k`` candidates are all returned. Only the
    two named columns are read, so others can't clash. Empty tables give an empty table.

    At most ``sample`` vectors and ``values`` components, drawn by a hash of the row, fit the
    centroids and both ratios; every vector is indexed. There are ``per_root`` * sqrt(N) lists, at
    most a quarter of the sample. About ``copy_share`` of the vectors are in two lists.
    ``target`` is the share of near pairs of the sample that the opening ratio must keep. A task
    holds ``block`` vectors; a group is repeated for every ``asks`` queries.
    """
    scratch = runtime.Scratch(spark)

    def clean(d: DataFrame) -> DataFrame:
        d = d.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("vec_id").isNotNull() & valid(F.col("vector")))
        # Equal rows would meet in one group whatever the hash; where ids repeat they are made one first.
        return d.dropDuplicates() if d.groupBy("vec_id").count().filter("count > 1").limit(1).count() else d

    vs, qs = clean(vectors), clean(queries)
    kinds = vs.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)).alias("norm")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not kinds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total, norm = kinds[0]["dim"], kinds[0]["n"], float(np.sqrt(kinds[0]["norm"]))
    vs, qs = vs.filter(F.size("vector") == dim), qs.filter(F.size("vector") == dim)
    most = max(1, min(sample, values // dim))
    mark = samples.mark("vec_id", "vector")
    drawn = vs.select(mark.alias("mark"), "vector").filter(F.col("mark") < samples.share(1.1 * most / total)).limit(2 * most).toArrow().combine_chunks()
    order = np.argsort(drawn["mark"].to_numpy(), kind="stable")[:most]
    router = build(_matrix(drawn["vector"].combine_chunks())[order], norm, total, per_root, copy_share, target, k)
    shared = spark.sparkContext.broadcast(router)
    posted = scratch.table(vs.mapInArrow(partial(_assign, shared=shared), "list int, vec_id long, vector array<double>"), "lists")
    sizes = np.zeros(len(router.centroids), np.int64)
    for r in posted.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    first, count = groups(sizes, block)
    places = spark.createDataFrame([(i, f, n) for i, (f, n) in enumerate(zip(first.tolist(), count.tolist()))], "list int, first long, n long")
    opened = qs.mapInArrow(partial(_open, shared=shared, sizes=sizes, first=first, count=count, least=2 * (k + 1)), "group long, vec_id long, vector array<double>, lists array<int>")
    parts = -(-qs.count() // asks) or 1
    group = F.col("first") + F.pmod(F.xxhash64("vec_id", "vector"), F.col("n"))
    held = posted.join(F.broadcast(places), "list").select(group.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).cast("byte").alias("kind"), "vec_id", "vector", F.array("list").alias("lists"))
    held = held.unionByName(opened.select("group", F.pmod(F.xxhash64("vec_id", "vector"), parts).cast("int").alias("part"), F.lit(1).cast("byte").alias("kind"), "vec_id", "vector", "lists"))
    held = held.repartition("group", "part").sortWithinPartitions("group", "part", "kind")
    found = held.mapInArrow(partial(_search, k=k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def exact(vectors: DataFrame, queries: DataFrame, k: int = 20, ident: str = "vec_id", vector: str = "embedding") -> list[tuple[int, int, int, float]]:
    """Brute force on the driver, for tests and for measuring recall on bounded tables; a repeated id counts with its best score."""
    get = lambda d: [(r[0], np.array(r[1], np.float64)) for r in d.select(ident, F.col(vector).cast("array<double>").alias("v")).filter(F.col(ident).isNotNull() & valid(F.col("v"))).collect()]
    vs, out = get(vectors), []
    ids, m = np.array([i for i, _ in vs], np.int64), np.stack([v for _, v in vs])
    for q, x in get(queries):
        s = (m * x[None]).sum(axis=1)
        best: dict[int, float] = {}
        for i in np.lexsort((ids, -s)).tolist():
            if ids[i] != q and int(ids[i]) not in best:
                best[int(ids[i])] = float(s[i])
                if len(best) == k:
                    break
        out += [(q, n + 1, i, v) for n, (i, v) in enumerate(best.items())]
    return out


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = runtime.table(spark, sf_dir, "embeddings")
    return nearest(spark, vectors, vectors.filter(F.col("vec_id") % 20 == 0))


QUERIES = {"op10_nearest": op10_nearest}
SQL: dict[str, str] = {}
