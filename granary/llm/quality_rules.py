"""Quality rules: gradient-boosted trees over document statistics.

Statistics are counted on whole texts in numpy, a batch at a time. The trees are grown on
histograms of a bounded labelled sample, with monotonic constraints on chosen statistics (more
symbols, repeats or shouting never raise the score), and flattened into node arrays, so scoring
a batch is one gather a level.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import samples
from granary.llm import words as W

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "chars_a_word", "symbols_a_word", "dup_line_share", "repeat_share", "upper_share", "bangs_a_word", "bars_a_word", "digit_share", "stops_a_word", "words_a_line", "mark_share", "echo_share")
#: -1: the score never rises with it, 1: never falls, 0: free.
MONOTONE = (0, 0, -1, -1, -1, 0, -1, -1, 0, 0, 0, -1, -1)

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [0x20, *range(9, 14)])
_POINT = (_BYTES & 0xC0) != 0x80
_KINDS = np.stack([
    _POINT & ~_SPACE,
    np.isin(_BYTES, list(b"#*$%&|<>")),
    (_BYTES >= 65) & (_BYTES <= 90),
    _BYTES == ord("!"),
    _BYTES == ord("|"),
    (_BYTES >= 48) & (_BYTES <= 57),
    np.isin(_BYTES, list(b".,;:")),
    (_BYTES < 128) & ~_SPACE & ~np.isin(_BYTES, list(b".,;:'-0123456789")) & ~((_BYTES | 32 >= 97) & (_BYTES | 32 <= 122)),
]).astype(np.int64)


def repeat_words(ids: np.ndarray, starts: np.ndarray, window: int = 5) -> np.ndarray:
    """Words of each text that lie in a window that its text has twice or more."""
    n, docs = np.diff(starts), len(starts) - 1
    g = W.grams(ids, window)
    if not len(g):
        return np.zeros(docs, np.int64)
    doc = np.repeat(np.arange(docs), n)
    own = doc[: len(g)] == doc[window - 1 :]
    at = np.flatnonzero(own)
    key = W.mix(g[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    hit = at[twice]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    covered = (np.cumsum(edge[:-1]) > 0).astype(np.int64)
    return samples.sums(covered, starts)


def statistics(texts: list[bytes], cache: W.WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (n x 5) and features (n x 13) of whole texts."""
    words, starts = W.split_all(texts)
    counts = np.zeros((len(texts), len(_KINDS)), np.int64)
    dup, lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            counts[i] = _KINDS @ np.bincount(np.frombuffer(t, np.uint8), minlength=256)
            own = [x for x in t.split(b"\n") if x and not x.isspace()]
            lines[i], dup[i] = len(own), len(own) - len(set(own))
    n = np.diff(starts)
    ids = cache.array(words)
    repeat = repeat_words(ids, starts)
    echo = np.zeros(len(ids), np.int64)
    echo[1:] = ids[1:] == ids[:-1]
    echo[starts[:-1][n > 0]] = 0
    echo = samples.sums(echo, starts)
    base = np.stack([n, counts[:, 0], counts[:, 1], dup, repeat], axis=1)
    w, c = np.maximum(n, 1), np.maximum(counts[:, 0], 1)
    x = [np.log1p(n), counts[:, 0] / w, counts[:, 1] / w, dup / np.maximum(lines, 1), repeat / w, counts[:, 2] / c, counts[:, 3] / w, counts[:, 4] / w, counts[:, 5] / c, counts[:, 6] / w, n / np.maximum(lines, 1), counts[:, 7] / c, echo / w]
    return base, np.stack(x, axis=1)


@dataclass
class Trees:
    """Flat node arrays of all trees; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.prior + self.value[node].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, monotone=MONOTONE, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 2.0, least: float = 1.0) -> Trees:
    """Boosted trees for the log loss. No rows, or rows of one class, give the smoothed prior alone."""
    p = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(p / (1 - p)))
    flat: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def node(value: float) -> int:
        i = len(flat["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", i), ("right", i), ("value", value)):
            flat[k].append(v)
        return i

    if len(np.unique(y)) == 2:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        raw = np.full(len(y), prior)

        def leaf(g: float, h: float, lo: float, hi: float) -> float:
            return float(np.clip(-g / (h + l2), lo, hi))

        def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            i = node(rate * leaf(gs, hs, lo, hi))
            raw[rows] += 0 if level < depth else flat["value"][i]
            best = None
            if level < depth:
                for f, c in enumerate(cuts):
                    gl = np.cumsum(np.bincount(code[rows, f], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, f], h[rows], len(c) + 1))[:-1]
                    gr, hr = gs - gl, hs - hl
                    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs**2 / (hs + l2)
                    vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
                    ok = (hl >= least) & (hr >= least) & (monotone[f] * (vr - vl) >= 0)
                    gain = np.where(ok, gain, -1.0)
                    if len(gain) and gain.max() > (best[0] if best else 1e-6):
                        k = int(gain.argmax())
                        best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
            if best is None:
                if level < depth:
                    raw[rows] += flat["value"][i]
                return i
            _, f, k, vl, vr = best
            mid = (vl + vr) / 2
            down, up = ((lo, mid), (mid, hi)) if monotone[f] > 0 else ((mid, hi), (lo, mid)) if monotone[f] < 0 else ((lo, hi), (lo, hi))
            goes = code[rows, f] <= k
            flat["feature"][i], flat["threshold"][i] = f, float(cuts[f][k])
            flat["left"][i] = split(rows[goes], g, h, level + 1, *down)
            flat["right"][i] = split(rows[~goes], g, h, level + 1, *up)
            return i

        for _ in range(trees):
            q = 1 / (1 + np.exp(-raw))
            roots.append(split(np.arange(len(y)), q - y, np.maximum(q * (1 - q), 1e-6), 0, -np.inf, np.inf))
    a = {k: np.array(v, dtype=np.int64 if k in ("feature", "left", "right") else float) for k, v in flat.items()}
    return Trees(**a, roots=np.array(roots, dtype=np.int64), depth=depth, prior=prior)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 8_000, mod: int = 5, rest: int = 0) -> Trees:
    """Trees from at most ``bound`` labelled documents outside the held-out fold."""
    rows = samples.labelled(docs, labels, label, bound, mod, rest)
    cache, x = W.WordIds(), [np.zeros((0, len(FEATURES)))]
    for lo in range(0, len(rows), 500):
        x.append(statistics([t.encode() for _, t, _ in rows[lo : lo + 500]], cache)[1])
    return grow(np.concatenate(x), np.array([float(r[2]) for r in rows]))


def _score(batches, shared, least: float):
    trees = shared.value
    for b in W.slices(batches):
        base, x = statistics(W.raw(b.column(1)), W.worker_cache("rules", W.WordIds))
        score = trees.score(x)
        n, repeat = base[:, 0], base[:, 4]
        failed = (n < 10) | (100 * repeat > 20 * n)
        cols = {"doc_id": b.column(0)} | {k: pa.array(base[:, i]) for i, k in enumerate(BASE)}
        cols |= {"base_failed": pa.array(failed), "kept": pa.array(~failed & (score >= least)), "score": pa.array(score)}
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.5, bound: int = 8_000, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the trees' score, for every row of ``docs``.

    Null or empty text has no words, so it fails the base rules. Null ids stay null; repeated rows
    are scored each; only the two named columns are read, so others can't clash. An empty table
    gives an empty table. Without labels of both classes the trees are a constant, and only the
    base rules and that constant decide.
    """
    trees = spark.sparkContext.broadcast(fit(docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")), labels, bound=bound))
    own = docs.select(samples.long_id(docs, ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kinds = "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, kept boolean, score double"
    return own.mapInArrow(partial(_score, shared=trees, least=least), kinds)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark, runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "labels"))


QUERIES = {"op7_quality_rules": op7_quality_rules}
SQL: dict[str, str] = {}
