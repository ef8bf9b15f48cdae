"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded from learned
embeddings of hashed word features; gated attention, learned from document labels alone, weighs
the passages, and the weighted passage representation is scored. Training runs on a bounded
labelled sample on the driver; scoring is one pass over whole texts, with word vectors kept per
worker so that a word's features are hashed once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import samples
from granary.llm import words as W

PASSAGE, BUCKETS, WIDTH, HIDDEN, EXTRA = 64, 1 << 14, 12, 16, 5
_UPPER, _LOWER, _DIGIT = re.compile(rb"[A-Z]+"), re.compile(rb"[a-z]+"), re.compile(rb"[0-9]+")


def _features(word: bytes) -> tuple[int, int, int, int]:
    shape = _DIGIT.sub(b"0", _LOWER.sub(b"a", _UPPER.sub(b"A", word)))
    h = xxhash.xxh3_64_intdigest
    m = BUCKETS - 1
    return h(word.lower()) & m, h(shape, 1) & m, h(word[-3:], 2) & m, h(word[-1:], 3) & m


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.array([_features(w) for w in words], dtype=np.int32).reshape(-1, 4)


def passages(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of passages among the words (p + 1) and of documents among the passages (n + 1)."""
    count = -(-np.diff(starts) // PASSAGE)
    of = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(count)), count)
    begin = starts[doc] + (np.arange(of[-1]) - of[doc]) * PASSAGE
    return np.concatenate([begin, [starts[-1]]]).astype(np.int64), of


def extras(words: list[bytes], ids: np.ndarray, starts: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Per passage: share of words that begin a pair met before in the document, that were met before in the passage, that equal the word before; mean length, fill."""
    n = np.maximum(np.diff(begin), 1)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts)).astype(np.uint64)
    again, echo = np.zeros(len(ids)), np.zeros(len(ids))
    inside = np.flatnonzero(doc[1:] == doc[:-1])  # places whose next word is of the same text
    if len(inside):
        echo[inside + 1] = ids[inside + 1] == ids[inside]
        pair = W.mix(ids[inside] * W._MULT[1] + ids[inside + 1] * W._MULT[2] + doc[inside] * W._MULT[4])
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        again[inside[order[1:][same]]] = 1.0
    place = np.repeat(np.arange(len(n)), np.diff(begin)).astype(np.uint64)
    own = W.mix(ids + place * W._MULT[3])
    order = np.argsort(own, kind="stable")
    near = np.zeros(len(ids))
    near[order[1:][own[order][1:] == own[order][:-1]]] = 1.0
    length = np.fromiter(map(len, words), np.float64, len(words))
    return np.stack([samples.sums(again, begin) / n, samples.sums(near, begin) / n, samples.sums(echo, begin) / n, samples.sums(length, begin) / n / 10, n / PASSAGE], axis=1)


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x WIDTH
    w1: np.ndarray  # (WIDTH + EXTRA) x HIDDEN
    b1: np.ndarray
    v: np.ndarray  # HIDDEN x HIDDEN, tanh half of the gate
    u: np.ndarray  # HIDDEN x HIDDEN, sigmoid half
    a: np.ndarray  # HIDDEN
    c: np.ndarray  # HIDDEN
    b: np.ndarray  # 1

    def double(self) -> Model:
        """The same weights in double precision but for the table, which is only summed."""
        return Model(self.table, *(getattr(self, k).astype(np.float64) for k in ("w1", "b1", "v", "u", "a", "c", "b")))

    def forward(self, x: np.ndarray, of: np.ndarray) -> dict:
        """Scores from passage encodings; a document without passages gets the bias alone."""
        n = np.diff(of)
        h = np.tanh(x @ self.w1 + self.b1)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * g) @ self.a
        top = np.zeros(len(n), e.dtype)
        full = np.flatnonzero(n)
        if len(full):
            top[full] = np.maximum.reduceat(e, of[:-1][full])
        doc = np.repeat(np.arange(len(n)), n)
        w = np.exp(e - top[doc])
        w /= np.maximum(samples.sums(w, of), 1e-30)[doc]
        z = samples.sums(h * w[:, None], of)
        return {"h": h, "t": t, "g": g, "w": w, "z": z, "doc": doc, "p": 1 / (1 + np.exp(-np.clip(z @ self.c + self.b, -30, 30)))}


def gradient(m: Model, r: dict, x: np.ndarray, of: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of the mean log loss with regard to the weights, and to the passage encodings ``x``."""
    d = ((r["p"] - y) / len(y)).astype(x.dtype)
    grad = {"b": d.sum(keepdims=True), "c": r["z"].T @ d}
    dz = d[:, None] * m.c
    dw = (r["h"] * dz[r["doc"]]).sum(axis=1)
    de = r["w"] * (dw - samples.sums(r["w"] * dw, of)[r["doc"]])
    tg = r["t"] * r["g"]
    grad["a"] = tg.T @ de
    dtg = de[:, None] * m.a
    dt, du = dtg * r["g"] * (1 - r["t"] ** 2), dtg * r["t"] * r["g"] * (1 - r["g"])
    grad["v"], grad["u"] = r["h"].T @ dt, r["h"].T @ du
    dh = (dz[r["doc"]] * r["w"][:, None] + dt @ m.v.T + du @ m.u.T) * (1 - r["h"] ** 2)
    grad["w1"], grad["b1"] = x.T @ dh, dh.sum(axis=0)
    return grad, dh @ m.w1.T


def train(texts: list[bytes], y: np.ndarray, epochs: int = 8, size: int = 32, rate: float = 0.01, l2: float = 1e-5, seed: int = 3) -> Model:
    """Adam on the log loss; a sample without both classes leaves the smoothed prior as the score."""
    rng = np.random.default_rng(seed)
    init = lambda *s: (rng.standard_normal(s) * s[0] ** -0.5).astype(np.float32)
    m = Model((rng.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32), init(WIDTH + EXTRA, HIDDEN), np.zeros(HIDDEN, np.float32), init(HIDDEN, HIDDEN), init(HIDDEN, HIDDEN), init(HIDDEN), np.zeros(HIDDEN, np.float32), np.zeros(1, np.float32))
    p = (y.sum() + 1) / (len(y) + 2)
    m.b[:] = np.log(p / (1 - p))
    if len(np.unique(y)) < 2:
        return m
    cache = W.WordIds()
    index: dict[bytes, int] = {}
    feats: list[tuple[int, int, int, int]] = []
    docs = []
    for t in texts:
        words, starts = W.split_all([t])
        begin, of = passages(starts)
        rows = []
        for w in words:
            if w not in index:
                index[w] = len(feats)
                feats.append(_features(w))
            rows.append(index[w])
        docs.append((np.array(rows, np.int64), np.diff(begin), extras(words, cache.array(words), starts, begin).astype(np.float32)))
    hashed = np.array(feats, dtype=np.int64).reshape(-1, 4)
    names = ("table", "w1", "b1", "v", "u", "a", "c", "b")
    mean, square = ({k: np.zeros_like(getattr(m, k)) for k in names} for _ in range(2))
    step = 0
    usable = np.array([i for i, d in enumerate(docs) if len(d[0])], dtype=np.int64)
    for epoch in range(epochs):
        for lo in range(0, len(usable), size) if len(usable) else ():
            if lo == 0:
                rng.shuffle(usable)
            own = usable[lo : lo + size]
            words = np.concatenate([docs[i][0] for i in own])
            n = np.concatenate([docs[i][1] for i in own])
            begin, of = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum([len(docs[i][1]) for i in own])])
            uniq, back = np.unique(words, return_inverse=True)
            vectors = m.table[hashed[uniq]].sum(axis=1)
            x = np.concatenate([samples.sums(vectors[back], begin) / n[:, None], np.concatenate([docs[i][2] for i in own])], axis=1)
            r = m.forward(x, of)
            grad, dv = gradient(m, r, x, of, y[own])
            dx = dv[:, :WIDTH] / n[:, None]
            share = np.repeat(np.arange(len(n)), n)
            dv = np.zeros((len(uniq), WIDTH), np.float32)
            order = np.argsort(back, kind="stable")
            dv[:] = np.add.reduceat(dx[share[order]], np.concatenate([[0], np.flatnonzero(np.diff(back[order])) + 1]), axis=0)
            flat = hashed[uniq].ravel()
            rows, inverse = np.unique(flat, return_inverse=True)
            gt = np.zeros((len(rows), WIDTH), np.float32)
            np.add.at(gt, inverse, np.repeat(dv, 4, axis=0))
            step += 1
            lr = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * (0.5 ** (epoch / 3))
            for k in names:
                at = rows if k == "table" else slice(None)
                g = (gt if k == "table" else grad[k]) + l2 * getattr(m, k)[at]
                mean[k][at] = 0.9 * mean[k][at] + 0.1 * g
                square[k][at] = 0.999 * square[k][at] + 0.001 * g * g
                getattr(m, k)[at] -= (lr * mean[k][at] / (np.sqrt(square[k][at]) + 1e-8)).astype(np.float32)
    return m


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 3_000, mod: int = 5, rest: int = 0) -> Model:
    """A model from at most ``bound`` labelled documents outside the held-out fold."""
    rows = samples.labelled(docs, labels, label, bound, mod, rest)
    return train([t.encode() for _, t, _ in rows], np.array([float(r[2]) for r in rows]))


def score_texts(model: Model, key: int, texts: list[bytes]) -> np.ndarray:
    """A score is a function of the text alone: in double precision and rounded, what shares its batch doesn't show."""
    table, wide = W.worker_cache(("quality", key), lambda: (samples.WordTable(lambda ws: model.table[_hashed(ws)].sum(axis=1), WIDTH, 200_000), model.double()))
    words, starts = W.split_all(texts)
    ids, _ = W.hash_words(pa.array(texts, pa.binary()))
    begin, of = passages(starts)
    rows = table.rows(words)
    n = np.maximum(np.diff(begin), 1)
    x = np.concatenate([samples.sums(table.matrix[rows], begin) / n[:, None], extras(words, ids, starts, begin)], axis=1)
    return np.round(wide.forward(x.astype(np.float64), of)["p"], 10)


def _score(batches, shared, key: int, mod: int, rest: int):
    import zlib

    for b in W.slices(batches, max_bytes=1_000_000):
        ids = b.column(0).to_pylist()
        s = score_texts(shared.value, key, W.raw(b.column(1)))
        held = [i is not None and zlib.crc32(str(i).encode()) % mod == rest for i in ids]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held), pa.array(s)], names=["doc_id", "held_out", "score"])


def _keep(batches, shared, key: int, least: float, text: str):
    for b in W.slices(batches, text, max_bytes=1_000_000):
        s = score_texts(shared.value, key, W.raw(b.column(b.schema.get_field_index(text)).cast(pa.string())))
        yield b.filter(pa.array(s >= least))


def _model(spark: SparkSession, docs: DataFrame, labels: DataFrame, bound: int, text: str, ident: str):
    model = fit(docs.select(samples.long_id(docs, ident).alias("doc_id"), F.col(text).alias("text")), labels, bound=bound)
    return spark.sparkContext.broadcast(model), xxhash.xxh3_64_intdigest(model.table.tobytes() + model.c.tobytes())


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.3, bound: int = 3_000, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score (likelihood of label 1) and predicted (score >= ``least``), for every row.

    Null or empty text has no passages and gets the model's bias as its score. A text of any length
    is scored whole, from all its passages; only a single text's words are held at once. Equal texts
    have equal scores, whatever they are scored with. Null ids stay null and are never held out;
    repeated rows are scored each; only the two named columns are read, so others can't clash. An
    empty table gives an empty table. Labels of one class, or none, make every score the smoothed
    prior. ``bound`` labelled documents, of 40 million characters at most, train.
    """
    shared, key = _model(spark, docs, labels, bound, text, ident)
    own = docs.select(samples.long_id(docs, ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = own.mapInArrow(partial(_score, shared=shared, key=key, mod=5, rest=0), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.3, bound: int = 3_000, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, all columns as they were.

    Nulls, empty and long texts, ties and repeated rows are scored as ``quality_scores`` says: equal
    texts stay or go together, and rows without words stay if the bias alone reaches ``least``. No
    column is added, so none can clash. An empty table gives an empty table.
    """
    shared, key = _model(spark, docs, labels, bound, text, ident)
    return samples.arrow_rows(docs, partial(_keep, shared=shared, key=key, least=least, text=text), docs.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "labels"))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
SQL: dict[str, str] = {}
