"""Language identification: a linear-chain conditional random field over words.

Emissions come from hashed affixes, character n-grams and the word itself (the lexicon);
transitions are learned. Training sequences are spliced from pieces of labelled documents of
different languages, so that the transitions see code switching, and forward-backward gives the
gradient. Scoring labels every word of whole texts: word emissions are kept per worker, and
forward-backward runs over all texts of a batch at once, longest first, so a step touches only
the texts that reach it.
"""

from __future__ import annotations

import zlib
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

BUCKETS = 1 << 16
_EDGES = "0123456789.,;:!?()[]{}\"'#$%&*|<>-_/\\+=@~^`…«»“”„’‘¿¡"


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' features, and where each word's begin (n + 1 numbers).

    Features: character trigrams of the word between marks (the outer ones are affixes of two
    letters), affixes of three letters, letters beyond ASCII, and the word itself (the lexicon).
    A word without a letter has none. All hashes are computed on code points at once.
    """
    cores = [w.decode().lower().strip(_EDGES) for w in words]
    cores = [c if c.isalpha() or any(map(str.isalpha, c)) else "" for c in cores]
    own = [i for i, c in enumerate(cores) if c]
    starts = np.zeros(len(words) + 1, np.int64)
    if not own:
        return np.zeros(0, np.int64), starts
    cp = np.frombuffer("".join([f"^{cores[i]}$" for i in own]).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.array([len(cores[i]) + 2 for i in own])
    end = np.cumsum(size)
    begin = end - size
    word = np.repeat(np.arange(len(own)), size)
    m = W._MULT
    tri = W.mix(cp[:-2] * m[0] + cp[1:-1] * m[1] + cp[2:] * m[2])
    inside = np.flatnonzero(word[:-2] == word[2:])
    wide = np.flatnonzero(cp > 127)
    whole = W.mix(np.add.reduceat(W.mix(cp * m[3] + (np.arange(len(cp)) - begin[word]).astype(np.uint64) * m[4]), begin))
    long = np.flatnonzero(size >= 5)
    four = [W.mix(sum((cp[at[long] + k] * m[5 + k + 4 * side] for k in range(4)), np.uint64(side))) for side, at in enumerate((begin, end - 4))]
    owner = np.concatenate([word[inside], word[wide], np.arange(len(own)), long, long])
    bucket = np.concatenate([tri[inside], W.mix(cp[wide] * m[20]), whole, *four]) & np.uint64(BUCKETS - 1)
    order = np.argsort(owner, kind="stable")
    starts[np.array(own) + 1] = np.bincount(owner, minlength=len(own))
    return bucket[order].astype(np.int64), np.cumsum(starts)


def emissions(weights: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Emission scores, and in the last column whether the word has a letter."""
    flat, starts = features(words)
    out = np.zeros((len(words), weights.shape[1] + 1), np.float32)
    out[:, :-1] = samples.sums(weights[flat], starts)
    out[:, -1] = np.diff(starts) > 0
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def forward_backward(e: np.ndarray, starts: np.ndarray, trans: np.ndarray, pairs: bool = False, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each place (emission scores ``e``, sequences between ``starts``), and with ``pairs`` the expected transitions.

    A sequence is cut into blocks of ``block`` places. A block's effect on any message is a matrix
    over the labels, and all blocks' matrices are made at once; messages then go from block to block
    through them, and all blocks are filled in at once. So a text of a million words takes some
    thousand steps, not a million each way.
    """
    x = np.exp(e - e.max(axis=1, keepdims=True)) if len(e) else e
    a = np.exp(trans - trans.max())
    k = len(a)
    count = -(-np.diff(starts) // block)
    of = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)  # a block's number in its sequence
    begin = starts[:-1][of] + nth * block
    n = np.minimum(begin + block, starts[1:][of]) - begin
    order = np.argsort(-n, kind="stable")
    first, n, nth_, own = begin[order], n[order], nth[order], np.empty(len(order), np.int64)
    own[order] = np.arange(len(order))  # a block's place in the order by length
    active = len(n) - np.searchsorted(n[::-1], np.arange(n[0] if len(n) else 0), side="right")
    head, tail = np.full((len(n), k), 1.0 / k), np.ones((len(n), k))  # messages into a block from both sides
    if len(count) and count.max() > 1:
        effect = np.tile(np.eye(k), (len(n), 1, 1))
        for t, m in enumerate(active):
            step = (effect[:m] @ a) * x[first[:m] + t][:, None, :]
            effect[:m] = step / step.sum(axis=(1, 2), keepdims=True)
        at = np.flatnonzero(count > 1)
        base = (np.cumsum(count) - count)[at]
        firsts = own[base]
        # The first block has no transition into it: its message is what its places say from a flat start.
        now = np.ones((len(at), k))
        for t in range(block):
            now = _unit((now if t == 0 else now @ a) * x[first[firsts] + t])
        last = np.ones((len(at), k))
        for j in range(1, int(count.max())):
            go = count[at] > j
            i = own[base[go] + j]
            head[i] = now[go]
            now[go] = _unit(np.einsum("nk,nkl->nl", now[go], effect[i]))
        for j in range(int(count.max()) - 1, 0, -1):
            go = count[at] > j
            i = own[base[go] + j]
            last[go] = _unit(np.einsum("nkl,nl->nk", effect[i], last[go]))
            tail[own[base[go] + j - 1]] = last[go]
    alpha, beta = np.zeros_like(x), np.ones_like(x)
    for t, m in enumerate(active):
        at = first[:m] + t
        if t == 0:
            into = np.where((nth_ > 0)[:, None], head @ a, 1.0)
            alpha[at] = _unit(into[:m] * x[at])
        else:
            alpha[at] = _unit((alpha[at - 1] @ a) * x[at])
    if len(n):
        beta[first + n - 1] = tail
    expected = np.zeros_like(a)
    for t in range(len(active) - 1, -1, -1):
        inner = np.arange(active[t]) if t else np.flatnonzero(nth_ > 0)
        at = first[inner] + t
        msg = x[at] * beta[at]
        if t:
            beta[at - 1] = _unit(msg @ a.T)
        if pairs:
            joint = alpha[at - 1][:, :, None] * a * msg[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    gamma = alpha * beta
    return gamma / np.maximum(gamma.sum(axis=1, keepdims=True), 1e-30), expected


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    trans: np.ndarray  # labels x labels


def train(texts: list[bytes], langs: list[str], steps: int = 400, size: int = 48, length: int = 24, rate: float = 0.3, l2: float = 1e-4, seed: int = 5) -> Model:
    """Adagrad on spliced sequences: runs of about ``length / 2`` words, each from a document of a drawn language."""
    labels = sorted(set(langs))
    m = Model(labels, np.zeros((BUCKETS, len(labels)), np.float32), np.zeros((len(labels), len(labels))))
    by = [[w for t, g in zip(texts, langs) if g == lang for w in [t.split()] if w] for lang in labels]
    if sum(map(bool, by)) < 2:
        return m
    rng = np.random.default_rng(seed)
    sq_w, sq_t = np.full(BUCKETS * len(labels), 1e-2).reshape(m.weights.shape), np.full(m.trans.shape, 1e-1)
    usable = [i for i, d in enumerate(by) if d]
    for _ in range(steps):
        words, truth, starts = [], [], [0]
        for _ in range(size):
            left = length
            while left > 0:
                lang = usable[rng.integers(len(usable))]
                doc = by[lang][rng.integers(len(by[lang]))]
                k = min(left, 1 + int(rng.geometric(2 / length)), len(doc))
                at = int(rng.integers(len(doc) - k + 1))
                words += doc[at : at + k]
                truth += [lang] * k
                left -= k
            starts.append(len(words))
        flat, spans = features(words)
        y, starts_ = np.array(truth), np.array(starts)
        gamma, expected = forward_backward(samples.sums(m.weights[flat], spans), starts_, m.trans, pairs=True)
        gamma[np.arange(len(y)), y] -= 1
        inner = np.ones(len(y), bool)
        inner[starts_[:-1]] = False
        at = np.flatnonzero(inner)
        seen = np.zeros_like(m.trans)
        np.add.at(seen, (y[at - 1], y[at]), 1)
        rows, back = np.unique(flat, return_inverse=True)
        g = np.zeros((len(rows), len(labels)))
        np.add.at(g, back, np.repeat(gamma, np.diff(spans), axis=0))
        g = g / size + l2 * m.weights[rows]
        sq_w[rows] += g * g
        m.weights[rows] -= (rate * g / np.sqrt(sq_w[rows])).astype(np.float32)
        g = (expected - seen) / size
        sq_t += g * g
        m.trans -= rate * g / np.sqrt(sq_t)
    return m


def fit(docs: DataFrame, label: str = "lang", bound: int = 1_500, mod: int = 4, rest: int = 2, text: str = "text", ident: str = "doc_id") -> Model:
    """A model from at most ``bound`` documents with a language, outside the held-out fold."""
    rows = samples.labelled(docs, docs, label, bound, mod, rest, text=text, ident=ident)
    rows = [r for r in rows if r[1]]
    return train([t.encode() for _, t, _ in rows], [r[2] for r in rows])


def label_texts(model: Model, key: int, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Per text: language, its share of the words with a letter, and all shares."""
    table = W.worker_cache(("language", key), lambda: samples.WordTable(partial(emissions, model.weights), len(model.labels) + 1))
    words, starts = W.split_all(texts)
    e = table.matrix[r] if len(r := table.rows(words)) else np.zeros((0, len(model.labels) + 1), np.float32)
    shares = np.zeros((len(texts), max(1, len(model.labels))))
    if len(model.labels) and len(words):
        gamma, _ = forward_backward(e[:, :-1].astype(np.float64), starts, model.trans)
        shares = samples.sums(gamma * e[:, -1:], starts)
    n = samples.sums(e[:, -1].astype(np.int64), starts)
    shares = shares / np.maximum(n, 1)[:, None]
    best = shares.argmax(axis=1)
    known = (n > 0) & bool(model.labels)
    return [model.labels[b] if k else "und" for b, k in zip(best, known)], np.where(known, np.round(np.clip(shares.max(axis=1), 0, 1), 10), 0.0), shares


def _score(batches, shared, key: int, mod: int, rest: int):
    for b in W.slices(batches):
        ids = b.column(0).to_pylist()
        lang, score, _ = label_texts(shared.value, key, W.raw(b.column(1)))
        held = [i is not None and zlib.crc32(str(i).encode()) % mod == rest for i in ids]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])


def _spans(batches, shared, key: int):
    model = shared.value
    for b in W.slices(batches):
        out = []
        for i, t in zip(b.column(0).to_pylist(), W.raw(b.column(1))):
            words = t.split()
            if not words or not model.labels:
                continue
            e = emissions(model.weights, words)
            gamma, _ = forward_backward(e[:, :-1].astype(np.float64), np.array([0, len(words)]), model.trans)
            best = gamma.argmax(axis=1)
            cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(words)]
            out += [(i, lo, hi - lo, model.labels[best[lo]], float(gamma[lo:hi, best[lo]].mean())) for lo, hi in zip(cuts, cuts[1:])]
        c = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()))], names=["doc_id", "word", "words", "lang", "score"])


def _shared(spark: SparkSession, docs: DataFrame, bound: int, text: str, ident: str, label: str):
    model = fit(docs, label, bound, text=text, ident=ident)
    return spark.sparkContext.broadcast(model), xxhash.xxh3_64_intdigest(model.weights.tobytes())


def identify(spark: SparkSession, docs: DataFrame, bound: int = 1_500, text: str = "text", ident: str = "doc_id", label: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score (its mean share of the words with a letter), for every row.

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be
    learned. Texts of any length are labelled whole, in blocks. Equal texts get equal rows. Ties go to the language that sorts first. Null ids stay null and are never held out;
    repeated rows are scored each; only the named columns are read, so others can't clash. An empty
    table gives an empty table. One known language is then the only answer.
    """
    shared, key = _shared(spark, docs, bound, text, ident, label)
    own = docs.select(samples.long_id(docs, ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(partial(_score, shared=shared, key=key, mod=4, rest=2), "doc_id long, held_out boolean, lang_pred string, score double")


def spans(spark: SparkSession, docs: DataFrame, bound: int = 1_500, text: str = "text", ident: str = "doc_id", label: str = "lang") -> DataFrame:
    """Runs of words of one language in code-switched texts: doc_id, word (from 0), words, lang, score.

    Texts without words, null ones and those of an empty table have no runs, nor has any text where
    nothing could be learned. Long texts are labelled whole; ties go to the language that sorts
    first; null ids stay null, repeated rows have their runs each, other columns aren't read.
    """
    shared, key = _shared(spark, docs, bound, text, ident, label)
    own = docs.select(samples.long_id(docs, ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(partial(_spans, shared=shared, key=key), "doc_id long, word long, words long, lang string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, runtime.table(spark, sf_dir, "documents"))


QUERIES = {"op5_language_id": op5_language_id}
SQL: dict[str, str] = {}
