import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import language as G
from granary.llm import quality_classifier as C
from granary.llm import quality_rules as R
from granary.llm import samples as S
from granary.llm import words as W


@pytest.fixture(scope="module")
def sf(request):
    return "/root/testdata/sf0.01"


def test_quality_held_out(spark, sf):
    rows = {r["doc_id"]: r for r in C.op3_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(rows[x["doc_id"]], x["quality"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.93


def test_quality_odd(spark, odd, labels, nothing, no_labels):
    out = C.quality_scores(spark, odd, labels)
    assert out.count() == odd.count() and out.filter("score IS NULL").count() == 0
    assert C.quality_scores(spark, nothing, labels).collect() == []
    assert {r["score"] for r in C.quality_scores(spark, odd, no_labels).collect()} == {0.5}
    kept = C.keep_good(spark, odd, labels)
    assert kept.schema == odd.schema
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(r["doc_id"]) for r in out.filter("predicted = 1").collect())
    assert C.keep_good(spark, nothing, no_labels).collect() == []


def test_keep_good_with_awkward_columns(spark, awkward, labels):
    assert C.keep_good(spark, awkward, labels, least=0.0).exceptAll(awkward).count() == 0
    assert C.keep_good(spark, awkward, labels, least=1.1).collect() == []


def test_attention_learns():
    """Training separates texts that a mark tells apart."""
    texts = [b"good words here and there " * 30, b"bad### bad### stuff" * 20, b"fine text again " * 50, b"x### y### z###"]
    y = np.array([1.0, 0.0, 1.0, 0.0])
    m = C.train(texts, y, epochs=30)
    assert ((C.score_texts(m, 1, texts) > 0.5) == (y > 0.5)).all()


def test_attention_sums_to_one():
    m = C.train([b"a b", b"c d"], np.array([0.0, 1.0]), epochs=1)
    x = np.random.default_rng(0).standard_normal((7, C.WIDTH + C.EXTRA)).astype(np.float32)
    r = m.forward(x, np.array([0, 3, 3, 7]))
    assert r["w"][:3].sum() == pytest.approx(1, abs=1e-5) and r["w"][3:].sum() == pytest.approx(1, abs=1e-5)
    assert r["p"][1] == pytest.approx(1 / (1 + np.exp(-m.b[0])), abs=1e-5)


def test_scores_are_functions_of_the_text(spark, sf):
    texts = [r["text"].encode() for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(150).collect()] + [b"one two", b"two three", b"three one"]
    rng = np.random.default_rng(1)
    m = C.train(texts[:80], np.arange(80) % 2.0, epochs=2)
    alone = np.concatenate([C.score_texts(m, 7, [t]) for t in texts])
    for _ in range(3):
        order = rng.permutation(len(texts))
        assert (C.score_texts(m, 7, [texts[i] for i in order]) == alone[order]).all()


def test_pairs_end_with_their_text():
    words, starts = W.split_all([b"a b a", b"b a b"])
    ids, _ = W.hash_words(pa.array([b"a b a", b"b a b"]))
    begin, _ = C.passages(starts)
    got = C.extras(words, ids, starts, begin)
    for i, t in enumerate((b"a b a", b"b a b")):
        w, s = W.split_all([t])
        assert (got[i] == C.extras(w, W.hash_words(pa.array([t]))[0], s, C.passages(s)[0])[0]).all()


def test_attention_gradient_against_differences():
    rng = np.random.default_rng(2)
    shape = {"w1": (C.WIDTH + C.EXTRA, C.HIDDEN), "b1": (C.HIDDEN,), "v": (C.HIDDEN,) * 2, "u": (C.HIDDEN,) * 2, "a": (C.HIDDEN,), "c": (C.HIDDEN,), "b": (1,)}
    m = C.Model(np.zeros((1, C.WIDTH)), **{k: rng.standard_normal(s) * 0.4 for k, s in shape.items()})
    x, of, y = rng.standard_normal((9, C.WIDTH + C.EXTRA)), np.array([0, 4, 5, 9]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = m.forward(x, of)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    def slope(v, i):
        old, h = v[i], 1e-6
        v[i] = old + h
        up = loss()
        v[i] = old - h
        down = loss()
        v[i] = old
        return (up - down) / (2 * h)

    grad, dx = C.gradient(m, m.forward(x, of), x, of, y)
    for name, g in [*grad.items(), ("x", dx)]:
        v = x if name == "x" else getattr(m, name)
        for i in [tuple(rng.integers(0, d) for d in v.shape) for _ in range(12)]:
            assert g[i] == pytest.approx(slope(v, i), abs=1e-7), (name, i)
    # The forward pass, document by document.
    r = m.forward(x, of)
    for d in range(3):
        h = np.tanh(x[of[d] : of[d + 1]] @ m.w1 + m.b1)
        e = (np.tanh(h @ m.v) / (1 + np.exp(-(h @ m.u)))) @ m.a
        w = np.exp(e) / np.exp(e).sum()
        assert r["p"][d] == pytest.approx(1 / (1 + np.exp(-((w @ h) @ m.c + m.b[0]))))


def test_blocks_of_long_sequences_change_nothing():
    rng = np.random.default_rng(4)
    lengths = [0, 1, 7, 8, 9, 40, 3, 0, 65, 16]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    e, trans = rng.standard_normal((starts[-1], 4)) * 3, rng.standard_normal((4, 4))
    want, pairs = G.forward_backward(e, starts, trans, pairs=True)
    for block in (1, 2, 8, 64):
        got, expected = G.forward_backward(e, starts, trans, pairs=True, block=block)
        assert np.allclose(got, want) and np.allclose(expected, pairs)


def test_language_of_a_text_of_two_million_words():
    m = G.train([b"der die das und nicht " * 20, b"the of and to not " * 20], ["de", "en"], steps=40)
    text = b"the of and " * 500_000 + b"der die das und nicht " * 100_000
    began = time.monotonic()
    lang, score, shares = G.label_texts(m, 1, [text, b"und das", b""])
    assert lang == ["en", "de", "und"] and shares[0].tolist() == pytest.approx([0.25, 0.75], abs=0.01)
    assert time.monotonic() - began < 60


def test_a_word_hash_does_not_depend_on_its_place():
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcXYZ é\n\t"), rng.integers(0, 60))) for _ in range(300)] + ["x" * 5000, "", " "]
    old, want = W.CHUNK, {}
    for chunk in (old, 64, 1000):
        W.CHUNK = chunk
        W._power_tables.cache_clear()
        try:
            for low in (False, True):
                h, starts = W.hash_words(pa.array(texts), lower=low)
                assert np.diff(starts).tolist() == [len(t.encode().split()) for t in texts]
                assert (h == want.setdefault(low, h)).all()
        finally:
            W.CHUNK = old
            W._power_tables.cache_clear()
    h, _ = W.hash_words(pa.array(texts))
    by = {}
    for w, x in zip([w for t in texts for w in t.encode().split()], h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_samples_are_bounded_by_size_and_number(spark):
    long = "word " * 400
    docs = spark.createDataFrame([(i, long if i % 3 else "short text") for i in range(60)] + [(None, "x"), (60, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(70)] + [(3, 1), (None, 1)], "doc_id long, quality int")
    every = S.labelled(docs, labels, "quality", 1000, 5, 0)
    assert {r[0] for r in every} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 5} and dict((r[0], r[2]) for r in every)[3] == 1
    assert len(S.labelled(docs, labels, "quality", 7, 5, 0)) <= 7
    few = S.labelled(docs, labels, "quality", 1000, 5, 0, total=6_500)
    assert set(few) <= set(every) and sum(len(r[1]) for r in few) <= 6_500 and any(len(r[1]) == 2000 for r in few)
    assert {r[0] for r in every if len(r[1]) < 20} <= {r[0] for r in few}


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_rules_base_counts(spark, odd, labels):
    docs = [(r["doc_id"], *counts(r["text"])) for r in odd.collect()]
    got = [tuple(r[k] for k in ("doc_id", *R.BASE)) for r in R.quality_rules(spark, odd, labels).collect()]
    assert sorted(got, key=str) == sorted(docs, key=str)


def test_rules_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = R.op7_quality_rules(spark, sf).collect()
    for r in rows:
        base = counts(texts[r["doc_id"]])
        assert tuple(r[k] for k in R.BASE) == base
        assert r["base_failed"] == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"]: r["kept"] for r in rows}
    held = [(kept[x["doc_id"]], x["quality"]) for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    assert np.mean([k == bool(q) for k, q in held]) > 0.93


def test_rules_empty(spark, nothing, no_labels, odd):
    assert R.quality_rules(spark, nothing, no_labels).collect() == []
    assert {r["score"] for r in R.quality_rules(spark, odd, no_labels).collect()} == {0.5}


def test_trees_are_monotone_and_flat():
    rng = np.random.default_rng(3)
    x = rng.random((600, len(R.FEATURES)))
    y = (x[:, 2] + 0.3 * rng.standard_normal(600) < 0.5).astype(float)
    t = R.grow(x, y, trees=30)

    def walk(row):
        s = t.prior
        for n in t.roots:
            while t.left[n] != n:
                n = t.left[n] if row[t.feature[n]] <= t.threshold[n] else t.right[n]
            s += t.value[n]
        return 1 / (1 + np.exp(-s))

    assert t.score(x[:50]) == pytest.approx([walk(r) for r in x[:50]])
    assert np.mean((t.score(x) > 0.5) == (y > 0.5)) > 0.8
    for f, sign in enumerate(R.MONOTONE):
        if sign:
            grid = np.repeat(x[:20], 30, axis=0)
            grid[:, f] = np.tile(np.linspace(0, 1, 30), 20)
            assert (sign * np.diff(t.score(grid).reshape(20, 30), axis=1) >= -1e-12).all()


def test_language_held_out(spark, sf):
    rows = G.op5_language_id(spark, sf).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd(spark, odd, nothing):
    rows = G.identify(spark, odd).collect()
    assert len(rows) == odd.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4)} == {"und"} and {r["lang_pred"] for r in rows if r["doc_id"] == 1} == {"en"}
    assert G.identify(spark, nothing).collect() == []


def brute_marginals(e, trans):
    n, k = e.shape
    import itertools

    p, z = np.zeros((n, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(sum(e[i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        z += w
        for i, s in enumerate(path):
            p[i, s] += w
    return p / z


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    sizes = [3, 1, 5, 0, 2]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    e, trans = rng.standard_normal((starts[-1], 3)), rng.standard_normal((3, 3))
    got, expected = G.forward_backward(e, starts, trans, pairs=True)
    for a, b in zip(starts[:-1], starts[1:]):
        if b > a:
            assert got[a:b] == pytest.approx(brute_marginals(e[a:b], trans))
    assert expected.sum() == pytest.approx(sum(max(0, n - 1) for n in sizes))


def test_code_switching(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    en, de = (next(r["text"] for r in docs if r["lang"] == g and len(r["text"]) > 600 and "###" not in r["text"] and "|" not in r["text"]) for g in ("en", "de"))
    a, b = " ".join(en.split()[:40]), " ".join(de.split()[:40])
    m = G.train([r["text"].encode() for r in docs], [r["lang"] for r in docs], steps=200)
    _, _, shares = G.label_texts(m, 5, [f"{a} {b}".encode()])
    own = dict(zip(m.labels, shares[0]))
    assert own["en"] > 0.35 and own["de"] > 0.35


def test_word_hashes_agree_with_words():
    import pyarrow as pa

    texts = ["a B c", None, "", " é ü\n", "b", "A b"]
    ids, starts = W.hash_words(pa.array(texts), lower=True)
    words, want = W.split_all([(t or "").encode().lower() for t in texts])
    assert starts.tolist() == want.tolist()
    for i in range(len(ids)):
        for j in range(len(ids)):
            assert (ids[i] == ids[j]) == (words[i] == words[j])
