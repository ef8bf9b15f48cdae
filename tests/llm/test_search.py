import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import ann as A
from granary.llm import licenses as L
from granary.llm import substring_dedup as S


def test_recall_and_scores(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = A.op10_nearest(spark, sf_dir).collect()
    want = {(q, i): s for q, _, i, s in A.exact(e, e.filter("vec_id % 20 = 0"))}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in rows}
    assert len(set(got) & set(want)) / len(want) >= 0.9
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in set(got) & set(want))
    by = defaultdict(list)
    for r in rows:
        by[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    for v in by.values():
        assert [x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) and sorted(v, key=lambda x: x[1:]) == sorted(v)


def test_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], "x") for i in range(300)]
    rows += [(i, rows[0][1], "copy") for i in range(300, 400)] + [(400, None, ""), (401, [0.0] * 8, ""), (402, [None] + [1.0] * 7, ""), (403, [float("nan")] + [1.0] * 7, ""), (404, [float("inf")] + [1.0] * 7, ""), (405, [1.0], ""), (None, rows[1][1], ""), (7, rows[7][1], "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string").repartition(3)
    out = A.nearest(spark, df, df.filter("vec_id % 20 = 0"), k=20, block=64, target=1.0).collect()
    good = df.dropDuplicates(["vec_id"]).filter("vec_id < 400")
    want = A.exact(good, good.filter("vec_id % 20 = 0"))
    by = {(q, r): i for q, r, i, _ in want}
    same = [by[(r["query_id"], r["rank"])] == r["vec_id"] for r in out]
    assert len(out) == len(want) and np.mean(same) > 0.9
    copies = [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 0 and r["vec_id"] >= 300]
    assert copies == list(range(300, 300 + len(copies)))


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = A.nearest(spark, df, df.filter("vec_id % 20 = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert A.nearest(spark, df.limit(0), df.limit(0)).collect() == []
    one = df.filter("vec_id = 0")
    assert A.nearest(spark, one, one).collect() == []


def test_larger_norms_first(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(6) * rng.uniform(0.1, 5)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in A.nearest(spark, df, df.filter("vec_id % 20 = 0"), k=10).collect()}
    want = {(q, i) for q, _, i, _ in A.exact(df, df.filter("vec_id % 20 = 0"), 10)}
    assert len(got & want) / len(want) >= 0.9


@pytest.mark.parametrize("n", [500, 2000])
def test_lists_are_pruned(n):
    """Several lists at every size, less than the whole scored, nine of ten neighbours in the lists opened."""
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 64))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    router = A.build(v, 1.0, n, 8.0, 0.2, 0.94, 20)
    assert len(router.centroids) >= 100
    row, lst = router.members(router.lift(v, False))
    assert np.unique(row).tolist() == list(range(n)) and len(row) < 1.3 * n
    asks = np.arange(0, n, 20)
    opened = router.within(router.lift(v[asks], True), router.open_ratio)
    scored = (opened * np.bincount(lst, minlength=opened.shape[1])).sum(axis=1).mean() / n
    dots = v[asks] @ v.T
    dots[np.arange(len(asks)), asks] = -np.inf
    met = [np.isin(np.argsort(-dots[i])[:20], row[opened[i][lst]]).mean() for i in range(len(asks))]
    assert np.mean(met) >= 0.9 and scored < {500: 0.7, 2000: 0.5}[n]


def test_graph_search_against_all_centroids():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((3000, 16))
    router = A.build(v, float(np.sqrt((v * v).sum(axis=1).max())), 3000, 8.0, 0.2, 0.94, 20)
    x = router.lift(v[:300], False)
    d = np.sqrt(((x[:, None, :] - router.centroids[None]) ** 2).sum(axis=2))
    at, far = router.nearest(x)
    assert np.mean(at[:, 0] == d.argmin(axis=1)) > 0.85 and np.allclose(np.take_along_axis(d, at, axis=1), far)
    want = d <= np.sort(d, axis=1)[:, A.ANCHOR - 1 : A.ANCHOR] * 1.1
    assert (router.within(x, 1.1) & ~want).sum() < 0.02 * want.sum() and (router.within(x, 1.1) & want).sum() > 0.95 * want.sum()


def test_groups_hold_bounded_lists():
    sizes = np.array([3, 5, 0, 9, 40, 2, 2, 11, 10])
    first, count = A.groups(sizes, 10)
    held = defaultdict(int)
    for n, f, c in zip(sizes.tolist(), first.tolist(), count.tolist()):
        assert c == max(1, -(-n // 10))
        for i in range(c):
            held[f + i] += n / c
    assert max(held.values()) <= 10 and first.tolist() == [0, 0, 0, 1, 2, 6, 6, 7, 9]


def test_repeated_ids_count_once(spark):
    """A hot id with many vectors and copies, a third of all vectors equal: the neighbours are distinct ids, as by brute force."""
    rng = np.random.default_rng(5)
    v = lambda: [float(x) for x in rng.standard_normal(8)]
    rows = [(i, v()) for i in range(200)] + [(7, [x * 1.5 for x in v()]) for _ in range(60)]
    rows += [(7, rows[7][1])] * 25 + [(1000 + i, rows[3][1]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asks = df.filter("vec_id % 20 = 0 OR vec_id = 7").dropDuplicates(["vec_id"])
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in A.nearest(spark, df, asks, block=32, target=1.0, asks=5).collect())
    want = sorted(x[:3] for x in A.exact(df, asks))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.mean([g == w for g, w in zip(got, want)]) > 0.95
    assert len({(q, i) for q, _, i in got}) == len(got)


def words(r, n):
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def planted(seed):
    """Texts with passages of 60 words, some with edits, in random places; and what was planted where."""
    r = random.Random(seed)
    passages = [words(r, 60) for _ in range(6)]
    rows, spots = [], defaultdict(list)
    for i in range(40):
        text = words(r, r.randrange(20, 200))
        if i % 2 == 0:
            k = r.randrange(len(passages))
            p = list(passages[k])
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                p[r.randrange(60)] = f"e{r.randrange(10**6)}"
            at = r.randrange(len(text) + 1)
            text[at:at] = p
            spots[k].append((i, at, at + 60))
        rows.append((i, " ".join(text)))
    return rows, spots


@pytest.mark.parametrize("seed,bound", [(1, 2_000_000), (2, 0), (3, 2_000_000)])
def test_passages_are_found(spark, seed, bound):
    rows, spots = planted(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = S.repeated_passages(spark, df, wanted_bound=bound).collect()
    spans, links = defaultdict(list), defaultdict(set)
    for x in out:
        spans[x["doc_id"]].append((x["first_word"], x["end_word"]))
        spans[x["other_id"]].append((x["other_first"], x["other_end"]))
        links[x["doc_id"]].add(x["other_id"])
        links[x["other_id"]].add(x["doc_id"])
        a, b = rows[x["doc_id"]][1].split(), rows[x["other_id"]][1].split()
        assert 0 <= x["first_word"] < x["end_word"] <= len(a) and 0 <= x["other_first"] < x["other_end"] <= len(b)
    clean = {i for i, _ in rows} - {s[0] for v in spots.values() if len(v) > 1 for s in v}
    assert not clean & set(spans)
    for v in spots.values():
        if len(v) > 1:
            for i, lo, hi in v:
                assert any(a <= lo + 6 and b >= hi - 6 for a, b in spans[i]), (i, lo, hi)
            seen, todo = {v[0][0]}, [v[0][0]]
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            assert {s[0] for s in v} <= seen


def test_passages_odd(spark, odd, nothing):
    out = S.repeated_passages(spark, odd).collect()
    pairs = {(min(r["doc_id"], r["other_id"]), max(r["doc_id"], r["other_id"])) for r in out}
    assert {(1, 5), (7, 8), (15, 16)} <= pairs and all(a in (1, 5, 6, 7, 15) for a, _ in pairs)
    assert next(r["matched"] for r in out if {r["doc_id"], r["other_id"]} == {7, 8}) == 12_000
    assert S.repeated_passages(spark, nothing).collect() == []


def brute_chain(pos, opos, k, gap, cost):
    best = [float(k)] * len(pos)
    for j in range(len(pos)):
        for i in range(j):
            if pos[i] < pos[j] and opos[i] < opos[j] and pos[j] - pos[i] <= gap and opos[j] - opos[i] <= gap:
                best[j] = max(best[j], k + best[i] - cost * (pos[j] - pos[i] + opos[j] - opos[i]))
    return max(best)


def test_fenwick_chain_against_all_predecessors():
    r = random.Random(4)
    for _ in range(200):
        n = r.randrange(1, 14)
        a = sorted({(r.randrange(30), r.randrange(30)) for _ in range(n)})
        pos, opos = np.array([x[0] for x in a]), np.array([x[1] for x in a])
        top = S.chain(pos, opos, gap=10**6)[0]
        p, o = pos[top], opos[top]
        assert (np.diff(p) > 0).all() and (np.diff(o) > 0).all()
        value = 5 * len(top) - S.COST * ((p[-1] - p[0]) + (o[-1] - o[0]))
        assert value == pytest.approx(brute_chain(pos, opos, 5, 10**6, S.COST)) or len(top) == len(pos)


def test_chain_within_the_gap_against_all_predecessors():
    r = random.Random(5)
    for case in range(300):
        a = set()
        for _ in range(r.randrange(1, 6)):  # passages far apart, on diagonals of their own
            p, o = r.randrange(400), r.randrange(400)
            a |= {(p + 5 * i + r.randrange(3), o + 5 * i + r.randrange(3)) for i in range(r.randrange(1, 12))}
        a = sorted(a)
        pos, opos = np.array([x[0] for x in a]), np.array([x[1] for x in a])
        gap = r.choice([7, 40, 41])
        top = S.chain(pos, opos, gap=gap)
        assert sorted(i for c in top for i in c.tolist()) == list(range(len(a)))
        for c in top:
            dp, do = np.diff(pos[c]), np.diff(opos[c])
            assert ((dp > 0) & (do > 0) & (dp <= gap) & (do <= gap)).all()
        value = max(5 * len(c) - S.COST * (pos[c[-1]] - pos[c[0]] + opos[c[-1]] - opos[c[0]]) for c in top)
        assert value == pytest.approx(brute_chain(pos, opos, 5, gap, S.COST)), case


def test_chain_after_a_long_one():
    one = np.arange(0, 300, 5)
    pos, opos = np.concatenate([[0], one, one[:12] + 900]), np.concatenate([[295], one, one[:12] + 1200])
    order = np.lexsort((opos, pos))
    assert sorted(len(c) for c in S.chain(pos[order], opos[order])) == [1, 12, 60]


def test_align_counts_words():
    a, b = np.arange(100, dtype=np.uint32), np.arange(100, dtype=np.uint32)
    b = np.delete(b, 40)
    b[70] = 999
    assert S.align(a, b, np.array([5, 30, 0, 50, 60, 1])) == (0, 97, 0, 96, 95)  # 32 words past the last anchor at most


@pytest.mark.parametrize("parts,want", [
    ([50, -30, 50], [(0, 50, 50), (80, 130, 50)]),  # 77 % in all
    ([51, -25, 5], [(0, 51, 51)]),
    ([60, -20, 60], [(0, 140, 120)]),
    ([30, -1, 30, -40, 47], [(0, 61, 60)]),
])
def test_passages_beside_other_words(spark, parts, want):
    r = random.Random(8)
    one, two = words(r, 20), words(r, 25)
    for i, n in enumerate(parts):
        shared = [f"s{i}x{j}" for j in range(abs(n))]
        one += shared if n > 0 else [f"a{w}" for w in shared]
        two += shared if n > 0 else [f"b{w}" for w in shared]
    df = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "doc_id long, text string")
    got = sorted((x["other_first"] - 20, x["other_end"] - 20, x["matched"], x["first_word"] - 25, x["end_word"] - 25) for x in S.repeated_passages(spark, df).collect())
    assert got == [(a, b, n, a, b) for a, b, n in want]


@pytest.mark.parametrize("part", [30, 26])
def test_passages_of_hot_parts(spark, part):
    """Texts 10 and 30 share two hot parts in a row; others hold one of the parts, before and between."""
    for seed in range(3):
        r = random.Random(seed)
        parts = [[f"p{i}x{j}" for j in range(part)] for i in range(2)]
        rows = []
        for i in range(40):
            own = parts[0] + parts[1] if i in (10, 30) else parts[r.randrange(2)] if i not in (0, 1) else parts[i]
            rows.append((i, " ".join(words(r, 40) + own + words(r, 40))))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {(x["doc_id"], x["other_id"]): (x["first_word"], x["end_word"], x["matched"]) for x in S.repeated_passages(spark, df).collect()}
        assert got == {(30, 10): (40, 40 + 2 * part, 2 * part)}


def by_seeds(rows):
    """Links of all pairs of rows with equal seeds, pair by pair."""
    out = set()
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[1] > y[1]:
                out.add((x[1], x[2], x[3], y[1], y[2], y[3]))
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_links_of_all_pairs(size):
    """Whatever the batches: all pairs of seeds of HOT rows, all others through one text."""
    r = random.Random(size)
    rows = []
    for seed, n in enumerate([1, 2, 3, 40, S.HOT, S.HOT + 1, 5, 200, 2, 64]):
        rows += [(seed, d, 0, r.randrange(100)) for d in sorted(r.sample(range(1000), n))]
    cols = ["seed", "doc_id", "sub", "pos", *(f"after{m}" for m in S.LONG)]

    def batches(rows):
        for i in range(0, len(rows), size):
            data = list(zip(*((*x, 0, 0) for x in rows[i : i + size])))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, kinds)], names=cols)

    every = by_seeds(rows)
    hot = {x for x in rows if x[0] in (5, 7)}
    got = set()
    for b in S._link(batches(rows), whole=True, rows=size):
        got |= {(x["doc"], x["sub"], x["pos"], x["odoc"], x["osub"], x["opos"]) for x in b.to_pylist() if x["kind"] == 0}
    cold = by_seeds([x for x in rows if x not in hot])
    assert cold <= got <= every
    for seed in (5, 7):
        first = next(x for x in rows if x[0] == seed)
        assert all((*x[1:], *first[1:]) in got for x in rows if x[0] == seed and x != first)


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_texts_that_repeat_a_seed(size):
    """Seeds of more than HOT rows in HOT texts or fewer: all texts are linked, whatever the batches; at the ends of a range each text has a row."""
    r = random.Random(size)
    rows, texts = [], {}
    for seed, (n, most) in enumerate([(40, 9), (1, 300), (30, 60), (3, 1), (S.HOT, 3), (S.HOT + 30, 4), (2, 200), (50, 5)]):
        texts[seed] = sorted(r.sample(range(1000), n))
        for d in texts[seed]:
            rows += [(seed, d, 0, p) for p in sorted(r.sample(range(5000), most))]
    kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4)

    def batches():
        for i in range(0, len(rows), size):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*((*x, 0, 0) for x in rows[i : i + size])), kinds)], names=list("abcdef"))

    every, first = by_seeds(rows), {}
    for x in rows:
        first.setdefault(x[:2], x)
    for whole in (True, False):
        got = [x for b in S._link(batches(), whole=whole, rows=size) for x in b.to_pylist()]
        links = {(x["doc"], x["sub"], x["pos"], x["odoc"], x["osub"], x["opos"]) for x in got if x["kind"] == 0 and x["doc"] != x["odoc"]}
        assert links <= every
        for seed, docs in texts.items():
            if len(docs) <= S.HOT:
                assert all((*first[seed, d][1:], *first[seed, o][1:]) in links for d in docs for o in docs if o < d), seed
        edges = sorted((x["seed"], x["doc"], x["pos"]) for x in got if x["kind"] == 1)
        assert edges == ([] if whole else sorted((s, d, first[s, d][3]) for s in (0, 7) for d in texts[s]))


@pytest.mark.parametrize("one_hash", [False, True])
@pytest.mark.parametrize("rows", [100, 250_000])
def test_packed_links(monkeypatch, rows, one_hash):
    """Packed links are those of ``_link``, in a value a bucket, and come back whole pairs at a time, also where pairs have one hash."""
    r = random.Random(rows)
    seeds = sorted((s, r.randrange(40) + (1 << 40), r.choice([0, -7]), r.randrange(900)) for s in range(300) for _ in range(r.choice([1, 2, 9, 30])))
    seeds += [(300, d, 0, d) for d in range(S.HOT + 9)]
    kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*((*x, 5, 6) for x in seeds[i : i + 500])), kinds)], names=list("abcdef")) for i in range(0, len(seeds), 500)]
    if one_hash:
        monkeypatch.setattr(S, "_pair_hash", lambda doc, *_: np.zeros(len(doc), np.uint64))
    plain = [x for b in S._link(iter(batches)) for x in b.to_pylist()]
    packed = [x for b in S._packed(iter(batches), 7, rows=rows) for x in b.to_pylist()]
    want = sorted(tuple(x[c] for c in S.LINK.names) for x in plain if x["kind"] == 0 and x["doc"] != x["odoc"])
    values = sorted((x["bucket"], x["links"]) for x in packed if x["kind"] == 0)
    assert len(want) > 10_000 and (rows == 100 or len(values) == len({b for b, _ in values}) <= 7)
    got = [x for b in S._by_pair([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*values)], names=["bucket", "links"])], rows=1_000) for x in b.to_pylist()]
    assert sorted(tuple(x.values()) for x in got) == want
    pairs = [tuple(x[c] for c in S.PAIR) for x in got]
    assert 1 + sum(a != b for a, b in zip(pairs, pairs[1:])) == len(set(pairs))
    assert all((a["pos"], a["opos"]) <= (b["pos"], b["opos"]) for a, b, p, q in zip(got, got[1:], pairs, pairs[1:]) if p == q)
    names = {"kind": "kind", "seed": "seed", "doc": "doc_id", "sub": "sub", "pos": "pos", "size": "size", "osub": "asks"}
    again = [tuple(x[c] for c in names) for x in plain if x["kind"]]
    assert sorted(again) == sorted(tuple(x[c] for c in names.values()) for x in packed if x["kind"]) and again


def test_links_reach_spark_packed(spark, monkeypatch):
    """Sixty differing copies of 200 words have tens of thousands of links; the table of links has some rows a task."""
    r = random.Random(12)
    text, counts, table = words(r, 200), {}, S.runtime.Scratch.table

    def counted(self, df, name="t", *args, **kwargs):
        out = table(self, df, name, *args, **kwargs)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(S.runtime.Scratch, "table", counted)
    rows = [(i, " ".join(text[:100] + [f"e{i}"] + text[100:])) for i in range(60)]
    got = {(x["doc_id"], x["other_id"]) for x in S.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i)}
    assert counts["links"] < counts["seeds"] and counts["chains"] >= len(got)


def test_gap_against_the_whole_table():
    """The longest common subsequence, as read off the whole table."""
    r = random.Random(13)
    for _ in range(500):
        v = r.choice([2, 5, 60])
        a, b = (np.array([r.randrange(v) for _ in range(r.randrange(70))], np.uint32) for _ in range(2))
        rows = [[0] * (len(b) + 1)]
        for x in a.tolist():
            row = [0]
            for j, y in enumerate(b.tolist()):
                row.append(max(rows[-1][j + 1], row[-1], rows[-1][j] + (x == y)))
            rows.append(row)
        want, i, j = [], len(a), len(b)
        while i and j and rows[i][j]:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                want.append((i, j))
        assert S._gap(a, b) == want[::-1]


def test_all_pairs_of_differing_copies(spark):
    """Twenty-four texts hold a passage of 60 words, each with other edits: all pairs whose words suffice, as by comparing all."""
    r = random.Random(31)
    passage, rows, own = words(r, 60), [], []
    for i in range(24):
        p = list(passage)
        for at in r.sample(range(2, 58), 3):
            p[at] = f"e{i}x{at}"
        own.append(p)
        rows.append((i, " ".join([f"a{i}x{j}" for j in range(30)] + p + [f"b{i}x{j}" for j in range(30)])))
    got = {(x["doc_id"], x["other_id"]) for x in S.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = {(i, j) for i in range(24) for j in range(i) if sum(a == b for a, b in zip(own[i], own[j])) >= 48}
    assert len(want) > 200
    assert len(got & want) >= 0.98 * len(want)  # a few pairs share fewer than two seeds


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_equal_texts_are_one_class(spark, bound):
    """Copies have a row with the least id, from end to end; links of others go to it alone."""
    r = random.Random(9)
    text, short = words(r, 100), words(r, 30)
    near = text[:70] + words(r, 30)
    rows = [(i, " ".join(text)) for i in (7, 3, 9, 9)] + [(9, " ".join(short)), (4, " ".join(short)), (5, " ".join(near)), (6, " ".join(words(r, 80)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(x) for x in S.repeated_passages(spark, df, wanted_bound=bound).collect())
    assert got == [(5, 3, 0, 70, 0, 70, 70), (7, 3, 0, 100, 0, 100, 100), (9, 3, 0, 100, 0, 100, 100)]


def test_chains_at_once_against_one_by_one():
    """All pairs of a stream at once give the chains that each pair gives by itself, whatever the batches."""
    r = random.Random(10)
    rows = []
    for pair in range(60):
        n, p, o = r.randrange(1, 9), r.randrange(50), r.randrange(50)
        for _ in range(n):
            size = r.choice([0, 0, 0, 16, 32])
            rows.append((pair // 7, pair % 7, pair, 0, p, o, size))
            p, o = p + r.choice([0, 1, 3, 9, 45]), o + r.choice([1, 3, 9, 9, 45] if pair % 2 else [-4, 1, 9])
    rows.sort()
    want = []
    for key in sorted({x[:4] for x in rows}):
        a = {(x[4], x[5]) for x in rows if x[:4] == key} | {(x[4] + x[6] - 5, x[5] + x[6] - 5) for x in rows if x[:4] == key and x[6]}
        p, o = np.array(sorted(a)).T
        for c in S.chain(p, o):
            if len(c) > 1 and p[c[-1]] - p[c[0]] + 5 + 2 * S.MARGIN >= 90:
                want.append((*key, [x for t in S._diagonals(p[c], o[c]) for x in t]))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int8())
    for step, least in ((3, 1), (1000, 50), (10, 10)):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + step]), kinds)], names=list("abcdefg")) for i in range(0, len(rows), step)]
        got = [tuple(x.values()) for b in S._chains(batches, 5, 90, least) for x in b.to_pylist()]
        assert sorted(map(str, got)) == sorted(map(str, want)) and want


def test_no_hopeful_chain_is_lost():
    """The bound is never below the equal words of the alignment."""
    r = random.Random(11)
    for _ in range(300):
        a = [r.randrange(40) for _ in range(r.randrange(60, 200))]
        a[30:30] = [r.randrange(40, 80) for _ in range(r.choice([0, 8, 25]))]
        b = [w if r.random() < 0.85 else r.randrange(40) for w in a if r.random() < 0.97]
        anchors = sorted({(i, j) for i in range(len(a) - 5) for j in range(max(0, i - 12), min(len(b) - 5, i + 12)) if a[i : i + 5] == b[j : j + 5]})
        if len(anchors) < 2:
            continue
        p, o = np.array(anchors).T
        for c in S.chain(p, o):
            runs = np.array([x for t in S._diagonals(p[c], o[c]) for x in t])
            lo, olo = max(0, runs[0] - S.MARGIN), max(0, runs[0] - runs[2] - S.MARGIN)
            x = np.array(a, "<u4")[lo : runs[-2] + 5 + S.MARGIN]
            y = np.array(b, "<u4")[olo : runs[-2] - runs[-1] + 5 + S.MARGIN]
            at, oat = S.equal_words(x, y, runs.reshape(-1, 3) - np.array([lo, lo, lo - olo]))
            args = pa.array([runs.tolist()], pa.list_(pa.int32())), np.array([lo]), np.array([olo]), pa.array([x.tobytes()]), pa.array([y.tobytes()])
            for least, percent in ((20, 80), (30, 90), (10, 50), (48, 80)):
                assert S.hopeful(*args, least, percent).all() or not S.stretches(at, oat, least, percent)
            assert not S.hopeful(*args, 10_000, 80).any() or len(runs) > 3 * S.MOST_RUNS


def test_stretches_against_all():
    r = random.Random(9)
    for _ in range(200):
        p, o = (np.cumsum([r.choice([1, 1, 1, 1, 1, 2, 4]) for _ in range(30)]) for _ in "ab")
        good = lambda i, j: min(p[j - 1] - p[i], o[j - 1] - o[i]) + 1 >= 8 and 100 * (j - i) >= 80 * (max(p[j - 1] - p[i], o[j - 1] - o[i]) + 1)
        got = S.stretches(p, o, 8, 80)
        assert all(good(i, j) for i, j in got) and all(a[1] <= b[0] for a, b in zip(got, got[1:]))
        span = lambda i, j: max(p[j - 1] - p[i], o[j - 1] - o[i]) + 1
        assert max((span(i, j) for i, j in got), default=0) == max((span(i, j) for i in range(30) for j in range(i + 1, 31) if good(i, j)), default=0)
        free = np.ones(30, bool)
        for i, j in got:
            free[i:j] = False
        assert not any(good(i, j) and free[i:j].all() for i in range(30) for j in range(i + 1, 31))


def local(text, template):
    """Matched words of the best local alignment, over all places."""
    best, row = (0, 0), [(0, 0)] * (len(template) + 1)
    for x in text:
        new = [(0, 0)]
        for j, y in enumerate(template):
            new.append(max((row[j][0] + (2 if x == y else -1), row[j][1] + (x == y)), (row[j + 1][0] - 1, row[j + 1][1]), (new[j][0] - 1, new[j][1]), (0, 0)))
        best, row = max(best, *new), new
    return best[1]


def test_licenses_against_full_alignment():
    r = random.Random(6)
    index = L.Index(L.TEMPLATES)
    ids = L.PlainIds()
    for name, text in L.TEMPLATES.items():
        own = text.split()
        if len(own) > 8:
            own[len(own) // 2] = "changed"
        body = words(r, 30) + own + words(r, 20)
        got = L.scan_texts([" ".join(body).encode()], index, 0.75)[0]
        assert len(got) == 1 and got[0][0] == name
        _, n, share, lo, hi = got[0]
        plain = ids.array([w.encode() for w in body])
        template = index.words[index.names.index(name)]
        assert n == local(plain[plain != 0].tolist(), template.tolist()) and share == n / len(template)
        assert 28 <= lo <= 31 and 30 + len(own) - 1 <= hi <= 30 + len(own) + 1


@pytest.mark.parametrize("cuts", [(2,), (3, 3), (6,) * 5])
@pytest.mark.parametrize("more", [7, 20, 90])
def test_licenses_with_added_words(cuts, more):
    r = random.Random(7)
    index = L.Index(L.TEMPLATES)
    for name in ("mit", "bsd-2-clause", "gpl-header"):
        own, size = L.TEMPLATES[name].split(), len(L.TEMPLATES[name].split())
        for i in range(len(cuts), 0, -1):
            at = size * i // (len(cuts) + 1)
            own[at:at] = words(r, more)
        got = L.scan_texts([" ".join(words(r, 300) + own + words(r, 300)).encode()], index, 0.75)[0]
        assert [(g[0], g[2] > 0.95, abs(g[3] - 300) < 3, abs(g[4] - 300 - len(own)) < 3) for g in got] == [(name, True, True, True)]


def test_licenses_twice_and_warranty_alone():
    index = L.Index(L.TEMPLATES)
    text = f"{L.TEMPLATES['isc']} and {L.TEMPLATES['isc']} so {L.TEMPLATES['mit-warranty']}"
    assert [g[0] for g in L.scan_texts([text.encode()], index, 0.75)[0]] == ["isc", "isc", "mit-warranty"]


@pytest.mark.parametrize("name", ["all-rights-reserved", "mit-notice", "isc", "bsd-warranty"])
def test_every_copy_of_a_notice(name):
    index, text = L.Index(L.TEMPLATES), L.TEMPLATES[name]
    n = len(text.split())
    for gap in range(13):
        for copies in (2, 6):
            words_ = "a b c " + (" " + " ".join(f"x{i}" for i in range(gap)) + " ").join([text] * copies) + " d e"
            got = L.scan_texts([words_.encode()], index, 0.75)[0]
            assert [(g[0], g[2], g[3], g[4]) for g in got] == [(name, 1.0, 3 + i * (n + gap), 3 + i * (n + gap) + n) for i in range(copies)]


def test_many_notices_take_time_by_their_number():
    index = L.Index(L.TEMPLATES)
    began = time.monotonic()
    got = L.scan_texts([" x y z w ".join(["All rights reserved."] * 4000).encode()], index, 0.75)[0]
    assert [(g[3], g[4]) for g in got] == [(7 * i, 7 * i + 3) for i in range(4000)] and time.monotonic() - began < 30


def test_licenses_whole_table_against_full_alignment(spark, sf_dir):
    """Rows are those of aligning every template with every whole text, best first, without an index."""
    index, ids = L.Index(L.TEMPLATES), L.PlainIds()
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        plain = ids.array(r["text"].encode().split()) if r["text"] else np.zeros(0, np.uint64)
        real = np.flatnonzero(plain)
        plain, found = plain[real], []
        for name, template in zip(index.names, index.words):
            todo = [(0, len(plain))] if len(set(plain.tolist()) & set(template.tolist())) >= 0.75 * len(set(template.tolist())) else []
            while todo:
                lo, hi = todo.pop()
                n, a, b = L.align(plain, lo, hi, template, True) if hi > lo else (0, 0, 0)
                if n >= 0.75 * len(template):
                    found.append((name, n, int(real[a]), int(real[b - 1]) + 1))
                    todo += [(lo, a), (b, hi)]
        found.sort(key=lambda x: (-x[1], x[2], x[0]))
        kept = []
        for f in found:
            if all(f[3] <= k[2] or f[2] >= k[3] for k in kept):
                kept.append(f)
        want |= {(r["doc_id"], *k) for k in kept}
    got = {(r["doc_id"], r["license"], r["matched"], r["first_word"], r["end_word"]) for r in L.op8_license_scan(spark, sf_dir).collect()}
    assert got == want and want


def test_licenses_odd(spark, odd, nothing):
    assert L.scan_licenses(spark, odd).collect() == [] and L.scan_licenses(spark, nothing).collect() == []
    more = spark.createDataFrame([(1, "x y\nAll Rights Reserved.\nz"), (2, None), (3, "Licensed under CC BY-NC 4.0. Released under the MIT License.")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["license"], r["first_word"], r["end_word"]) for r in L.scan_licenses(spark, more).collect())
    assert got == [(1, "all-rights-reserved", 2, 5), (3, "cc-by-nc-4.0-notice", 0, 5), (3, "mit-notice", 5, 10)]
    assert L.scan_licenses(spark, more, templates={}).collect() == []


def test_licenses_whole_table(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {(r["doc_id"], r["license"]) for r in L.op8_license_scan(spark, sf_dir).collect()}
    want = {(i, n) for i, t in docs.items() for n, x in L.TEMPLATES.items() if x in t}
    assert want <= got
