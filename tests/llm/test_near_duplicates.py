import random
import re

import numpy as np
import pytest

from granary.llm import near_duplicates as N


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), len(links[i]), min(ids) if ids and sets[i] else rows[i][0]))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("bound,block", [(2_000_000, 1024), (0, 3)])
def test_odd_documents(spark, odd, bound, block):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    same(N.near_duplicates(spark, odd, wanted_bound=bound, block=block).collect(), brute(rows))


@pytest.mark.parametrize("block", [1024, 5])
def test_groups_of_near_copies(spark, block):
    r = random.Random(5)
    rows, i = [], 0
    for size in (40, 7, 3, 2, 1, 1):
        base = [f"w{r.randrange(900)}" for _ in range(r.choice([30, 120, 200]))]
        for _ in range(size):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            rows.append((i, " ".join(own)))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(N.near_duplicates(spark, df, block=block).collect(), brute(rows))


def test_empty(spark, nothing):
    assert N.near_duplicates(spark, nothing).collect() == []
    assert N.keep_one(spark, nothing).collect() == []


def test_keep_one(spark, odd):
    kept = N.keep_one(spark, odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {d for d, _, _, c in brute([(r["doc_id"], r["text"]) for r in odd.collect()]) if d is not None and d == c}
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 2


def test_keep_one_by_row_with_awkward_columns(spark, awkward):
    """Equal ids with other texts are looked at each; columns of any name stay."""
    rows = [tuple(r) for r in awkward.collect()]
    out = N.keep_one(spark, awkward, bound=1)
    assert out.columns == awkward.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows)
    sets = [shingles(r[1]) for r in rows]
    links = [[j for j in range(len(rows)) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])] for i in range(len(rows))]
    order = lambda i: int(rows[i][0]) if rows[i][0] not in (None, "n") else 10**9
    want = [rows[i][:2] for i in range(len(rows)) if rows[i][0] is None or not sets[i] or all(order(j) >= order(i) for j in links[i])]
    assert sorted(map(str, (r[:2] for r in got))) == sorted(map(str, dict.fromkeys(want)))


@pytest.mark.parametrize("tokens", [150, 1000])
def test_units_bounded_in_tokens(spark, tokens):
    r = random.Random(7)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    rows = [(i, " ".join(base[:60] + [f"x{i}"] + base[61:])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(N.near_duplicates(spark, df, tokens=tokens).collect(), brute(rows))


def test_prefixes_share_enough():
    """Two sets that are similar enough share as many prefix tokens as the smaller l asks."""
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, N.BUCKETS)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        drop, add = rng.integers(0, max(1, n // 20) + 1, 2)
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 62, add).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 90 * len(np.union1d(a, b)):
            (p, i), (q, j) = N.prefix(a, counts, 10.0, 90), N.prefix(b, counts, 10.0, 90)
            assert len(np.intersect1d(p, q)) >= min(i, j)


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(9)]
    got = N.overlaps(sets[:5], sets[5:], width=7)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]).all()
