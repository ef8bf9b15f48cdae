import hashlib
import re
from collections import Counter

import pytest

from granary.llm import line_dedup as L


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, least, first=False):
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    hot = {k for k, c in n.items() if c >= least}
    owner = {k: min((i if i is not None else 1 << 63) for i, t in rows if k in {key(x) for x in (t or "").split("\n")}) for k in hot}
    out = []
    for i, t in rows:
        lines, kept, met = (t or "").split("\n"), [], set()
        for x in lines:
            k = key(x)
            if k not in hot or (first and owner[k] == (i if i is not None else 1 << 63) and k not in met):
                kept.append(x)
            met.add(k)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("bound", [1000, 0])
def test_odd_documents(spark, odd, keep, bound):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    out = L.dedup_lines(spark, odd, min_docs=2, keep=keep, hot_bound=bound)
    assert set(odd.columns) <= set(out.columns)
    got = sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()], key=str)
    assert got == brute(rows, 2, keep == "first")


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute(rows, 10)}
    assert {tuple(r) for r in L.op9_line_dedup(spark, sf_dir).collect()} == want


def test_empty_and_small_filter(spark, nothing, odd):
    assert L.dedup_lines(spark, nothing).collect() == []
    small = L.dedup_lines(spark, odd, bits=1 << 20, keep="none")
    assert small.count() == odd.count()


def test_filter_has_no_false_negative(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line {i // 2} {k}" for k in range(50))) for i in range(60)], "doc_id long, text string").repartition(7)
    out = L.dedup_lines(spark, docs, min_docs=2, keep="none")
    assert {r["n_dropped"] for r in out.collect()} == {50}


def test_bad_argument(spark, odd):
    with pytest.raises(ValueError):
        L.dedup_lines(spark, odd, keep="last")


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("bound", [1000, 0])
def test_ids_as_text_and_awkward_columns(spark, awkward, keep, bound):
    rows = [tuple(r) for r in awkward.collect()]
    number = {"1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "n": 100, None: None}  # "n" holds no line of others
    out = L.dedup_lines(spark, awkward, min_docs=2, keep=keep, hot_bound=bound)
    assert out.columns == [*awkward.columns, "n_lines", "n_dropped"]
    got = [tuple(r) for r in out.collect()]
    assert sorted([(number[r[0]], r[1], r[-2], r[-1]) for r in got], key=str) == brute([(number[r[0]], r[1]) for r in rows], 2, keep == "first")
    assert sorted(map(str, ((r[0], *r[2:-2]) for r in got))) == sorted(map(str, ((r[0], *r[2:]) for r in rows)))


def test_slices_are_packed_either_way():
    import numpy as np

    rng = np.random.default_rng(1)
    for share in (0, 0.001, 0.02, 0.5, 1):
        x = np.packbits(rng.random(8 * 4096) < share)
        assert (L._unpacked(L._packed(x), 4096) == x).all() and len(L._packed(x)) <= 4096


def test_filters_grow_with_the_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = L.filter_bits(docs, "text")
    assert L.LEAST_BITS <= size <= L.MOST_BITS and size == 1 << size.bit_length() - 1
