import pytest

from granary.llm import mixing as M
from granary import runtime


def levels(sizes, weights, epochs=3):
    """Clamp, share the excess by weight, until none is above."""
    cap, capped, total = [epochs * s for s in sizes], [s == 0 for s in sizes], sum(sizes)
    while not all(capped):
        level = (total - sum(c for c, k in zip(cap, capped) if k)) / sum(w for w, k in zip(weights, capped) if not k)
        more = [not k and level * w > c for c, w, k in zip(cap, weights, capped)]
        if not any(more):
            return [c if k else level * w for c, w, k in zip(cap, weights, capped)]
        capped = [a or b for a, b in zip(capped, more)]
    return [float(c) for c in cap]


@pytest.mark.parametrize("sizes", [[100, 10, 10], [1, 1000, 5, 5, 2], [7], [0, 5], [0, 0], [3, 3, 3, 3, 3, 3, 3]])
def test_targets(spark, sizes):
    src = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in M.source_targets(spark, src, runtime.Scratch(spark)).collect()}
    want = levels(sizes, [M.WEIGHTS[i % 3] for i in range(len(sizes))])
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_odd_documents(spark, odd):
    rows = M.mix(spark, odd).collect()
    assert len(rows) == odd.count()
    assert {r["size"] for r in rows if r["doc_id"] == 2} == {0}
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) < 1
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, M.mix(spark, odd.repartition(5)).collect()), key=str)


def test_null_source_comes_last(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "a a", "z"), (3, "a", "b")], "doc_id long, text string, source string")
    t = {r["doc_id"]: r["target"] for r in M.mix(spark, d).collect()}
    assert t == pytest.approx({3: 2.5, 2: 1.0, 1: 0.5})


def test_empty(spark, nothing):
    assert M.mix(spark, nothing).collect() == []
    assert M.mixed_documents(spark, nothing).collect() == []


def test_mixed_documents_hold_the_taken_words(spark, odd):
    docs = odd.dropDuplicates(["doc_id", "text"])
    want = sum(r["taken"] for r in M.mix(spark, docs).collect())
    out = M.mixed_documents(spark, docs)
    assert out.columns == docs.columns
    assert sum(len(r["text"].split()) for r in out.collect()) == want


@pytest.mark.parametrize("run", [1024, 2])
def test_mixed_documents_are_the_rows_taken(spark, awkward, run):
    """Each row as often as it is taken, columns of any name as they were; equal rows are taken together."""
    rows = awkward.collect()
    taken = {}
    marks = M.mix(spark, awkward, with_key=True, weights=(1, 9, 30)).collect()
    keys = {r["k"]: tuple(r)[:-1] for r in awkward.withColumn("k", M.row_key(awkward)).collect()}
    assert len(keys) == len({tuple(r) for r in rows}) == len(rows) - 1
    for r in marks:
        taken[r["_key"]] = taken.get(r["_key"], 0) + r["taken"]
    want = []
    for k, row in keys.items():
        w = (row[1] or "").split()
        left = taken[k]
        while left > 0:
            want.append((row[0], " ".join(w[:left]), *row[2:]))
            left -= len(w)
    out = M.mixed_documents(spark, awkward, weights=(1, 9, 30), run=run)
    assert out.columns == awkward.columns
    got = [(r[0], " ".join(r[1].split()), *r[2:]) for r in map(tuple, out.collect())]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_equal_texts_of_two_sources_stay_apart(spark):
    d = spark.createDataFrame([(1, "a b c d", "s"), (1, "a b c d", "t"), (1, "a b c d", "u"), (2, "e f g h", "u")], "doc_id long, text string, source string")
    n = {"s": 0, "t": 0, "u": 0}
    for r in M.mixed_documents(spark, d, weights=(1, 1, 1)).collect():
        n[r["source"]] += len(r["text"].split())
    assert n == pytest.approx({"s": 16 / 3, "t": 16 / 3, "u": 16 / 3}, abs=1)


def test_word_counts():
    import pyarrow as pa

    texts = ["a b", None, "", " ", "\x0ba\x0c", "é　ü x", "end"]
    assert M.word_counts(pa.array(texts)).tolist() == [len((t or "").encode().split()) for t in texts]
    assert M.word_counts(pa.array(texts).slice(2, 3)).tolist() == [0, 0, 1]
