import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from granary.llm import packing as P


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i in range(len(room)) if room[i] >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 37, 100])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 250))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan, bins = P.plan(histogram, capacity), {}
    for n, count in histogram.items():
        rows = plan[plan[:, 0] == n]
        for rank in range(count):
            _, first, each, bin_, offset = rows[np.searchsorted(rows[:, 1], rank, side="right") - 1]
            bins.setdefault(bin_ + (rank - first) // each, []).append((offset + (rank - first) % each * n, n))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in bins.values()) == best_fit(lengths, capacity)


def check(spark, docs, packed, capacity):
    t = Tokenizer.from_file(P.default_vocabulary())
    want = []
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want.append((r["doc_id"], k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    got = packed.collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got], key=key) == sorted(want, key=key)
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values(), default=0) <= capacity
    assert sorted(capacity - n for n in at.values()) == best_fit([w[3] for w in want], capacity)


def test_odd_documents(spark, odd):
    check(spark, odd, P.pack(spark, odd, capacity=256), 256)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(spark, docs, P.op1_best_fit_packing(spark, sf_dir), 4096)


def test_empty(spark, nothing):
    assert P.pack(spark, nothing).collect() == []


def test_sequences_round_trip(spark, odd):
    packed = P.pack(spark, odd, capacity=128, with_ids=True)
    seqs = {r["sequence_id"]: r["ids"] for r in P.sequences(packed).collect()}
    for r in packed.collect():
        own = seqs[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert np.array(own, "<u4").tobytes() == r["ids"]


@pytest.mark.parametrize("text", ["ΣΑΣ όΣ, İstanbul! éa é!", "'S'S don't we'll!! it's.", "½ x² ａｂ ﬁn Ⅷ. ẞ. ǅ ªº ʰ!", "a\x85b　c\x00d <|endoftext|>x", "", "  "])
def test_words_as_the_whole_tokenizer(text):
    t = Tokenizer.from_file(P.default_vocabulary())
    assert P.token_bytes(text.encode(), P.default_vocabulary()) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
