"""Best-fit packing of token pieces into sequences of a fixed capacity.

Best-fit decreasing looks only at lengths, and a length is one of ``capacity`` values. So the
plan is made from the histogram of lengths, a table of at most ``capacity`` rows whatever the
corpus: bins of equal free space are kept as runs, and a segment tree over the free spaces
finds the tightest space that still fits in logarithmic time. The plan is what document-by-
document best-fit decreasing would do, with as many runs as there are steps, not documents.

The corpus is tokenised once, in a narrow stage that also ranks each piece within its task and
length. Per-(task, length) counts turn that into a rank over the corpus without moving or
sorting texts, and no task ever holds all pieces of a frequent length.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache, partial
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import samples
from granary.llm import words as W

RANK_BITS = 44


class FreeSpace:
    """Segment tree over free spaces 0..capacity: runs of open bins with that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1 - 1).bit_length()
        self.any = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        i, now = room + self.size, bool(self.runs[room])
        while i and self.any[i] != now:
            self.any[i] = now
            i >>= 1
            now = self.any[2 * i] or self.any[2 * i + 1] if i else now

    def push(self, room: int, first: int, bins: int) -> None:
        self.runs[room].append((first, bins))
        self._mark(room)

    def pop(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def tightest(self, length: int) -> int | None:
        """The smallest room of an open bin that is at least ``length``."""
        i = length + self.size
        if self.any[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing on counts: rows (length, rank from, pieces a bin, first bin, offset).

    The pieces of a length with ranks from ``rank from`` on, up to the next row, fill bins from
    ``first bin`` on, so many to a bin, the first at ``offset``.
    """
    free, made, out = FreeSpace(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = free.tightest(length)
            if room is None:
                room, first, bins = capacity, made, -(-left // (capacity // length))
                made += bins
            else:
                first, bins = free.pop(room)
            each = room // length
            out.append((length, rank, each, first, capacity - room))
            full, rest = divmod(min(left, bins * each), each)
            if full:
                free.push(room - each * length, first, full)
            if rest:
                free.push(room - rest * length, first + full, 1)
            if (idle := bins - full - bool(rest)) > 0:
                free.push(room, first + full + bool(rest), idle)
            left -= full * each + rest
            rank += full * each + rest
    return np.array(out, dtype=np.int64).reshape(-1, 5)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_MARKS = b".,;:!?#$%&*|()"
#: Letters whose lower case depends on their place or is more than a letter.
_CASES = frozenset("\u03a3\u0130")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    return table | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in table)}


_LETTERS = _byte_letters()


class WordTokens(dict):
    """word -> its ids as little-endian 32-bit; holds ``bound`` words, the first met.

    Where probes show that the vocabulary ignores case and splits letters from marks (``parts``), a
    word of letters and closing marks is put together from the ids of its lower-case letters, which
    go to the merges directly, and of its marks. All other words take the whole tokenizer.
    """

    def __init__(self, path: str, bound: int = 800_000):
        super().__init__()
        self.tokenizer, self.bound = _tokenizer(path), bound
        self.model = self.tokenizer.model
        self.parts = False
        letters = [w.encode() for w in ("word", "an", "x", "über", "ñaó", "straße", "слово", "言葉")]
        self.parts = all(self.whole(w) == self.letters(w) and self.whole(w.decode().upper().encode() + m) == self.whole(w.decode().upper().lower().encode()) + self.whole(m) for w in letters for m in (b".", b",", b"!!", b"$$$", b"|,"))

    def whole(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def letters(self, word: bytes) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(_LETTERS))]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        low = None
        if self.parts and (core := word.rstrip(_MARKS)):
            if core.isalpha():  # of bytes: A-Z and a-z alone
                low = core.lower()
            elif not core.isascii() and (c := core.decode()).isalpha() and is_normalized("NFC", c) and not _CASES.intersection(c):
                low = c.lower().encode()
        if low is None:
            ids = self.whole(word)
        elif len(core) < len(word):
            ids = self[low] + self[word[len(core) :]]
        else:
            ids = self[low] if low != word else self.letters(word)
        if len(self) < self.bound:
            self[word] = ids
        return ids


def token_bytes(text: bytes, path: str) -> bytes:
    """Ids of a text by a vocabulary that drops white space, so that each word is encoded on its own."""
    cache = W.worker_cache(("tokens", path), lambda: WordTokens(path))
    return b"".join(map(cache.__getitem__, text.split()))


def _pieces(batches, path: str, capacity: int, end: bytes, with_ids: bool):
    from pyspark import TaskContext

    part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
    for b in W.slices(batches):
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), W.raw(b.column(1))):
            ids = token_bytes(text, path) + end
            for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[lo : lo + 4 * capacity]
                n = len(own) // 4
                rows.append((doc, k, lo // 4, n, zlib.crc32(own), part, met[n], own if with_ids else None))
                met[n] += 1
        c = list(zip(*rows))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        names = ("doc_id", "piece", "start", "length", "ids_crc32", "_part", "_local", "ids")
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds)][: 7 + with_ids], names=names[: 7 + with_ids])


def _place(batches, shared):
    rows = shared.value
    start = (rows[:, 0] << RANK_BITS) + rows[:, 1]
    order = np.argsort(start)
    rows, start = rows[order], start[order]
    for b in batches:
        if not b.num_rows:
            continue
        cols = dict(zip(b.schema.names, b.columns))
        length, rank = cols["length"].to_numpy(), cols.pop("_rank").to_numpy()
        r = rows[np.searchsorted(start, (length << RANK_BITS) + rank, side="right") - 1]
        nth = rank - r[:, 1]
        cols["sequence_id"], cols["offset"] = pa.array(r[:, 3] + nth // r[:, 2]), pa.array(r[:, 4] + nth % r[:, 2] * length)
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(spark: SparkSession, docs: DataFrame, capacity: int = 4096, vocabulary: str | None = None, end_id: int = 1, text: str = "text", ident: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` tokens.

    A document is its ids and then ``end_id``; one longer than ``capacity`` is cut into whole
    pieces and a rest. Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset and,
    with ``with_ids``, the ids as little-endian 32-bit numbers. Null or empty text is the end id
    alone; a null ``ident`` stays null; repeated rows are packed each; columns of ``docs`` other
    than the two named are not read, so their names can't clash. No rows give no rows. Which of
    two pieces of one length comes first is fixed by the written piece table; the set of lengths
    in each sequence depends on the input alone.

    ``vocabulary`` is a tokenizers file that drops white space (each word is encoded on its own).
    """
    path = vocabulary or default_vocabulary()
    end = np.array([end_id], dtype="<u4").tobytes()
    scratch = runtime.Scratch(spark)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _local long" + ", ids binary" * with_ids
    own = docs.select(samples.long_id(docs, ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = scratch.table(own.mapInArrow(partial(_pieces, path=path, capacity=capacity, end=end, with_ids=with_ids), kinds), "pieces")
    counts = pieces.groupBy("_part", "length").count()
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.table(counts.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))), "offsets")
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(plan(histogram, capacity))
    ranked = pieces.join(offsets.drop("count").hint("merge"), ["_part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("_before") + F.col("_local")).alias("_rank"))
    return ranked.mapInArrow(partial(_place, shared=shared), "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids + "sequence_id long, offset long")


def _ids(column: pa.Table) -> pa.Table:
    t = column.sort_by("offset")
    return pa.table({"sequence_id": t["sequence_id"][:1], "ids": pa.array([np.frombuffer(b"".join(t["ids"].to_pylist()), "<u4").astype(np.int32)], pa.list_(pa.int32()))})


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from ``pack(..., with_ids=True)``; a group is one sequence."""
    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(_ids, "sequence_id long, ids array<int>")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, runtime.table(spark, sf_dir, "documents"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
SQL: dict[str, str] = {}
