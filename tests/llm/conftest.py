import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, piece int, size long, label int, block long, class_key string, token string, n_lines long, rank int, sequence_id long, kind int"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows, clashing extra columns."""
    base, long = words(1, 300), words(2, 12_000, 5_000)
    near = " ".join(base.split()[:-4]) + " a b c d"
    rows = [
        (1, base), (2, None), (3, ""), (4, " \n\t "), (5, base), (6, near), (1, base), (None, base), (None, None), (7, long), (8, long),
        (9, "\n".join(["same line", words(3, 30), "Same Line ", "", "same line"])), (10, "same line\nother"), (11, "one"), (12, "one two three"),
        (13, "One TWO three"), (14, "日本語 テキスト 🙂 <|endoftext|> don't"), (15, words(4, 60) + "\n" + words(5, 60)), (16, words(4, 60) + "\n" + words(6, 60)),
    ]
    full = [(i, t, *(("en", "src0") if k % 3 else (None, None)), None if t is None else len(t), 0.5, 1, 2, None, 3, "k", "t", 4, 5, 6, 7) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 16)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


AWKWARD = ("_own", "own", "_n", "n", "_size", "size", "_lost", "lost", "lost_id", "_digests", "_firsts", "_doc_key", "_per_key", "key", "_id", "_key", "_words", "_taken", "_rows", "component", "count", "a.b")


@pytest.fixture(scope="session")
def awkward(spark):
    """Ids as text, columns with the names that operators may use, equal ids with other texts, equal rows of two sources."""
    base = words(11, 80)
    rows = [("1", "x y z\n" + base, "s"), ("2", "x y z", "s"), ("3", "x y z", "t"), ("3", words(12, 60), "t"), ("4", base + " tail", "s"), ("5", words(13, 50), "s"), ("5", words(13, 50), "u"), ("5", words(13, 50), "u"), ("n", words(14, 40), "u"), (None, base, "u"), ("2", None, None)]
    schema = "doc_id string, text string, source string, " + ", ".join(f"`{n}` string" for n in AWKWARD)
    return spark.createDataFrame([(*r, *(f"{n}{k % 2}" for n in AWKWARD)) if k != 7 else (*r, *(f"{n}0" for n in AWKWARD)) for k, r in enumerate(rows)], schema).repartition(3)
