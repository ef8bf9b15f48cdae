import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from granary.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
TABLES = "documents embeddings pages benchmark labels conversations region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(tuple(None if v != v or v is None else (list(v) if hasattr(v, "__len__") and not isinstance(v, str) else v) for v in r) for r in d[columns].itertuples(index=False))
    key = lambda r: tuple(map(str, r))
    a, b = sorted([tuple(map(str, r)) for r in got[columns].astype(object).where(got[columns].notna(), None).itertuples(index=False)], key=key), sorted([tuple(map(str, r)) for r in want[columns].astype(object).where(want[columns].notna(), None).itertuples(index=False)], key=key)
    same = lambda x, y: x == y or x.removesuffix(".0") == y.removesuffix(".0")
    assert len(a) == len(b) and all(all(map(same, x, y)) for x, y in zip(a, b)), rows


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["query_id", "rank", "id", "score"] and out.count() > 0


def test_imports_without_the_optional_parts(tmp_path):
    """The entry imports and has the other queries where the training-data operators aren't there."""
    for p in ROOT.rglob("*.py"):
        part = p.relative_to(ROOT)
        if "llm" not in part.parts and part.name != "corpus_pipeline.py" and part.parts[0] in ("granary", "__spark_entry__.py"):
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True, timeout=120)
