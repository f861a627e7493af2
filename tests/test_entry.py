import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from corpusloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(frame):
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)
    return columns, sorted(repr(tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row)) for row in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_against_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.SQL:
        assert canonical(found) == canonical(duck.sql(catalogue.SQL[name]).df())


def test_entry_without_the_subpackage(tmp_path):
    """A copy of the repository without the subpackage, its tests and the pipeline: the rest imports and runs."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = """import __spark_entry__ as e
assert len(e.queries()) > 60 and not any(k.startswith('op') for k in e.queries()) and 'pipeline' not in e.queries() and 'pipeline' not in e.oracle_sql()
from pyspark.sql import SparkSession
assert len(e.entry(SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()).collect()) == 1"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_entry_with_everything():
    """Where all is there, all is registered; a broken import is not taken for an absent subpackage."""
    import __spark_entry__ as e

    if not e.llm:
        pytest.skip("the subpackage is absent")
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in e.queries()} and "pipeline" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
