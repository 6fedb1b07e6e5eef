import math
import os

import duckdb
import pytest

from rulemill.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{t}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    if name == "feature_importance":
        pytest.skip("a model is fitted; see test_selection")
    got = catalog.QUERIES[name](spark, DIR)
    rows = plain([tuple(r) for r in got.collect()], got.columns)
    if name not in catalog.ORACLES:
        assert rows
        return
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns) and rows == plain(want.fetchall(), names)


def test_entry_works_without_the_removable_parts(tmp_path):
    """Without the llm folder and the pipeline, the entry still imports and lists the other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/rulemill", tmp_path / "rulemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n[:2] == 'op' or n == 'pipeline']; assert e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
