import os

import duckdb
import pytest

from rulemill.llm import oracles, queries

from .helpers import frame, odd_documents

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DIR)
    want = c.execute(oracles.ORACLES[name])
    names = [d[0] for d in want.description]
    pick = lambda rows, columns: sorted(repr([r[columns.index(n)] for n in sorted(columns)]) for r in rows)
    assert sorted(names) == sorted(got.columns)
    assert pick([tuple(r) for r in got.collect()], got.columns) == pick(want.fetchall(), names)


@pytest.mark.parametrize("name", ["op5_secret_ledger", "op7_line_dedup"])
def test_query_equals_sql_on_odd_rows(spark, tmp_path, name):
    """Nulls, repeated rows and different texts under one key: the SQL tells rows apart as the operators do."""
    rows = odd_documents() + [(7, f"Shared Line\nother {i}", "en", "s", 1) for i in range(3)] + [(8, "twelve\ntimes", "en", "s", 1)] * 12
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = c.execute(oracles.ORACLES[name])
    names = [d[0] for d in want.description]
    pick = lambda rows, columns: sorted(repr([r[columns.index(n)] for n in sorted(columns)]) for r in rows)
    assert pick([tuple(r) for r in got.collect()], got.columns) == pick(want.fetchall(), names)
