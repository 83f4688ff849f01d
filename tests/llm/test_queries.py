"""The queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from canonflow.llm.oracle import ORACLE
from canonflow.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = QUERIES[name](spark, sf_dir)
    wanted = con.execute(ORACLE[name])
    names = [x[0] for x in wanted.description]
    assert sorted(names) == sorted(found.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted((tuple(r[names.index(c)] for c in found.columns) for r in wanted.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
