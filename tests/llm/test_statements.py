"""Queries that SQL can express against their statements, on the smallest tables."""

import pytest

from bidlake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_statement(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    plain = lambda v: str(v) if hasattr(v, "isoformat") else v
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    rel = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr) and got
