import duckdb
import pytest

from meridion.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    if name in ORACLE:
        rel = db.sql(ORACLE[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        expected = sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=str)
        assert [tuple(map(float, x)) if all(isinstance(v, (int, float)) for v in x) else x for x in got] == [tuple(map(float, x)) if all(isinstance(v, (int, float)) for v in x) else x for x in expected]
    else:
        assert got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
