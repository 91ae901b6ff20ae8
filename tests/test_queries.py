"""Every query beside its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lodeseam.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows(frame):
    names = sorted(frame.columns)
    frame = frame[names].astype(object).where(frame[names].notna(), None)
    plain = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in frame.itertuples(index=False, name=None)]
    return names, sorted(plain, key=str)


@pytest.fixture(scope="module")
def con(small):
    out = duckdb.connect()
    for t in TABLES.split():
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, con, name):
    assert rows(QUERIES[name](spark, small).toPandas()) == rows(con.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_detection_stays_in_the_jvm(spark, small):
    plan = QUERIES["detect_counts"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "HashAggregate" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
