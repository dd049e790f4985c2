"""Every registered inventory query against its SQL in DuckDB."""

import duckdb
import pytest

from quarrykit.jobs import inventory

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(columns, rows):
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in rows)


def same(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want, got = con.sql(sql).df(), query(spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    return values(got.columns, got.to_dict("records")) == values(want.columns, want.to_dict("records"))


@pytest.mark.parametrize("name", sorted(inventory.QUERIES))
def test_query_equals_its_sql(spark, name):
    assert same(spark, inventory.QUERIES[name], inventory.ORACLES[name])


def test_everything_is_registered_without_the_pipeline(monkeypatch):
    import importlib
    import sys

    for gone in ("corpus_pipeline", "quarrykit.llm", "quarrykit.llm.oracles", "quarrykit.llm.queries"):
        monkeypatch.setitem(sys.modules, gone, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(inventory.QUERIES) == set(entry.queries()) and set(inventory.ORACLES) == set(entry.oracle_sql())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
