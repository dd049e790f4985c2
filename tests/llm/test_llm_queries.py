"""The pipeline's queries against their SQL in DuckDB."""

import duckdb
import pytest

from quarrykit.llm.oracles import ORACLES
from quarrykit.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def values(rows):
    plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v.item() if hasattr(v, "item") else v
    return sorted(repr([(c, plain(v)) for c, v in sorted(r.items())]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert values(QUERIES[name](spark, SF).toPandas().to_dict("records")) == values(con.sql(ORACLES[name]).df().to_dict("records"))
