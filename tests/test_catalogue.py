"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from corvane.plans import harvested, ranked, review, streamed  # noqa: F401  they register their queries
from corvane.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name, tmp_path):
    QUERIES[name](spark, FOLDER).write.parquet(str(tmp_path / "got"))
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    con.sql(f"CREATE TABLE want AS {ORACLES[name]}")
    con.sql(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    columns = ", ".join(sorted(r[0] for r in con.sql("DESCRIBE want").fetchall()))
    assert columns == ", ".join(sorted(r[0] for r in con.sql("DESCRIBE got").fetchall()))
    for a, b in (("want", "got"), ("got", "want")):
        assert con.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []
