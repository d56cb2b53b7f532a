"""Every registered query that SQL can express against its SQL, on the whole tables."""

import os

import duckdb
import pytest

from docvalid.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, name):
    got = QUERIES[name](spark, SF_DIR)
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    con.register("found", got.toArrow())
    con.execute(f"CREATE TABLE want AS {ORACLE_SQL[name]}")
    assert [d[:2] for d in con.execute(f"SELECT {columns} FROM want").description] == [d[:2] for d in con.execute(f"SELECT {columns} FROM found").description]
    assert con.execute("SELECT count(*) FROM want").fetchone() == con.execute("SELECT count(*) FROM found").fetchone()
    assert con.execute(f"SELECT {columns} FROM want EXCEPT ALL SELECT {columns} FROM found").fetchall() == []
