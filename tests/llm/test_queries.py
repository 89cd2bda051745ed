"""The subpackage's queries over test data, against SQL where there is some."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from ledgerloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, data, name):
    found = queries.QUERIES[name](spark, data)
    rows = found.collect()
    assert rows
    if name in queries.ORACLE:
        con = duckdb.connect()
        con.execute("SET timezone='UTC'")
        for path in Path(data).glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        want = con.execute(queries.ORACLE[name])
        columns = [d[0] for d in want.description]
        assert sorted(str(tuple(r[c] for c in columns)) for r in rows) == sorted(str(tuple(r)) for r in want.fetchall())
