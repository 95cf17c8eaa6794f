from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from quarry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert found == sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]}) q").fetchall(), key=repr)
