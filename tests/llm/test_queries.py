"""Every query of the subpackage against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from pagesift.llm.queries import ORACLES, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    of = "pages" if name.startswith(("op1_", "op5_")) else "documents"
    each = 3 if name.startswith("op5_") else 1
    if name.startswith("op12_"):
        assert len(rows) == sql.execute("SELECT count(DISTINCT conv_id) + 1 FROM conversations").fetchone()[0]
    elif not name.startswith("op13_"):
        assert len(rows) == each * sql.execute(f"SELECT count(*) FROM {of}").fetchone()[0]
    if name not in ORACLES:
        return
    result = sql.execute(ORACLES[name])
    order = sorted(range(len(columns)), key=lambda i: result.description[i][0])
    assert [result.description[i][0] for i in order] == columns
    expected = [tuple(row[i] for i in order) for row in result.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))
