import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]
DATA = "/root/testdata/sf0.001"

NAMES = ("token_counts", "list_table_state", "semantic_topk", "chunk_sizes", "prompt_evidence", "quoted_titles")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    if not Path(DATA).exists():
        pytest.skip("test tables are not here")
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    import __spark_entry__ as entry
    from check import rows

    assert rows(entry.queries()[name](spark, DATA).toPandas()) == rows(db.execute(entry.oracle_sql()[name]).df())


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
