"""Every named query has SQL that runs, with plain column types and no duplicates."""

from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="given tables are absent")
duckdb = pytest.importorskip("duckdb")


def test_sql_twins_run_and_use_comparable_types():
    import __spark_entry__ as entries
    from compare import connect

    con = connect(FOLDER)
    names = set(entries.queries())
    assert set(entries.oracle_sql()) <= names and len(names) >= 150
    for name, sql in entries.oracle_sql().items():
        types = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
        assert set(types.values()) <= {"VARCHAR", "BIGINT", "DOUBLE", "BOOLEAN"}, (name, types)


def test_flagship_runs_on_the_smallest_tables(spark):
    import __spark_entry__ as entries

    got = entries.entry(spark).collect()
    assert len(got) == 1 and got[0]["annual_vol"] > 0
