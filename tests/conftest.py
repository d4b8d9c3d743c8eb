import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(tmp_path):
    """Writes lines of text or bytes to a file and gives its path."""

    def write(name, rows):
        path = tmp_path / name
        path.write_bytes(b"".join((r if isinstance(r, bytes) else r.encode()) + b"\n" for r in rows))
        return path

    return write


def duck(sf_dir, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con.sql(sql).to_arrow_table()


def same_rows(df, table):
    """Whether a DataFrame and an Arrow table hold the same rows, by column names."""
    names = sorted(df.columns)
    assert names == sorted(table.column_names)
    show = lambda rows: sorted(repr([r[c] for c in names]) for r in rows)
    mine, theirs = show(df.toArrow().to_pylist()), show(table.to_pylist())
    assert len(mine) == len(theirs)
    assert mine == theirs
