import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from larkspur.session import session

    s = session("local[4]", 4, **{
        "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    })
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame has the columns and rows, in any order, of a SQL query's result."""

    def plain(v):
        if isinstance(v, float):
            return "nan" if v != v else float(f"{v:.10g}")
        return v

    def check(df, sql):
        want = duck.sql(sql)
        names = sorted(want.columns)
        assert sorted(df.columns) == names
        got = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
        rel = want.select(", ".join(f'"{n}"' for n in names)).fetchall()
        assert got == sorted(repr(tuple(plain(v) for v in r)) for r in rel)

    return check
