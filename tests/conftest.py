import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def value(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return str(v)[:19] if hasattr(v, "year") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(value(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, "" if x is None else type(x).__name__ if not isinstance(x, (int, float)) else "n", 0 if x is None else x) for x in r))


def same_rows(a, b):
    if len(a) != len(b):
        return False
    close = lambda x, y: x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-5 * max(1, abs(x)))
    return all(all(close(x, y) for x, y in zip(r, s)) for r, s in zip(a, b))


@pytest.fixture(scope="session")
def agree(spark, duck):
    def check(name, run, sql):
        got = run(spark, DATA)
        want = duck.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns), name
        b = rows_of(names, want.fetchall())
        a = rows_of(got.columns, [tuple(r) for r in got.collect()])
        assert same_rows(a, b), (name, len(a), len(b), [p for p in zip(a, b) if p[0] != p[1]][:3])
        return a

    return check
