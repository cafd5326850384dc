"""Every query with SQL gives what DuckDB gives, over the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

DIR = os.environ.get("QUERY_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return float(value) if type(value).__name__ == "Decimal" else int(value) if isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(entry.reference.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    result = entry.queries()[name](spark, DIR)
    columns = sorted(result.columns)
    got = [tuple(plain(v) for v in r) for r in result.select([f"`{c}`" for c in columns]).collect()]
    quoted = ", ".join(f'"{c}"' for c in columns)
    found = duck.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})")
    want = [tuple(plain(v) for v in r) for r in found.fetchall()]
    order = lambda r: [(v is None, str(type(v)), v) for v in r]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert columns == sorted(d[0] for d in duck.execute(f"SELECT * FROM ({entry.oracle_sql()[name]}) LIMIT 0").description)
