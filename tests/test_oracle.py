"""Every query against its SQL in DuckDB, row by row."""

import glob

import duckdb
import pytest

import __spark_entry__ as entry
from rastrella import catalog

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = path.split("/")[-1].removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr), sorted(columns)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got, columns = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(catalog.oracle_sql()[name])
    want, wanted = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert columns == wanted and len(got) == len(want) > 0
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    assert not wrong, (len(wrong), wrong[:3])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_jpeg_tiles(spark):
    assert {r["head"][:4] for r in catalog.queries()["encode_jpeg"](spark, DATA).collect()} == {"FFD8"}
