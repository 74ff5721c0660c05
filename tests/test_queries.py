"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from seqloom.plans import catalog

SF = "/root/testdata/sf0.001"
CHECKED = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def cell(x):
    return round(x, 6) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted((tuple(map(cell, r)) for r in got.select([f"`{c}`" for c in columns]).collect()), key=str)
    assert rows == sorted((tuple(map(cell, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_there_are_rows_to_compare(name):
    """Where the driver compares: a query without rows could not fail there."""
    con = duckdb.connect()
    for table in os.listdir(CHECKED):
        con.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{CHECKED}/{table}'")
    assert con.sql(f"SELECT count(*) FROM ({catalog.ORACLE_SQL[name].strip().rstrip(';')})").fetchall()[0][0] > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_streams(spark, tmp_path):
    from seqloom.streaming import events

    table = spark.read.parquet(f"{SF}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    for build, name in ((events.windowed_counts, "w"), (events.sessions, "s"), (lambda e: events.first_of_each(e, ["user_id", "event_type"]), "f")):
        stream = build(events.read_events(spark, str(tmp_path / "in"), table.schema, 10))
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table(name).count() > 0
