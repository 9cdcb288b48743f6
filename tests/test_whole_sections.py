"""Chunks of sections over the largest size, against the SQL of the queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.operators import pages as P
from folioscope.plans import queries as X


@pytest.fixture
def tables(spark, tmp_path):
    """So many suppliers that the index page lists them in a section of more than ``MAX_TOKENS`` tokens."""
    name = lambda what, width: F.concat(F.lit(f"{what}#"), F.lpad(F.col("id").cast("string"), width, "0"))
    frames = {
        "region": spark.range(5).select(F.col("id").cast("int").alias("r_regionkey"), F.concat(F.lit("REGION"), "id").alias("r_name")),
        "nation": spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("NATION"), "id").alias("n_name"), (F.col("id") % 5).cast("int").alias("n_regionkey")),
        "supplier": spark.range(600).select(F.col("id").alias("s_suppkey"), name("Supplier", 9).alias("s_name"), (F.col("id") * 7 % 25).cast("int").alias("s_nationkey")),
        "customer": spark.range(60).select(F.col("id").alias("c_custkey"), name("Customer", 9).alias("c_name"), (F.col("id") * 3 % 25).cast("int").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment")),
    }
    con = duckdb.connect()
    for k, df in frames.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{k}.parquet")
        con.execute(f"CREATE VIEW {k} AS SELECT * FROM '{tmp_path}/{k}.parquet/*.parquet'")
    return str(tmp_path), con


@pytest.mark.parametrize("name", ["chunks", "index_totals"])
def test_long_sections_as_in_sql(spark, tables, name):
    path, con = tables
    want = con.execute(X.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = X.QUERIES[name](spark, path)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_sections_stay_whole_or_are_split(spark):
    page = spark.createDataFrame([("wiki/p.md", "# A\n\n" + "\n\n".join("w" * 50 for _ in range(5)) + "\n# B\nb\n")], "page_id string, body string")
    whole = P.chunks(page, max_tokens=30, allow_split=False).orderBy("ordinal").collect()
    assert [(r.heading, r.body.count("w"), r.ordinal, r.start_line, r.end_line) for r in whole] == [("A", 250, 0, 1, 11), ("B", 0, 1, 12, 13)]
    assert [r.heading for r in P.chunks(page, max_tokens=30).orderBy("ordinal").collect()] == ["A", "A", "A", "B"]
