"""Rounding to digits shown, against DuckDB's round_even."""

import duckdb
from pyspark.sql import functions as F

from factloom.functions import scoring
from factloom.plans import registry


def test_halves_are_rounded_as_doubles(spark):
    """45.15 and 62.65 lie below their decimals, 0.25 and 62.75 are exact halves."""
    values = [45.15, 62.65, 62.650000000000006, 0.25, 62.75, -0.35, 0.0, 12.0, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(scoring.round_even(F.col("v"), 1).alias("r"))
    con = duckdb.connect()
    assert [r["r"] for r in got.collect()] == [con.execute("SELECT round_even(?::DOUBLE, 1)", [v]).fetchone()[0] for v in values]


def test_payload_rounds_as_its_sql(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS doc_id, 'x' AS text FROM range(2000, 2200)) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(registry.oracle_sql()["payload_fields"]).fetchall()
    got = registry.queries()["payload_fields"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
