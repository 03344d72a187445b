"""Means next to a half, rounded the way the SQL rounds them."""

import datetime as dt

import duckdb

import __spark_entry__ as entry_module
from check_oracle import compare

# On either side of a half: scaling by 10,000 moves the first up to it, the second below it.
BESIDE_A_HALF = (58.473749999999995, 65.99125, 53.646249999999995, 51.51125, 12.5, 58.4737)


def test_tsf_cells_round_as_the_sql_does(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i), 1, "click", v) for i, v in enumerate(BESIDE_A_HALF)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(
        str(tmp_path / "events.parquet")
    )
    ours = entry_module.queries()["s07_tsf_scan"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert compare(ours, con.execute(entry_module.oracle_sql()["s07_tsf_scan"]).df()) == "ok"
