"""Rows are spread by the number of their groups."""

from pyspark.sql import functions as F

from gridcast import staging
from gridcast.operators import quality as Q


def _readings(spark, stations, days, copies=1):
    n = F.col("id")
    when = F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("INTERVAL '1' DAY") * F.pmod(n, F.lit(days))
    station = F.pmod(F.floor(n / days), F.lit(stations)).cast("string")
    target = F.when(n % 3 != 0, n.cast("double"))
    return spark.range(stations * days * copies).select(when.alias("datetime"), station.alias("station"), target.alias("target"))


def test_tasks_of_daily_facts_follow_the_number_of_facts(spark, monkeypatch):
    readings = _readings(spark, 60, 50)
    before = Q.station_date_facts(readings)
    monkeypatch.setattr(staging, "TASK_GROUPS", 100, raising=False)
    facts = Q.station_date_facts(readings)
    # Both summaries group inside the partitions of the facts.
    assert facts.rdd.getNumPartitions() >= 25
    assert sorted(facts.collect()) == sorted(before.collect())
    assert sorted(Q.date_summary(facts).collect()) == sorted(Q.date_summary(before).collect())


def test_dense_rows_are_left_to_partial_sums(spark, monkeypatch):
    monkeypatch.setattr(staging, "TASK_GROUPS", 100, raising=False)
    dense = _readings(spark, 20, 10, copies=30)
    assert staging.spread_groups(dense, "station", "datetime") is dense
    empty = dense.where(F.lit(False))
    assert Q.station_date_facts(empty).count() == 0
