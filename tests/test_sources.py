"""Files by name and layout, collections, sinks, streams, staging."""

import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridcast import staging
from gridcast.functions import numbers, text, times
from gridcast.operators import clean, quality
from gridcast.plans import curation
from gridcast.sources import collections as C
from gridcast.sources import headers as H
from gridcast.sources import longwide as L
from gridcast.sources import sinks
from gridcast.streaming import ingest

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "FY22" / "north").mkdir(parents=True)
    (tmp_path / "FY22" / "Milltown 66_11kV FY2022.csv").write_text(
        "Date,Year,Unit,00:15,00:30,00:00\n01MAY2021,2022,MW,1.5,NA,3\n02may2021,2022,MW,,oops,6\n"
    )
    (tmp_path / "FY22" / "north" / "Port North 132_11kV FY2022.csv").write_text("Date,00:15\n03MAY2021,7\n")
    (tmp_path / "FY22" / "notes.csv").write_text("a,b\n1,2\n")
    return tmp_path


def test_wide_files_take_the_station_from_the_name(spark, folder):
    rows = L.read_wide(spark, [str(folder / "FY22")]).collect()
    got = {(r["station"], r["datetime"]): r["target"] for r in rows}
    day = dt.datetime(2021, 5, 1)
    quarter = dt.timedelta(minutes=15)
    assert len(rows) == 7
    assert got["Milltown 66_11kV", day + quarter] == 1.5
    assert got["Milltown 66_11kV", day + 2 * quarter] is None
    assert got["Milltown 66_11kV", day + dt.timedelta(days=1) + 2 * quarter] is None
    assert got["Port North 132_11kV", dt.datetime(2021, 5, 3) + quarter] == 7.0


def test_strict_dates_fail_the_job(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Date,00:15\n2021/13/45,7\n")
    with pytest.raises(Exception, match="bad date"):
        L.read_wide(spark, [str(tmp_path)]).collect()
    (tmp_path / "x.csv").write_text("Day,00:15\n01MAY2021,7\n")
    with pytest.raises(ValueError, match="Date"):
        L.read_wide(spark, [str(tmp_path)])


def test_scan_routes_and_rejects(spark, folder):
    (folder / "FY22" / "Zed_long.csv").write_text("datetime,target\n2021-05-01 00:15:00,4\nbroken,5\n")
    (folder / "FY22" / "Bad_long.csv").write_text("datetime,station,target\nnever,Q,4\n")
    scan = L.scan(spark, [str(folder / "FY22"), str(folder / "FY99")], recursive=True)
    stations = {r["station"] for r in scan.readings.select("station").distinct().collect()}
    assert stations == {"Milltown 66_11kV", "Port North 132_11kV", "Zed"}
    rejects = {text_name(r["path"]): (r["reason"], r["rows"]) for r in scan.rejects.collect()}
    assert rejects == {
        "notes.csv": ("unrecognised columns", None),
        "Zed_long.csv": ("unreadable rows", 1),
        "Bad_long.csv": ("no valid datetime", 1),
    }


def test_wide_lines_with_too_many_or_too_few_fields_are_rejected_once(spark, tmp_path):
    path = tmp_path / "Q 11kV FY2022.csv"
    path.write_text("Date,Unit,00:15,00:30\n01MAY2021,MW,1,2\n02MAY2021,MW,3\n03MAY2021,MW,4,5,6\nnever,MW,7,8\n04MAY2021,MW,,9\n")
    scan = L.scan(spark, [str(tmp_path)])
    assert sorted((r["datetime"].day, r["target"]) for r in scan.readings.collect() if r["target"] is not None) == [(1, 1.0), (1, 2.0), (4, 9.0)]
    assert scan.readings.count() == 4
    assert [(r["reason"], r["rows"]) for r in scan.rejects.collect()] == [("unreadable rows", 3)]
    assert L.read_wide(spark, [str(tmp_path)], strict=False).count() == 4
    path.write_text("Date,00:15,00:30\n01MAY2021,1,2\n02MAY2021,3\n")
    with pytest.raises(Exception, match="bad line"):
        L.read_wide(spark, [str(tmp_path)]).collect()


def test_first_lines_need_one_block(tmp_path):
    big = tmp_path / "big.csv"
    big.write_bytes(b"a,b\r\n" + b"1,2\n" * 200_000)
    opened = H.open_store(str(big))[0].open_input_stream(str(big))
    assert H.first_line(f"file:{big}") == "a,b" and opened.read(3) == b"a,b"
    wide = ",".join(f"column{i}" for i in range(50))
    (tmp_path / "wide.csv").write_text(wide + "\n1\n")
    assert H.first_line(str(tmp_path / "wide.csv"), block=16) == wide
    (tmp_path / "packed.csv.gz").write_bytes(gzip.compress(b"x,y\n1,2\n"))
    assert H.first_line(str(tmp_path / "packed.csv.gz")) == "x,y"
    assert H.first_line("viewfs://somewhere/a.csv") is None
    with pytest.raises(FileNotFoundError):
        H.first_line(str(tmp_path / "absent.csv"))


def test_layouts_are_folders_where_they_can_be(spark, tmp_path):
    for name, text in {"p/a [1].csv": "x,y\n", "p/b.csv": "x,y\n1,2\n", "q/c.csv": "x,y\n", "q/d.csv": "z\n", "r/e.csv": "x,y\n", "r/s/f.csv": "\ufeffz\n", "r/empty.csv": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = {k.columns: k.paths for k in L.layouts(spark, [str(tmp_path), str(tmp_path / "none")], recursive=True)}
    where = lambda paths: [p.split(str(tmp_path))[1] for p in paths]
    assert where(found["x", "y"]) == ["/p", "/q/c.csv", "/r/e.csv"]
    assert where(found["z",]) == ["/q/d.csv", "/r/s"]
    files = H.listed(spark, [str(tmp_path)], "*.csv", True, "binaryFile").select("path")
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan
    by_spark = {text_name(r["path"]): r["header"] for r in H._by_spark(spark, [str(tmp_path)], "*.csv", True).collect()}
    ours = {text_name(r["path"]): r["header"] for r in H.first_lines(spark, [str(tmp_path)], recursive=True).collect()}
    assert ours == by_spark and ours["f.csv"] == "z"


def text_name(path):
    return path.rsplit("/", 1)[-1]


def test_channels_are_those_of_the_data(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    more = events.limit(20).withColumn("event_type", F.lit("refund"))
    events.unionByName(more).write.parquet(str(tmp_path / "events.parquet"))
    rows = __spark_entry__.queries()["s08_channel_scan"](spark, str(tmp_path))
    assert "refund" in {r["channel"] for r in rows.select("channel").distinct().collect()}


def test_names_and_numbers(spark):
    df = spark.createDataFrame(
        [("X FY2022_long.csv", "Zone  A 66_11kV", " 1.5 "), ("Y_long.csv", "Kvarn", "NaN"), ("Z FY2023.csv", "66kV", "1,5")],
        "f string, s string, n string",
    )
    got = df.select(
        text.station_from_file_name("f").alias("f"), text.strip_voltage_tag("s").alias("s"), numbers.parse_number("n").alias("n")
    ).collect()
    assert [r["f"] for r in got] == ["X", "Y", "Z"]
    assert [r["s"] for r in got] == ["Zone A", "Kvarn", "66kV"]
    assert [r["n"] for r in got] == [1.5, None, None]


def test_times_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Australia/Sydney")
    try:
        when = dt.datetime(2021, 10, 3, 2, 37, 12)  # does not exist on the wall clock there
        df = spark.createDataFrame([(when,), (dt.datetime(1969, 12, 31, 23, 59, 59, 500000),)], "ts timestamp_ntz")
        got = df.select(times.epoch_seconds("ts").alias("s"), times.floor_time("ts", 900).alias("f")).collect()
        assert got[0]["s"] == int((when - dt.datetime(1970, 1, 1)).total_seconds())
        assert got[0]["f"] == dt.datetime(2021, 10, 3, 2, 30)
        assert got[1]["s"] == -1 and got[1]["f"] == dt.datetime(1969, 12, 31, 23, 45)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_division_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (3.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(numbers.divide_or_zero(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 0.0, float("-inf"), 1.5]


TSF = (
    "# comment\n@relation x\n@attribute name string\n@attribute start date\n@attribute size numeric\n"
    "@frequency hourly\n@horizon 8\n@missing true\n@equallength false\n@data\n"
)


def test_tsf(spark, tmp_path):
    body = (
        "café€:2020-01-02 03-04-05:7:1,2.5,?,4\n"
        "b:2020-01-02 03-04-05:8:?,?\n"
        "c:2020-01-02 03-04-05:1,2\n"
        "d:2020-01-02 03-04-05:x:1\n"
        "e:2020-01-02 03-04-05:9:1,zz\n"
    )
    path = tmp_path / "a.tsf"
    path.write_bytes((TSF + body).encode("cp1252"))
    out = C.read_tsf(spark, str(path))
    assert (out.frequency, out.horizon, out.missing, out.equal_length) == ("hourly", 8, True, False)
    (row,) = out.series.collect()
    assert row["name"] == "café€" and row["start"] == dt.datetime(2020, 1, 2, 3, 4, 5) and row["size"] == 7
    assert row["series_value"] == [1.0, 2.5, None, 4.0]
    assert {r["line"][0]: r["reason"] for r in out.rejects.collect()} == {
        "b": "all values missing",
        "c": "wrong number of fields",
        "d": "bad attribute",
        "e": "bad number",
    }
    with pytest.raises(Exception, match="all values missing"):
        C.read_tsf(spark, str(path), strict=True).series.collect()
    (tmp_path / "b.tsf").write_text("@data\nx:1\n")
    with pytest.raises(ValueError, match="attribute"):
        C.read_tsf(spark, str(tmp_path / "b.tsf"))


def test_matrix_lines_keep_their_numbers_across_splits(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("".join(f"{i},{i * 2}\n" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = C.read_matrix(spark, str(path))
        assert rows.rdd.getNumPartitions() >= 1
        assert rows.count() == 4000
        assert rows.where((F.col("channel") == 0) & (F.col("value") != F.col("t"))).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id int, forecast array<double>")
    assert sinks.wide_forecast(df, 2).columns == ["id", "V1", "V2"]
    log = str(tmp_path / "log")
    for run in (0, 1):
        sinks.log_metrics(spark.createDataFrame([(0.5, 1.5)], "mse double, mae double"), {"m": "x", "run": run}, log)
    rows = {(r["run_key"], r["metric"]): r["value"] for r in sinks.read_metrics(spark, log).collect()}
    assert rows["mx_run1", "mae"] == 1.5 and len(rows) == 4


def test_roles_and_guards(spark):
    df = spark.createDataFrame([("2024-01-01", "03:00", "s", 4)], "date string, time string, my_station string, reading int")
    row = clean.resolve_roles(df).first()
    assert (row["datetime"], row["station"], row["target"]) == (dt.datetime(2024, 1, 1, 3), "s", 4.0)
    with pytest.raises(ValueError):
        clean.require_columns(df, ["target"])
    with pytest.raises(ValueError):
        clean.resolve_target(spark.createDataFrame([("a",)], "station string"))
    with pytest.raises(Exception, match="non-finite"):
        clean.require_finite(spark.createDataFrame([(float("nan"),)], "v double"), ["v"]).collect()


def small(spark):
    rows = []
    for h in range(72):
        at = START + dt.timedelta(hours=h)
        rows.append((at, "good", float(h)))
        rows.append((at, "bad", None if h % 2 else 1.0))
        rows.append((at, "late", 2.0 if 48 <= h else None))
    return spark.createDataFrame(rows, "datetime timestamp_ntz, station string, target double")


def test_filtering_matches_brute_force(spark):
    rules = curation.Rules(station_threshold=0.6, date_threshold=0.9, min_history=1, step_seconds=3600)
    out = curation.filter_readings(small(spark), rules)
    assert {r["station"] for r in out.dropped_stations.collect()} == {"late"}
    assert out.dropped_dates.count() == 0
    assert out.readings.count() == 144
    tight = curation.filter_readings(small(spark), curation.Rules(station_threshold=0.7, date_threshold=0.5))
    # With "late" kept, days 1 and 2 miss values at two of three stations.
    assert {str(r["date"]) for r in tight.dropped_dates.collect()} == {"2024-01-01", "2024-01-02"}
    assert tight.readings.count() == 72


def test_curation_end_to_end(spark, tmp_path):
    staging.use_checkpoint_dir(spark, str(tmp_path / "checkpoints"))
    rules = curation.Rules(station_threshold=0.7, date_threshold=1.0, min_history=30, step_seconds=3600, limit=4)
    out = curation.curate(small(spark), rules)
    table = out.clean
    assert {r["station"]: r["station_id"] for r in out.stations.collect()} == {"bad": 0, "good": 1}
    assert table.count() == 144 and table.where("target is null").count() == 0
    assert table.where("station = 'bad'").agg(F.sum("miss_target")).first()[0] == 36
    assert quality.filled_share(table).first()["filled_share"] == pytest.approx(36 / 144)


def test_small_side_is_measured(spark):
    df = spark.range(10)
    hinted = spark.range(100).join(staging.small_side(df, max_rows=20), "id")
    plain = spark.range(100).join(staging.small_side(df, max_rows=5), "id")
    assert "broadcast" in hinted._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in plain._jdf.queryExecution().logical().toString().lower()
    wide = spark.createDataFrame([("x" * 500,)] * 10, "s string")
    assert staging.small_side(wide, max_bytes=100).count() == 10


def test_stream_appends_each_file_once(spark, tmp_path):
    src, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_long.csv").write_text("datetime,station,target\n2024-01-01 00:00:00,a,1\nnever,a,2\n")
    ingest.append_stream(ingest.long_stream(spark, src), out, progress).awaitTermination(60)
    (tmp_path / "in" / "b_long.csv").write_text("datetime,station,target\n2024-01-05 00:00:00,a,\n")
    ingest.append_stream(ingest.long_stream(spark, src), out, progress).awaitTermination(60)
    rows = spark.read.parquet(out).orderBy("datetime").collect()
    assert [(r["datetime"].day, r["target"]) for r in rows] == [(1, 1.0), (5, None)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Australia/Sydney")
    try:
        facts = ingest.station_date_stream(ingest.long_stream(spark, src))
        q = facts.writeStream.format("memory").queryName("facts").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)
        got = spark.sql("SELECT * FROM facts").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [(str(r["date"]), r["total_points"], r["orig_missing"]) for r in got] == [("2024-01-01", 1, 0)]
