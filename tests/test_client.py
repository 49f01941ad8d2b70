"""The client, the store's files and the stream, and interval bounds."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold import sdk
from chronofold.fql import parse_feature
from chronofold.plans import intervals
from chronofold.plans.binder import Binder
from chronofold.sources import EventStore
from chronofold.sources.store import SchemaConflict
from chronofold.streaming.append import append_stream


def _weather(spark):
    s = sdk.Session(spark)
    s.new_event(sdk.Event("2023-08-01", "reading", {"city": "Sydney"}, {"MinTemp": 10, "MaxTemp": 20.5, "nested": {"a": "x"}}, "e1"))
    s.new_json_event('{"event_type": "reading", "event_time": "2023-08-02T10:00", "entities": {"city": "Sydney"}, "attrs": {"MinTemp": 12, "forecast_data": [1, 2]}, "event_id": "e2"}')
    return s


def test_round_trip(spark):
    s = _weather(spark)
    with pytest.raises(sdk.DuplicateEvent):
        s.new_event(sdk.Event("2023-08-01", "reading", event_id="e1"))
    assert s.n_events() == 2 and s.n_entities() == 1
    assert '"MinTemp": "Num"' in s.schema() and '"nested.a": "Str"' in s.schema() and '"forecast_data": "VecNum"' in s.schema()
    got = s.query(sdk.Fixed(["2023-08-03"], ["city"]), ["obs_dt as obs_dt", "avg(MinTemp) over last 7 days", "last(forecast_data) over past as f", "first(nested.a) over past as a"])
    assert got.columns == ["obs_dt", "avg(MinTemp) over last 7 days", "f", "a"]
    assert tuple(got.first()) == (datetime(2023, 8, 3), 11.0, [1.0, 2.0], "x")
    for config in (sdk.Interval("day", 1), sdk.AllEvents(), sdk.AllEventsByEntity(["city"]), sdk.ConditionalEvents("MinTemp > 11"), sdk.EntitySpecific([({"city": "Sydney"}, datetime(2023, 8, 9), None)]), sdk.EntitiesEventSpecific([({"city": "Sydney"}, "e2")])):
        assert s.query(config, ["count(*) over past"]).count() >= 1
    s.flush()
    assert s.n_events() == 0


def test_times(spark):
    texts = ["2020-01-01T16:39:57", "2020-01-01 16:39:57", "2020-01-01 16:39", "2020-01-01T16:39", "2020-01-01", "2020-01-01 16:39:57.123456", "2020-01-01T16:39:57Z", "2020-01-01T16:39:57+01:00", "x", "2020-02-30", None]
    from chronofold.functions.scalars import parse_time

    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(parse_time(F.col("t"))).collect()]
    full, minute = datetime(2020, 1, 1, 16, 39, 57), datetime(2020, 1, 1, 16, 39)
    assert got == [full, full, minute, minute, datetime(2020, 1, 1), full.replace(microsecond=123456), None, None, None, None, None]


def test_append_and_conflict(spark, tmp_path):
    a = _weather(spark).store
    b = a.append(spark.createDataFrame([("p", "purchase", datetime(2023, 1, 1), {}, None, (5, 2))], "event_id string, event_type string, event_time timestamp_ntz, entities map<string,string>, experiment_id string, attrs struct<price: int, MinTemp: int>"))
    assert b.schema()["price"] == "Int" and b.schema()["MinTemp"] == "Num" and b.count() == 3 and b.has_global()
    with pytest.raises(SchemaConflict):
        a.append(spark.createDataFrame([("p", datetime(2023, 1, 1), ("x",))], "event_id string, event_time timestamp_ntz, attrs struct<MinTemp: string>"))
    b.write(str(tmp_path / "store"))
    again = EventStore.read(spark, str(tmp_path / "store"))
    assert again.count() == 3 and again.of_type("purchase").count() == 1 and again.by_id("e1").count() == 1
    assert "PartitionFilters: [isnotnull(event_type" in again.of_type("purchase")._jdf.queryExecution().explainString(again.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    double = EventStore(a.events.unionByName(a.events))
    assert double.unique().count() == 2
    sdk.to_csv(sdk.Session(spark, a).query(sdk.AllEvents(), ["event_id as id", "forecast_data as f"]), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["id", "f"]


def test_stream(spark, tmp_path):
    rows = [(str(i % 3), "a", datetime(2024, 1, 1) + timedelta(minutes=i % 3), {"u": "x"}, None, (float(i),)) for i in range(6)]
    shape = "event_id string, event_type string, event_time timestamp_ntz, entities map<string,string>, experiment_id string, attrs struct<v: double>"
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, shape).write.parquet(source)
    stream = spark.readStream.schema(shape).parquet(source)
    append_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), trigger_once=True).awaitTermination(120)
    assert EventStore.read(spark, str(tmp_path / "out")).count() == 3


def test_stream_keeps_late_rows(spark, tmp_path):
    """First deliveries far behind the newest event are written, and their repeats aren't, in later batches and after a restart."""
    shape = "event_id string, event_type string, event_time timestamp_ntz, entities map<string,string>, experiment_id string, attrs struct<v: double>"
    source = str(tmp_path / "in")

    def deliver(*ids_days):
        rows = [(i, "a", datetime(2024, 1, day), {"u": "x"}, None, (0.0,)) for i, day in ids_days]
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
        append_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), trigger_once=True).awaitTermination(120)
        return sorted(r.event_id or "" for r in EventStore.read(spark, str(tmp_path / "out")).events.collect())

    deliver(("a", 20))
    deliver(("c", 21))
    assert run() == ["a", "c"]
    deliver(("b", 15), (None, 2))
    deliver(("b", 15), ("a", 20), ("d", 1))
    assert run() == ["", "a", "b", "c", "d"]
    deliver(("d", 1), ("c", 21))
    assert run() == ["", "a", "b", "c", "d"]


T1 = "2023-05-17 12:00:00"
# The calendar intervals of an observation on a Wednesday, and edges of months and years.
BOUNDS = [
    ("YTD", T1, "2023-01-01 00:00:00", T1),
    ("MTD", T1, "2023-05-01 00:00:00", T1),
    ("WTD", T1, "2023-05-15 00:00:00", T1),
    ("Yesterday", T1, "2023-05-16 00:00:00", "2023-05-16 23:59:59"),
    ("LastWeek", T1, "2023-05-08 00:00:00", "2023-05-14 23:59:59"),
    ("LastMonth", T1, "2023-04-01 00:00:00", "2023-04-30 23:59:59"),
    ("LastQuarter", T1, "2023-01-01 00:00:00", "2023-03-31 23:59:59"),
    ("LastYear", T1, "2022-01-01 00:00:00", "2022-12-31 23:59:59"),
    ("SameDayLastWeek", T1, "2023-05-10 00:00:00", "2023-05-10 23:59:59"),
    ("SameDayLastMonth", T1, "2023-04-17 00:00:00", "2023-04-17 23:59:59"),
    ("SameDayLastYear", T1, "2022-05-17 00:00:00", "2022-05-17 23:59:59"),
    ("Tomorrow", T1, "2023-05-18 00:00:00", "2023-05-18 23:59:59"),
    ("NextWeek", T1, "2023-05-22 00:00:00", "2023-05-28 23:59:59"),
    ("NextMonth", T1, "2023-06-01 00:00:00", "2023-06-30 23:59:59"),
    ("NextQuarter", T1, "2023-07-01 00:00:00", "2023-09-30 23:59:59"),
    ("NextYear", T1, "2024-01-01 00:00:00", "2024-12-31 23:59:59"),
    ("SameDayNextWeek", T1, "2023-05-24 00:00:00", "2023-05-24 23:59:59"),
    ("SameDayNextMonth", T1, "2023-06-16 00:00:00", "2023-06-16 23:59:59"),
    ("SameDayNextYear", T1, "2024-05-17 00:00:00", "2024-05-17 23:59:59"),
    ("NextWorkDay", T1, "2023-05-18 00:00:00", "2023-05-18 23:59:59"),
    ("PreviousWorkDay", T1, "2023-05-16 00:00:00", "2023-05-16 23:59:59"),
    ("NextBusinessDay", "2023-05-19 08:00:00", "2023-05-22 00:00:00", "2023-05-22 23:59:59"),
    ("previous_work_day", "2023-05-21 08:00:00", "2023-05-19 00:00:00", "2023-05-19 23:59:59"),
    ("LastMonth", "2023-01-31 00:00:00", "2022-12-01 00:00:00", "2022-12-31 23:59:59"),
    ("NextMonth", "2023-12-31 00:00:00", "2024-01-01 00:00:00", "2024-01-31 23:59:59"),
    ("SameDayLastYear", "2024-02-29 05:00:00", "2023-02-28 00:00:00", "2023-02-28 23:59:59"),
    ("last 3 days", T1, "2023-05-14 12:00:00", T1),
    ("next 90 minutes", T1, T1, "2023-05-17 13:30:00"),
    ("between date_sub(date(obs_dt), 1) to obs_dt", T1, "2023-05-16 00:00:00", T1),
    ("between date(obs_dt) to date(obs_dt)", T1, "2023-05-17 00:00:00", "2023-05-17 23:59:59"),
]


@pytest.mark.parametrize("text,at,low,high", BOUNDS)
def test_bounds(spark, text, at, low, high):
    t = F.col("obs_dt")
    got = intervals.bounds(parse_feature(f"count(*) over {text}").expr.interval, F.unix_micros(t.cast("timestamp")), t, Binder(T.StructType([])).bind)
    row = spark.range(1).select(F.lit(at).cast("timestamp_ntz").alias("obs_dt")).select(*(F.timestamp_micros(x).cast("timestamp_ntz").cast("string") for x in got))
    assert tuple(row.first()) == (low, high)


def test_statistics_functions(spark):
    rows = [(str(i), "a", datetime(2024, 1, 1) + timedelta(minutes=i), {"u": "x"}, None, (v,)) for i, v in enumerate([1.0, 2.0, 4.0, 8.0, 16.0])]
    store = EventStore(spark.createDataFrame(rows, "event_id string, event_type string, event_time timestamp_ntz, entities map<string,string>, experiment_id string, attrs struct<v: double>"))
    s = sdk.Session(spark, store)
    names = ["percentile(v, 25)", "iqr(v)", "median_abs_dev(v)", "median_abs_dev_pct(v)", "stdev_pct(v)"]
    r = s.query(sdk.Fixed(["2024-01-02"], ["u"]), [f"{n} over past as c{i}" for i, n in enumerate(names)] + ["quartiles(v) over past as q"]).first()
    assert [r.c0, r.c1] == [2.0, 6.0] and r.q == [2.0, 4.0, 8.0]
    assert r.c2 == pytest.approx(3 * 1.4826) and r.c3 == pytest.approx(3 * 1.4826 / 4 * 100) and r.c4 == pytest.approx(6.0992 / 6.2 * 100, rel=1e-4)
