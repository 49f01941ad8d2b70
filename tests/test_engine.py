"""Golden results on small fixtures."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronofold.fql import QueryError
from chronofold.plans import engine
from chronofold.plans import observations as O
from chronofold.plans.engine import ALL, Engine
from chronofold.sources import EventStore

EVENT = "event_id string, event_type string, event_time timestamp_ntz, entities map<string,string>, experiment_id string, attrs struct<{}>"
DAY = timedelta(days=1)
T0 = datetime(2020, 1, 1)
OBS = datetime(2020, 1, 30)


@pytest.fixture(scope="module")
def six(spark):
    kinds, pressure, over = "abcdef", [1.0, 100.0, 3.0, 5.0, 200.0, -100.0], [True, True, False, True, False, True]
    rows = [(None, "", T0 + v * DAY, {"location": "a"}, None, (float(v), pressure[v - 1], v, kinds[v - 1], {"m": 1.0}, over[v - 1])) for v in range(1, 7)]
    df = spark.createDataFrame(rows, EVENT.format("temp: double, pressure: double, tempint: bigint, type: string, dict: map<string,double>, is_overcast: boolean"))
    return EventStore(df)


def one(store, text, scope=ALL, obs=OBS, **more):
    o = O.listed(store, [({"location": "a"}, obs, None)])
    (row,) = Engine(store).query(o, [text], scope, **more).collect()
    return row[0]


# Expressions and results that must be those of SURVEY section 5.
GOLDEN = [
    ("count(type) over past", 6),
    ("count(*) over past", 6),
    ("count(type) over past where type in ('a', 'b', 'c', 'd')", 4),
    ("count(type) over past where type not in ('a', 'b', 'c', 'd')", 2),
    ("count(type) over past where tempint in (1, 2, 3, 4)", 4),
    ("nth(temp, 0) over past", 1.0),
    ("nth(temp, 1) over past", 2.0),
    ("nth(temp, -1) over past", 6.0),
    ("nth(temp, -2) over past", 5.0),
    ("nth(temp, -7) over past", None),
    ("sum(temp) over past", 21.0),
    ("product(temp) over past", 720.0),
    ("min(temp) over past", 1.0),
    ("max(temp) over past", 6.0),
    ("max(type) over past", "f"),
    ("min(event_time) over past", T0 + DAY),
    ("median(temp) over past", 3.5),
    ("var(temp) over past", 3.5),
    ("stdev(temp) over past where temp = 1", 0.0),
    ("first(temp) over past", 1.0),
    ("last(temp) over past", 6.0),
    ("first(type) over past having min temp", "a"),
    ("first(type) over past having max temp", "f"),
    ("values(temp) over past", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]),
    ("values(is_overcast) over past", [1.0, 1.0, 0.0, 1.0, 0.0, 1.0]),
    ("values(temp) over past where temp > 10", None),
    ("avg_days_between(temp > 0) over past", 1.0),
    ("avg_days_between(temp > 3) over past", 1.0),
    ("avg_days_between(temp > 5) over past", None),
    ("time_of_last(temp < 3) over past", T0 + 2 * DAY),
    ("time_of_first(temp > 3) over past", T0 + 4 * DAY),
    ("argmax(pressure) over past", T0 + 5 * DAY),
    ("argmin(pressure) over past", T0 + 6 * DAY),
    ("any(temp > 5) over past", True),
    ("all(temp > 5) over past", False),
    ("all(temp > 5) over last 1 seconds", True),
    ("any(temp > 5) over last 1 seconds", False),
    ("max_consecutive_true(is_overcast) over past", 2),
    ("mode(dict.m) over past", 1.0),
    ("avg(temp > 3) over past", 0.5),
    ("last(dict) over past", {"m": 1.0}),
    ("count(*) over past group by is_overcast", {"false": 2, "true": 4}),
    ("sum(temp) over past group by dict.m", {"1": 21.0}),
    ("count(*) over past where temp > 100 group by type", {}),
    ("(sum(temp) over past) / (count(*) over past)", 3.5),
    ("sum(temp) over between date_sub(date(obs_dt), 28) to date_sub(date(obs_dt), 26)", 6.0),
    ("sum(temp) over between null to *", 21.0),
    ("count(*) over past where true or true and false", 0),
    ("sum(temp) over past where temp > avg(temp) over past", 15.0),
    ("count_x(temp) over past", QueryError),
    ("sum(nothing) over past", QueryError),
    ("sum(type) over past", QueryError),
    ("nunique(type) over past", 6),
    ("has_duplicate(dict.m) over past", True),
    ("root_mean_square(temp) over past where temp = 2", 2.0),
    ("abs_energy(temp) over past where temp < 3", 5.0),
    ("absolute_sum_of_changes(pressure) over past where temp < 4", 196.0),
]


@pytest.mark.parametrize("text,want", GOLDEN)
@pytest.mark.parametrize("scope", ["related", ALL])
def test_golden(six, text, want, scope):
    if want is QueryError:
        with pytest.raises(QueryError):
            one(six, text, scope)
    else:
        assert one(six, text, scope) == want


SUMMED = ["count(*)", "count(temp)", "sum(temp)", "product(temp)", "min(temp)", "max(type)", "avg(pressure)", "var(pressure)", "stdev(temp)", "first(type)", "last(temp)", "argmax(pressure)", "any(is_overcast)", "all(is_overcast)", "time_of_last(is_overcast)", "root_mean_square(temp)"]
LAGGED = ["has_duplicate(dict.m)", "has_duplicate_min(tempint)", "has_duplicate_max(is_overcast)", "absolute_sum_of_changes(pressure)", "avg_days_between(is_overcast)"]
INTERVALS = ["past", "future", "last 2 days", "next 1 days", "last 1 seconds", "next 36 hours", "last 90 minutes", "ytd", "wtd", "yesterday", "nextweek", "lastmonth", "samedaylastweek"]


def _both_plans(store, o, query, scope, inclusive, monkeypatch):
    near = lambda rows: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in sorted(map(tuple, rows))]
    blocked = near(Engine(store).query(o, ["obs_dt as t", *query], scope, inclusive).collect())
    monkeypatch.setattr(engine.Engine, "_summed", lambda *_: False)
    joined = near(Engine(store).query(o, ["obs_dt as t", *query], scope, inclusive).collect())
    for got, want in zip(blocked, joined):
        assert dict(zip(["t", *query], got)) == dict(zip(["t", *query], want))
    assert len(blocked) == len(joined)


TIMES = [T0 + v * DAY + timedelta(microseconds=d) for v in range(0, 8) for d in (-1, 0, 1)] + [T0 + 40 * DAY]


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("scope", ["related", ALL])
def test_blocks_equal_joins(six, inclusive, scope, monkeypatch):
    """The two plans are interchangeable, on and next to events."""
    o = O.listed(six, [({"location": "a"}, t, None) for t in TIMES])
    query = [f"{f} over {i} where pressure > -50 as c{k}" for k, (f, i) in enumerate((f, i) for a, f in enumerate(SUMMED) for b, i in enumerate(INTERVALS) if (a + b) % 6 == 0)]
    _both_plans(six, o, query, scope, inclusive, monkeypatch)


@pytest.mark.parametrize("name", LAGGED)
def test_blocks_with_the_row_before_equal_joins(six, name, monkeypatch):
    o = O.listed(six, [({"location": "a"}, t, None) for t in TIMES])
    query = [f"{name} over {i} where pressure > -50 as c{k}" for k, i in enumerate(("past", "last 3 days", "future"))]
    _both_plans(six, o, query, "related", len(name) % 2 == 0, monkeypatch)


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("scope", ["related", ALL])
def test_past_and_future_are_all(six, inclusive, scope):
    o = O.every(six, 1, "day")
    rows = Engine(six).query(o, ["(count(*) over past) + (count(*) over future)", "(count(*) over past) / (count(*) over future) as r"], scope, inclusive).collect()
    assert {r[0] for r in rows} == {6.0} and len(rows) == 7


def test_hot_entities_are_split(six, monkeypatch):
    """Joins give the same whether keys are split or not."""
    query = ["obs_dt as t", "count(*) over mtd as n", "values(type) over between null to obs_dt as v", "first(type) over ytd having max pressure as m", "count(*) over mtd group by is_overcast as g"]
    o = O.every(six, 1, "day")
    want = sorted(map(str, Engine(six).query(o, query).collect()))
    monkeypatch.setattr(engine, "HOT_ROWS", 2)
    assert sorted(map(str, Engine(six).query(o, query).collect())) == want


def test_experiments_and_globals(spark):
    rows = [(str(i), t, datetime(2020, 1, i), {"": e}, x, (p,)) for i, t, e, x, p in ((1, "test", "a", None, 100.0), (2, "test2", "a", None, 200.0), (3, "test", "a", "experiment_1", 300.0), (4, "test", "b", "experiment_3", 400.0), (5, "test", "b", "experiment_3", 500.0))]
    store = EventStore(spark.createDataFrame(rows, EVENT.format("pressure: double")))
    o = O.fixed(store, [""], [OBS])
    for experiment, want in ((None, 100.0), ("experiment_1", 400.0), ("experiment_2", 100.0), ("experiment_3", 100.0)):
        assert [r[0] for r in Engine(store).query(o, ["sum(pressure) over past where event_type = 'test'"], experiment_id=experiment).collect()] == [want]
    assert store.flush("experiment_3").count() == 3 and store.flush(experiments=True).count() == 2 and store.flush().count() == 0
    rows = [("1", "test", datetime(2020, 1, 1), None, None, (1000.0,)), ("2", "test", datetime(2020, 1, 2), {"entity_type_a": "ent1"}, None, (200.0,)), ("3", "test", datetime(2020, 1, 3), {"entity_type_a": "ent2"}, None, (300.0,))]
    store = EventStore(spark.createDataFrame(rows, EVENT.format("pressure: double")))
    o = O.fixed(store, ["entity_type_a"], [datetime(2020, 1, 4)])
    assert {r[0] for r in Engine(store).query(o, ["sum(pressure) over past where event_type = 'test'"]).collect()} == {1200.0, 1300.0}


def test_games(spark):
    """Several entities, context, variables and names from the observation's own event."""
    games = [("g1", 1, "x", "y", "home", 10), ("g2", 2, "y", "x", "away", 20), ("g3", 3, "x", "z", "away", 30), ("g4", 4, "z", "x", "home", 40)]
    rows = [(i, "game", datetime(2020, 1, d), {"home": h, "away": a}, None, (r, (p,))) for i, d, h, a, r, p in games]
    store = EventStore(spark.createDataFrame(rows, EVENT.format("game_result: string, home_stats: struct<points: bigint>")))
    query = """SELECT
        @again := @winner, // a comment
        obs_dt as obs_dt, @entities.home as home, @entities.away as away,
        @winner := if(game_result = "away", entities.away, entities.home),
        @again as winner
        count(*) over past where (game_result = "away" and entities.away = @entities.away) or (game_result = "home" and entities.home = @entities.away) as wins,
        count(*) over past where entities.home = @winner as winner_at_home,
        last(entities.away) over past where entities.home = @entities.home as last_away,
        avg(home_stats.points) over ytd as points,
    FOR @entities := home"""
    got = {r.obs_dt.day: r for r in Engine(store).query(O.all_events(store), query, ALL).collect()}
    assert [got[d].winner for d in (1, 2, 3, 4)] == ["x", "x", "z", "z"]
    assert [got[d].wins for d in (1, 2, 3, 4)] == [0, 1, 0, 2]
    assert [got[d].winner_at_home for d in (1, 2, 3, 4)] == [0, 1, 0, 0]
    assert [got[d].last_away for d in (1, 2, 3, 4)] == [None, None, "y", None]
    assert [got[d].points for d in (1, 2, 3, 4)] == [None, 10.0, 15.0, 20.0]
    with pytest.raises(QueryError):
        Engine(store).query(O.all_events(store), ["@a := @b", "@b := @a"])


def test_observations(six, spark):
    assert O.every(six, 10, "day").rows.count() == 2
    assert O.every(six, 2, "day").rows.count() == 4
    assert O.conditional(six, "temp > 4").rows.count() == 2
    assert O.events_by_entity(six, ["location"]).rows.count() == 0
    with_ids = EventStore(six.events.withColumn("event_id", six.events["attrs.type"]))
    assert O.all_events(with_ids).rows.count() == 6
    assert O.events_by_entity(with_ids, ["location"]).rows.count() == 6
    got = Engine(with_ids).query(O.of_events(with_ids, [({"location": "a"}, "c"), ({"location": "b"}, "e")]), ["@entities.location as l", "temp as t", "count(*) over past as n", "@type as k"]).collect()
    assert sorted(map(tuple, got)) == [("a", 3.0, 2, "c"), ("b", 5.0, 0, "e")]
    double = O.listed(with_ids, [({"location": "a"}, OBS, None)] * 2)
    assert Engine(with_ids).query(double, ["count(*) over past"]).count() == 1


def _line(spark, n):
    """One entity with n events in 13 days."""
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * F.lit(13 * 86_400_000_000 // n)).cast("timestamp_ntz")
    rows = spark.range(n).select(F.col("id").cast("string").alias("event_id"), F.lit("x").alias("event_type"), at.alias("event_time"), F.create_map(F.lit("u"), F.lit("a")).alias("entities"), F.struct(F.col("id").cast("double").alias("v")).alias("attrs"))
    return EventStore(rows, False)


@pytest.mark.parametrize("interval", ["last 14 days", "future"])
def test_time_grows_with_the_events(spark, interval):
    """An observation per event, each with all events before or after it in its interval."""
    took = {}
    for n in (1_000, 32_000, 128_000):
        store = _line(spark, n)
        began = time.time()
        (row,) = Engine(store).query(O.all_events(store), [f"sum(v) over {interval} as total", f"max(v) over {interval} as most"]).agg(F.sum("total"), F.sum("most")).collect()
        took[n] = time.time() - began
        assert row[0] == (sum(i * (n - 1 - i) for i in range(n)) if interval != "future" else sum(i * (i + 1) for i in range(n)))
    assert took[128_000] < 5 * took[32_000] + 2


def test_global_events_keep_the_block_plan(spark, monkeypatch):
    rows = [(str(i), "x", T0 + i * DAY, {} if i == 3 else {"u": "a"}, None, (float(i),)) for i in range(6)]
    store = EventStore(spark.createDataFrame(rows, EVENT.format("v: double")))
    monkeypatch.setattr(Engine, "_joins", None)
    got = Engine(store).query(O.fixed(store, ["u"], [OBS]), ["sum(v) over past", "max(v) over last 26 days", "var(v) over past"]).collect()
    assert [tuple(r) for r in got] == [(15.0, 5.0, 3.5)]
