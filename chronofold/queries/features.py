"""Queries of the feature engine over the test tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold import sdk
from chronofold.common import table, use_utc
from chronofold.plans import observations as O
from chronofold.plans.engine import ALL, RELATED, Engine
from chronofold.sources import EventStore

DATES = ("2024-01-05 00:00:00", "2024-01-12 12:30:00", "2024-01-23 00:00:00", "2024-02-06 00:00:00")
KEYS = ["obs_dt as obs_dt", "@entities.user as user"]


def events_store(spark: SparkSession, d: str) -> EventStore:
    """The ``events`` table: entity user, attributes ``value`` and ``props.k``."""
    use_utc(spark)
    props = F.from_json("props", "struct<k: double>")
    return EventStore(
        table(spark, d, "events").select(
            F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("ts").alias("event_time"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("entities"),
            F.struct(F.col("value"), props.alias("props")).alias("attrs"),
        )
    )


def shipments_store(spark: SparkSession, d: str) -> EventStore:
    """The ``lineitem`` table: entities part and supplier."""
    use_utc(spark)
    return EventStore(
        table(spark, d, "lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"), F.lit("ship").alias("event_type"), F.col("l_shipdate").alias("event_time"),
            F.create_map(F.lit("part"), F.col("l_partkey").cast("string"), F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("entities"),
            F.struct(F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")).alias("attrs"),
        )
    )


def app_store(spark: SparkSession, d: str) -> EventStore:
    return EventStore(table(spark, d, "app_event"))


def rounded(df: DataFrame) -> DataFrame:
    """Sums may differ in their last bits by order of summation; the small addend keeps exact halves from going either way."""
    return df.select(*(F.round(F.col(c) + 1e-8, 6).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType) else F.col(c) for c in df.columns))


def on_events(spark: SparkSession, d: str, features: list[str], dates: tuple[str, ...] = DATES, inclusive: bool = False) -> DataFrame:
    store = events_store(spark, d)
    return rounded(Engine(store).query(O.fixed(store, ["user"], dates), [*KEYS, *features], RELATED, inclusive))


_EV = """with ev as (select cast(event_id as varchar) as id, event_type, ts, cast(user_id as varchar) as u, value, cast(json_extract(props, '$.k') as double) as k from events),
obs as (select u, t from (select distinct u from ev) cross join (values {dates}) d(t))"""


def _sql(select: str, on: str, dates: tuple[str, ...] = DATES, tail: str = "group by 1, 2", more: str = "") -> str:
    values = ", ".join(f"(timestamp '{x}')" for x in dates)
    return f"""{_EV.format(dates=values)}{more}
select o.t as obs_dt, o.u as "user", {select} from obs o left join ev e on e.u = o.u and {on} {tail}"""


_PAST = "e.ts < o.t"
_LAST7 = "e.ts >= o.t - interval 7 day and e.ts < o.t"
#: Aggregates over the last 7 days: key -> (feature, SQL).
_AGGREGATES = {
    "agg_count": ("count(value) over last 7 days", "count(e.value)"),
    "agg_count_all": ("count(*) over last 7 days where event_type = 'view'", "count(e.id) filter (e.event_type = 'view')"),
    "agg_sum": ("sum(value) over last 7 days", "round(sum(e.value) + 1e-8, 6)"),
    "agg_product": ("ln(product((value + 1) / 50) over last 3 days)", "round(ln(product((e.value + 1) / 50) filter (e.ts >= o.t - interval 3 day)) + 1e-8, 6)"),
    "agg_min": ("min(value) over last 7 days", "min(e.value)"),
    "agg_max": ("max(value) over last 7 days", "max(e.value)"),
    "agg_max_str": ("max(event_type) over last 7 days", "max(e.event_type)"),
    "agg_min_ts": ("min(event_time) over last 7 days", "min(e.ts)"),
    "agg_avg": ("avg(value) over last 7 days", "round(avg(e.value) + 1e-8, 6)"),
    "agg_avg_bool": ("avg(event_type = 'view') over last 7 days", "round(avg(case when e.event_type = 'view' then 1.0 when e.id is not null then 0.0 end) + 1e-8, 6)"),
    "agg_median": ("median(value) over last 7 days", "round(median(e.value) + 1e-8, 6)"),
    "agg_var": ("var(value) over last 7 days", "round(case when count(e.value) = 1 then 0 else var_samp(e.value) end + 1e-8, 6)"),
    "agg_stdev": ("stdev(value) over last 7 days", "round(case when count(e.value) = 1 then 0 else stddev_samp(e.value) end + 1e-8, 6)"),
    "agg_first": ("first(event_type) over last 7 days", "first(e.event_type order by e.ts, e.id) filter (e.id is not null)"),
    "agg_last": ("last(event_type) over last 7 days", "last(e.event_type order by e.ts, e.id) filter (e.id is not null)"),
    "agg_nth": ("nth(value, 1) over last 7 days", "list(e.value order by e.ts, e.id)[2]"),
    "agg_nth_neg": ("nth(value, -2) over last 7 days", "list(e.value order by e.ts, e.id)[-2]"),
    "agg_time_of_last": ("time_of_last(value > 50) over last 7 days", "max(e.ts) filter (e.value > 50)"),
    "agg_time_of_first": ("time_of_first(value > 50) over last 7 days", "min(e.ts) filter (e.value > 50)"),
    "agg_argmax": ("argmax(value) over last 7 days", "arg_max(e.ts, (e.value, -epoch_us(e.ts)))"),
    "agg_argmin": ("argmin(value) over last 7 days", "arg_min(e.ts, (e.value, epoch_us(e.ts)))"),
    "agg_any": ("any(value > 90) over last 7 days", "coalesce(bool_or(e.value > 90), false)"),
    "agg_all": ("all(value > 5) over last 7 days", "coalesce(bool_and(e.value > 5), true)"),
    "agg_n_unique": ("n_unique(event_type) over last 7 days", "count(distinct e.event_type)"),
    "agg_abs_energy": ("abs_energy(value) over last 7 days", "round(sum(e.value * e.value) + 1e-8, 6)"),
    "agg_root_mean_square": ("root_mean_square(value) over last 7 days", "round(sqrt(avg(e.value * e.value)) + 1e-8, 6)"),
    "agg_has_duplicate": ("has_duplicate(event_type) over last 7 days", "count(e.event_type) > count(distinct e.event_type)"),
    "agg_skewness": ("skewness(value) over past", "round((avg(pow(e.value, 3)) - 3 * avg(e.value) * avg(pow(e.value, 2)) + 2 * pow(avg(e.value), 3)) / nullif(pow(stddev_pop(e.value), 3), 0) + 1e-8, 6)"),
    "agg_kurtosis": ("kurtosis(value) over past", "round((avg(pow(e.value, 4)) - 4 * avg(e.value) * avg(pow(e.value, 3)) + 6 * pow(avg(e.value), 2) * avg(pow(e.value, 2)) - 3 * pow(avg(e.value), 4)) / nullif(pow(var_pop(e.value), 2), 0) - 3 + 1e-8, 6)"),
    "agg_has_duplicate_min": ("has_duplicate_min(props.k) over past", "coalesce((select count(*) > 1 from ev x where x.u = o.u and x.ts < o.t and x.k = min(e.k)), false)"),
    "agg_has_duplicate_max": ("has_duplicate_max(props.k) over past", "coalesce((select count(*) > 1 from ev x where x.u = o.u and x.ts < o.t and x.k = max(e.k)), false)"),
    "agg_stdev_pct": ("stdev_pct(value) over last 7 days", "round(case when count(e.value) = 1 then 0 else stddev_samp(e.value) / avg(e.value) * 100 end + 1e-8, 6)"),
    "agg_median_abs_dev": ("median_abs_dev(value) over last 7 days", "round(mad(e.value) * 1.4826 + 1e-8, 6)"),
    "agg_iqr": ("iqr(value) over last 7 days", "round(quantile_cont(e.value, 0.75) - quantile_cont(e.value, 0.25) + 1e-8, 6)"),
    "agg_percentile": ("percentile(value, 90) over last 7 days", "round(quantile_cont(e.value, 0.9) + 1e-8, 6)"),
    "agg_median_abs_dev_pct": ("median_abs_dev_pct(value) over last 7 days", "round(mad(e.value) * 1.4826 / median(e.value) * 100 + 1e-8, 6)"),
    "agg_approx_median": ("approx_median(value) over last 7 days", "quantile_disc(e.value, 0.5)"),
    "bool_in": ("count(*) over last 7 days where (value > 50) in (true)", "count(e.id) filter (e.value > 50)"),
    "interval_case": ("count(*) over LAST 7 Days", "count(e.id)"),
    "agg_product_null": ("product(if(value > 95, 1.5, null)) over past", "round(product(case when e.value > 95 then 1.5 end) + 1e-8, 6)"),
    "where_null_contract": ("count(*) over last 7 days where if(value > 50, value, null) != 60", "count(e.id) filter (e.value <> 60)"),
    "where_in": ("count(*) over past where event_type in ('view', 'click') and props.k not in (1, 2, 3)", "count(e.id) filter (e.event_type in ('view', 'click') and e.k not in (1, 2, 3))"),
    "from_type": ("sum(value) over past from purchase", "round(sum(e.value) filter (e.event_type = 'purchase') + 1e-8, 6)"),
    "bool_prec": ("count(*) over past where event_type = 'view' or event_type = 'click' and value > 50", "count(e.id) filter ((e.event_type = 'view' or e.event_type = 'click') and e.value > 50)"),
    "agg_ratio": ("(count(*) over past where event_type = 'view') / (count(*) over past)", "case when count(e.id) > 0 then round(count(e.id) filter (e.event_type = 'view') / count(e.id) + 1e-8, 6) else cast('nan' as double) end"),
    "entity_attr": ("last(entities.user) over past", "max(e.u)"),
    "context_entities": ("count(*) over past where entities.user = @entities.user", "count(e.id)"),
    "context_obs_dt": ("count(*) over past where date_diff(obs_dt, event_time) > 3", "count(e.id) filter (cast(o.t as date) - cast(e.ts as date) > 3)"),
    "nested_aggregate": ("count(*) over past where value > avg(value) over past", "count(e.id) filter (e.value > (select avg(x.value) from ev x where x.u = o.u and x.ts < o.t))"),
}
_NARROW = {"agg_skewness", "agg_kurtosis", "agg_has_duplicate_min", "agg_has_duplicate_max", "agg_product_null", "where_in", "from_type", "bool_prec", "agg_ratio", "entity_attr", "context_entities", "context_obs_dt", "nested_aggregate"}

#: Interval forms: keyword -> (query text, low, high) of an observation time t; calendar ends are 23:59:59 exclusive.
_D = "date_trunc('day', o.t)"


def _cal(low: str, last_day: str) -> str:
    return f"e.ts >= {low} and e.ts < {last_day} + interval '86399' second"


def _trunc(unit: str) -> str:
    return f"date_trunc('{unit}', o.t)"


def _day(n: int) -> str:
    return _cal(f"{_D} + interval ({n}) day", f"{_D} + interval ({n}) day")


def _period(unit: str, step: str, back: bool) -> str:
    first = f"{_trunc(unit)} {'-' if back else '+'} interval {step}"
    return _cal(first, f"{first} + interval {step} - interval 1 day")


_INTERVALS = {
    "past": ("past", _PAST),
    "future": ("future", "e.ts >= o.t"),
    "last": ("last 36 hours", "e.ts >= o.t - interval 36 hour and e.ts < o.t"),
    "previous": ("previous 2 weeks", "e.ts >= o.t - interval 14 day and e.ts < o.t"),
    "next": ("next 10 days", "e.ts >= o.t and e.ts < o.t + interval 10 day"),
    "past_n": ("past 90 minutes", "e.ts >= o.t - interval 90 minute and e.ts < o.t"),
    "future_n": ("future 100000 seconds", "e.ts >= o.t and e.ts < o.t + interval 100000 second"),
    "ytd": ("YTD", f"e.ts >= {_trunc('year')} and e.ts < o.t"),
    "mtd": ("MTD", f"e.ts >= {_trunc('month')} and e.ts < o.t"),
    "wtd": ("WTD", f"e.ts >= {_trunc('week')} and e.ts < o.t"),
    "yesterday": ("Yesterday", _day(-1)),
    "tomorrow": ("Tomorrow", _day(1)),
    "last_week": ("LastWeek", _period("week", "7 day", True)),
    "next_week": ("NextWeek", _period("week", "7 day", False)),
    "last_month": ("LastMonth", _period("month", "1 month", True)),
    "next_month": ("NextMonth", _period("month", "1 month", False)),
    "last_quarter": ("LastQuarter", _period("quarter", "3 month", True)),
    "next_quarter": ("NextQuarter", _period("quarter", "3 month", False)),
    "last_year": ("LastYear", _period("year", "1 year", True)),
    "next_year": ("NextYear", _period("year", "1 year", False)),
    "same_day_last_week": ("SameDayLastWeek", _day(-7)),
    "same_day_next_week": ("SameDayNextWeek", _day(7)),
    "same_day_last_month": ("SameDayLastMonth", _day(-30)),
    "same_day_next_month": ("SameDayNextMonth", _day(30)),
    "same_day_last_year": ("SameDayLastYear", _cal(f"{_D} - interval 1 year", f"{_D} - interval 1 year")),
    "same_day_next_year": ("SameDayNextYear", _cal(f"{_D} + interval 1 year", f"{_D} + interval 1 year")),
    "next_work_day": ("NextWorkDay", _cal(*(f"{_D} + interval (case isodow(o.t) when 5 then 3 when 6 then 2 else 1 end) day",) * 2)),
    "previous_work_day": ("PreviousWorkDay", _cal(*(f"{_D} - interval (case isodow(o.t) when 1 then 3 when 7 then 2 else 1 end) day",) * 2)),
    "between": ("between date_sub(date(obs_dt), 9) to date_sub(date(obs_dt), 2)", _cal(f"{_D} - interval 9 day", f"{_D} - interval 2 day")),
    "between_open": ("between null to date_add(date(obs_dt), 2)", f"e.ts < {_D} + interval 2 day + interval '86399' second"),
}
#: Observation dates from before, in and after the events' month.
INTERVAL_DATES = ("2023-01-20 10:00:00", "2023-10-05 00:00:00", "2023-12-14 08:00:00", "2024-01-09 06:30:00", "2024-01-20 23:00:00", "2024-02-05 00:00:00", "2024-02-29 12:00:00", "2024-05-01 00:00:00", "2025-01-14 09:00:00")

_RUN = """, run as (select o.u, o.t, e.id, e.ts, e.value > 30 as b,
  row_number() over (partition by o.u, o.t order by e.ts, e.id) - row_number() over (partition by o.u, o.t, e.value > 30 order by e.ts, e.id) as island
  from obs o join ev e on e.u = o.u and e.ts < o.t),
runs as (select u, t, count(*) as n from run where b group by u, t, island)"""
_GAPS = """, gaps as (select o.u, o.t, (epoch_us(e.ts) - lag(epoch_us(e.ts)) over (partition by o.u, o.t order by e.ts, e.id)) // 86400000000 as gap
  from obs o join ev e on e.u = o.u and e.ts < o.t where e.event_type = 'click')"""
_MODE = """, counts as (select o.u, o.t, e.event_type, count(*) as n from obs o join ev e on e.u = o.u and e.ts < o.t group by 1, 2, 3)"""
_CHANGES = """, steps as (select o.u, o.t, abs(e.value - lag(e.value) over (partition by o.u, o.t order by e.ts, e.id)) as step, e.value from obs o join ev e on e.u = o.u and e.ts < o.t)"""


def _own(select: str, more: str, tail: str = "") -> str:
    values = ", ".join(f"(timestamp '{x}')" for x in DATES)
    return f"{_EV.format(dates=values)}{more} select o.t as obs_dt, o.u as \"user\", {select} from obs o {tail}"


_SPECIAL: dict[str, tuple[str, str]] = {
    "agg_max_consecutive_true": ("max_consecutive_true(value > 30) over past", _own("coalesce((select max(n) from runs r where r.u = o.u and r.t = o.t), 0) as x", _RUN)),
    "agg_avg_days_between": ("avg_days_between(event_type = 'click') over past", _own("round((select avg(gap) from gaps g where g.u = o.u and g.t = o.t) + 1e-8, 6) as x", _GAPS)),
    "agg_mode": ("mode(event_type) over past", _own("(select first(event_type order by n desc, event_type) from counts c where c.u = o.u and c.t = o.t) as x", _MODE)),
    "agg_absolute_sum_of_changes": ("absolute_sum_of_changes(value) over past", _own("(select round(coalesce(sum(step), 0) + 1e-8, 6) from steps s where s.u = o.u and s.t = o.t having count(s.value) > 0) as x", _CHANGES)),
    "agg_time_of_next": ("time_of_next(event_type = 'purchase') over future", _sql("min(e.ts) filter (e.event_type = 'purchase') as x", "e.ts >= o.t")),
    "having_max": ("first(event_type) over past having max value", _sql("arg_max(e.event_type, (e.value, -epoch_us(e.ts))) as x", _PAST)),
    "having_min": ("last(event_type) over last 7 days where event_type != 'view' having min value", _sql("arg_min(e.event_type, (e.value, -epoch_us(e.ts))) filter (e.event_type <> 'view') as x", _LAST7)),
}


def agg_values(spark: SparkSession, d: str) -> DataFrame:
    return on_events(spark, d, ["values(event_type) over last 7 days as x"]).withColumn("x", F.array_join("x", ","))


def agg_quartiles(spark: SparkSession, d: str) -> DataFrame:
    rows = on_events(spark, d, ["quartiles(value) over last 7 days as x"])
    return rounded(rows.select("obs_dt", "user", *(F.try_element_at("x", F.lit(i)).alias(f"q{i}") for i in (1, 2, 3))))


def agg_winsorize(spark: SparkSession, d: str) -> DataFrame:
    rows = on_events(spark, d, ["winsorize(value, 10) over last 7 days as x"])
    return rounded(rows.select("obs_dt", "user", F.size("x").alias("n"), F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("total"), F.array_max("x").alias("most")))


def agg_last_map(spark: SparkSession, d: str) -> DataFrame:
    """A map as value; its keys for comparison."""
    store = app_store(spark, d)
    rows = Engine(store).query(O.fixed(store, ["user"], ["2024-04-01 00:00:00"]), ["@entities.user as user", "last(view_stats) over last 30 days as x"])
    return rows.withColumn("x", F.array_join(F.array_sort(F.map_keys("x")), ","))


def scope_list(spark: SparkSession, d: str) -> DataFrame:
    """Observations of a part and a supplier whose events are found by the supplier alone."""
    store = shipments_store(spark, d)
    obs = O.conditional(store, "quantity = 50")
    query = ["event_id as event_id", "count(*) over past as n", "sum(quantity) over last 90 days where flag = 'R' as returned", "median(quantity) over last 30 days as middle"]
    return rounded(Engine(store).query(obs, query, related=["supplier"]))


def interval_offset(spark: SparkSession, d: str) -> DataFrame:
    return on_events(spark, d, ['count(*) over between "2024-01-05" to "2024-01-11" as n', 'sum(value) over between "2024-01-05" to "2024-01-11" as total'])


def interval_since(spark: SparkSession, d: str) -> DataFrame:
    """Since the last event of a kind; without one, all of the past."""
    return on_events(spark, d, ["count(*) over since event_type = 'purchase' as n", "sum(value) over since event_type = 'purchase' where event_type = 'view' as total"])


def interval_sessions(spark: SparkSession, d: str) -> DataFrame:
    return on_events(spark, d, ["count(*) over last 1 session of 12 hours as n", "sum(value) over last 3 sessions of 12 hours as total"])


def new_event(spark: SparkSession, d: str) -> DataFrame:
    """Events given one by one; a feature without alias is named by its text."""
    session = sdk.Session(spark)
    for r in table(spark, d, "nation").orderBy("n_nationkey").toLocalIterator():
        at = datetime(2024, 1, 1) + timedelta(days=r.n_nationkey)
        session.new_event(sdk.Event(at, "founded", {"region": str(r.n_regionkey)}, {"size": float(r.n_nationkey)}, r.n_name))
    return session.query(sdk.Fixed(["2024-01-15 00:00:00"], ["region"]), ["@entities.region as region", "count(*) over past", "sum(size) over future"], config=sdk.QueryConfig(parallel=False))


def obs_interval_units(spark: SparkSession, d: str) -> DataFrame:
    store, out = events_store(spark, d), None
    for n, unit in ((36, "hour"), (2, "week"), (5000, "minute"), (400_000, "second"), (700_000_000, "millisecond")):
        own = Engine(store).query(O.every(store, n, unit, ["user"]), [*KEYS, "count(*) over last 36 hours as n"]).withColumn("unit", F.lit(unit))
        out = own if out is None else out.unionByName(own)
    return out


def group_by_map(spark: SparkSession, d: str) -> DataFrame:
    """A map in one cell, as text for comparison."""
    return on_events(spark, d, ["count(*) over past group by event_type as x"]).withColumn("x", F.array_join(F.transform(F.array_sort(F.map_entries("x")), lambda e: F.concat_ws(":", e["key"], e["value"])), ","))


def group_by_number(spark: SparkSession, d: str) -> DataFrame:
    return on_events(spark, d, ["count(*) over past where props.k < 4 group by props.k as x"]).withColumn("x", F.array_join(F.transform(F.array_sort(F.map_entries("x")), lambda e: F.concat_ws(":", e["key"], e["value"])), ","))


def intervals_all(spark: SparkSession, d: str, name: str) -> DataFrame:
    return on_events(spark, d, [f"count(*) over {_INTERVALS[name][0]} as n", f"sum(value) over {_INTERVALS[name][0]} as total"], INTERVAL_DATES)


def include_obs_date(spark: SparkSession, d: str, inclusive: bool) -> DataFrame:
    """Observations at the times of events themselves."""
    store = events_store(spark, d)
    obs = O.all_events(store)
    return rounded(Engine(store).query(obs, ["event_id as event_id", "@entities.user as user", "count(*) over past as n", "count(*) over future as later", "sum(value) over last 2 days as total"], RELATED, inclusive))


def rolling_frames(spark: SparkSession, d: str) -> DataFrame:
    """Many aggregates in one frame plan."""
    return on_events(spark, d, ["count(*) over last 3 days as n3", "avg(value) over last 7 days as avg7", "max(value) over last 14 days as max14", "min(value) over last 30 days as min30", "sum(value) over past as total", "last(value) over past as newest", "first(value) over future as upcoming"])


def variables(spark: SparkSession, d: str) -> DataFrame:
    store = events_store(spark, d)
    query = """SELECT obs_dt as obs_dt, @entities.user as user,
      @above := @mean + 10, // defined before what it needs
      @mean := avg(value) over past,
      round(@above) as above,
      count(*) over past where value > @above as n_above,
    FOR @entities := user"""
    return rounded(Engine(store).query(O.fixed(store, ["user"], DATES), query))


def select_query(spark: SparkSession, d: str) -> DataFrame:
    store = events_store(spark, d)
    query = "SELECT obs_dt as obs_dt @entities.user as user, count(*) over past where event_type = 'purchase' as n, FOR @entities := user,"
    return rounded(Engine(store).query(O.fixed(store, ["user"], DATES), query))


def context_event(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of the observation's own event, at the top and inside an aggregate."""
    store = events_store(spark, d)
    obs = O.conditional(store, "event_type = 'purchase'")
    return rounded(Engine(store).query(obs, ["event_id as event_id", "value as own", "event_type as kind", "count(*) over last 10 days where value > @value as larger"]))


def obs_interval(spark: SparkSession, d: str) -> DataFrame:
    store = events_store(spark, d)
    return rounded(Engine(store).query(O.every(store, 7, "day", ["user"]), [*KEYS, "count(*) over last 7 days as n", "avg(value) over last 7 days as mean"]))


def obs_fixed(spark: SparkSession, d: str) -> DataFrame:
    return on_events(spark, d, ["count(*) over past as n"])


def obs_specific(spark: SparkSession, d: str) -> DataFrame:
    store = events_store(spark, d)
    rows = [({"user": str(u)}, datetime(2024, 1, day), None) for u in (1, 2, 3, 999999) for day in (10, 20)]
    return rounded(Engine(store).query(O.listed(store, rows), [*KEYS, "count(*) over past as n"]))


def obs_all_events(spark: SparkSession, d: str) -> DataFrame:
    store = events_store(spark, d)
    return rounded(Engine(store).query(O.all_events(store), ["event_id as event_id", *KEYS, "count(*) over last 5 days as n", "sum(value) over last 5 days as total"]))


def obs_by_entity(spark: SparkSession, d: str) -> DataFrame:
    """Two entities: only events of both are an observation's."""
    store = shipments_store(spark, d)
    return rounded(Engine(store).query(O.events_by_entity(store, ["supplier", "part"]), ["obs_dt as obs_dt", "@entities.part as part", "@entities.supplier as supplier", "count(*) over past as n", "sum(quantity) over past where flag = 'R' as returned"]))


def obs_conditional(spark: SparkSession, d: str) -> DataFrame:
    store = events_store(spark, d)
    return rounded(Engine(store).query(O.conditional(store, "event_type = 'error' and value > 50"), ["event_id as event_id", *KEYS, "count(*) over last 5 days where event_type = 'error' as n"]))


def obs_event_specific(spark: SparkSession, d: str) -> DataFrame:
    store = events_store(spark, d)
    want = store.events.filter("event_type = 'signup'").select("entities", "event_id")
    return rounded(Engine(store).query(O.of_events(store, want), ["event_id as event_id", *KEYS, "count(*) over future as n"]))


def all_scope_link(spark: SparkSession, d: str) -> DataFrame:
    """All events, linked to the observation by an equality of entities."""
    store = shipments_store(spark, d)
    obs = O.fixed(store, ["supplier"], ["1996-06-01 00:00:00", "1998-01-01 00:00:00"])
    return rounded(Engine(store).query(obs, ["obs_dt as obs_dt", "@entities.supplier as supplier", "sum(quantity) over past where entities.supplier = @entities.supplier and flag = 'A' as total"], ALL))


def all_scope_time(spark: SparkSession, d: str) -> DataFrame:
    """All events, linked by time alone."""
    store = events_store(spark, d)
    obs = O.listed(store, [({"user": "1"}, t, None) for t in _times()])
    return rounded(Engine(store).query(obs, ["obs_dt as obs_dt", "count(*) over last 6 hours as n", "max(value) over last 6 hours as most"], ALL))


def _times() -> list[datetime]:
    return [datetime(2024, 1, 2) + timedelta(hours=13 * i) for i in range(40)]


def experiment_scope(spark: SparkSession, d: str) -> DataFrame:
    store = app_store(spark, d)
    out = None
    for experiment in (None, "experiment_1", "experiment_5"):
        own = Engine(store).query(O.fixed(store, ["user"], ["2024-04-01 00:00:00"]), ["@entities.user as user", "count(*) over past as n", "count(*) over last 30 days from ViewEvent as views"], experiment_id=experiment)
        own = own.withColumn("experiment", F.lit(experiment or "none"))
        out = own if out is None else out.unionByName(own)
    return out


def global_events(spark: SparkSession, d: str) -> DataFrame:
    """The events of one type are made global: every user sees them."""
    store = events_store(spark, d)
    empty = F.create_map().cast("map<string,string>")
    store = EventStore(store.events.withColumn("entities", F.when(F.col("event_type") == "signup", empty).otherwise(F.col("entities"))))
    return rounded(Engine(store).query(O.fixed(store, ["user"], DATES[:2]), [*KEYS, "count(*) over past as n", "count(*) over past from signup as signups", "max(value) over last 2 days as most"]))


def weather_features(spark: SparkSession, d: str) -> DataFrame:
    """The published weather query of 19 features over the readings table, weekly per city. Readings lack some of its columns; in their stead stand gusts and
    evaporation for the wind speeds of morning and afternoon, sunshine and humidity for the clouds, and the day's maximum and minimum for the
    temperatures of afternoon and morning (humidity where that would be asked twice)."""
    use_utc(spark)
    store = EventStore(table(spark, d, "reading").withColumnRenamed("reading_id", "event_id"), has_global=False)
    texts = [f"{agg} over {span}{where} as {name}" for name, (agg, span, where) in WEATHER.items()]
    return rounded(Engine(store).query(O.every(store, 7, "day", ["city"]), ["obs_dt as obs_dt", "@entities.city as city", *texts]))


WEATHER = {
    "avg_max_temp": ("avg(max_temp)", "last 7 days", ""),
    "min_min_temp": ("min(min_temp)", "last 7 days", ""),
    "max_gust": ("max(wind_gust_speed)", "last 3 days", ""),
    "last_humidity": ("last(humidity_3pm)", "past", ""),
    "first_humidity": ("first(humidity_9am)", "future", ""),
    "sum_rain": ("sum(rainfall)", "last 30 days", ""),
    "avg_wind_9am": ("avg(wind_gust_speed)", "last 5 days", ""),
    "avg_wind_3pm": ("avg(evaporation)", "last 5 days", ""),
    "last_temp_3pm": ("last(max_temp)", "last 3 days", ""),
    "first_temp_9am": ("first(min_temp)", "last 3 days", ""),
    "rainy_days": ("count(*)", "last 30 days", " where rain_today = 'Yes'"),
    "dry_days": ("count(*)", "last 30 days", " where rain_today = 'No'"),
    "avg_cloud_9am": ("avg(sunshine)", "last 7 days", ""),
    "avg_cloud_3pm": ("avg(humidity_3pm)", "last 7 days", ""),
    "sum_pressure": ("sum(pressure_9am)", "last 3 days", ""),
    "sum_pressure_3pm": ("sum(pressure_3pm)", "last 3 days", ""),
    "last_gust_dir": ("last(wind_gust_dir)", "past", ""),
    "max_temp_3pm": ("max(max_temp)", "last 7 days", ""),
    "min_temp_9am": ("min(humidity_9am)", "last 7 days", ""),
}


def _weather_sql() -> str:
    cols = []
    for name, (agg, span, where) in WEATHER.items():
        f, x = agg[:-1].split("(")
        on = "ts >= o.t" if span == "future" else "ts < o.t" + (f" and ts >= o.t - interval {span.split()[1]} day" if span != "past" else "")
        if f in ("first", "last"):
            cols.append(f"arg_{'min' if f == 'first' else 'max'}({x}, (ts, cast(id as varchar))) filter ({on} and {x} is not null) as {name}")
        elif f in ("avg", "sum"):
            cols.append(f"round({f}({x}) filter ({on}) + 1e-8, 6) as {name}")
        else:
            cols.append(f"{agg} filter ({on}{where.replace(' where', ' and')}) as {name}")
    return f"""with r as (select reading_id as id, event_time as ts, entities['city'] as city, attrs.* from reading),
spans as (select city, min(ts) - interval 1 millisecond as lo, max(ts) + interval 1 millisecond as hi from r group by 1),
o as (select city, unnest(list_distinct(list_append(generate_series(lo, hi, interval 7 day), hi))) as t from spans)
select o.t as obs_dt, o.city, {", ".join(cols)} from o left join r e on e.city = o.city group by 1, 2"""


#: The shape of the published benchmark: name -> (aggregate, SQL of its value, days back, condition).
WEEKLY = {
    "avg_value_7": ("avg(value)", "avg(e.value)", 7, None),
    "min_value_7": ("min(value)", "min(e.value)", 7, None),
    "max_value_3": ("max(value)", "max(e.value)", 3, None),
    "sum_value_30": ("sum(value)", "sum(e.value)", 30, None),
    "avg_k_5": ("avg(props.k)", "avg(e.k)", 5, None),
    "max_k_5": ("max(props.k)", "max(e.k)", 5, None),
    "last_k_3": ("last(props.k)", "arg_max(e.k, e.ts)", 3, None),
    "first_k_3": ("first(props.k)", "arg_min(e.k, e.ts)", 3, None),
    "views_30": ("count(*)", "count(e.id)", 30, "view"),
    "clicks_30": ("count(*)", "count(e.id)", 30, "click"),
    "avg_k_7": ("avg(props.k)", "avg(e.k)", 7, None),
    "avg_value_14": ("avg(value)", "avg(e.value)", 14, None),
    "sum_value_3": ("sum(value)", "sum(e.value)", 3, None),
    "sum_k_3": ("sum(props.k)", "sum(e.k)", 3, None),
    "max_value_7": ("max(value)", "max(e.value)", 7, None),
    "min_k_7": ("min(props.k)", "min(e.k)", 7, None),
    "errors_14": ("count(*)", "count(e.id)", 14, "error"),
    "spent_30": ("sum(value)", "sum(e.value)", 30, "purchase"),
    "last_value": ("last(value)", "arg_max(e.value, e.ts)", None, None),
    "last_type": ("last(event_type)", "arg_max(e.event_type, e.ts)", None, None),
}


def weekly_features(spark: SparkSession, d: str) -> DataFrame:
    """Twenty features over windows of 3 to 30 days, weekly per user."""
    store = events_store(spark, d)
    texts = []
    for name, (agg, _, days, kind) in WEEKLY.items():
        where = f" where event_type = '{kind}'" if kind else ""
        texts.append(f"{agg} over {f'last {days} days' if days else 'past'}{where} as {name}")
    return rounded(Engine(store).query(O.every(store, 7, "day", ["user"]), [*KEYS, *texts]))


def _weekly_sql(head: str, grid: str) -> str:
    cols = []
    for name, (_, agg, days, kind) in WEEKLY.items():
        tests = ["e.ts < o.t", *([f"e.ts >= o.t - interval {days} day"] if days else []), *([f"e.event_type = '{kind}'"] if kind else [])]
        value = f"{agg} filter ({' and '.join(tests)})"
        cols.append(f"{value} as {name}" if agg.startswith("count") or "type" in agg else f"round({value} + 1e-8, 6) as {name}")
    return f"{head}{grid} select o.t as obs_dt, o.u as \"user\", {', '.join(cols)} from points o left join ev e on e.u = o.u and e.ts < o.t group by 1, 2"


def scan_all(spark: SparkSession, d: str) -> DataFrame:
    return events_store(spark, d).sorted().select("event_id", "event_type", "event_time", F.col("entities")["user"].alias("user"), "attrs.value", F.col("attrs.props.k").alias("k"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    return app_store(spark, d).entities()


def schema(spark: SparkSession, d: str) -> DataFrame:
    return events_store(spark, d).schema_by_type()


def ingest_json(spark: SparkSession, d: str) -> DataFrame:
    """A round trip through JSON lines, with the attributes' types inferred."""
    lines = events_store(spark, d).as_json()
    store = EventStore.from_json(lines)
    return store.events.select("event_id", "event_type", "event_time", F.col("entities")["user"].alias("user"), "attrs.value", F.col("attrs.props.k").alias("k"))


def append_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of different attributes in one store."""
    use_utc(spark)
    orders = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("event_id"), F.lit("order").alias("event_type"), F.col("o_orderdate").alias("event_time"), F.create_map(F.lit("customer"), F.col("o_custkey").cast("string")).alias("entities"), F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")).alias("attrs"))
    store = events_store(spark, d).append(orders)
    return rounded(store.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("attrs.price").alias("price"), F.sum("attrs.value").alias("value"), F.count("attrs.status").alias("statuses")))


def store_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events and entities by experiment, and what is left when experiments are flushed."""
    store = app_store(spark, d)
    events = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    parts = {"events": events(store.events), "entities": events(store.entities()), "with_experiment_1": events(store.visible("experiment_1")), "flushed": events(store.flush(experiments=True).events), "without_experiment_1": events(store.flush("experiment_1").events)}
    out = None
    for name, df in parts.items():
        own = df.withColumn("what", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def unique_events(spark: SparkSession, d: str) -> DataFrame:
    """One event per id."""
    return app_store(spark, d).unique().events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("event_id").alias("ids"))


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return events_store(spark, d).by_id("77").select("event_id", "event_type", "event_time", "attrs.value")


def type_scan(spark: SparkSession, d: str) -> DataFrame:
    return events_store(spark, d).of_type("error").select("event_id", "event_time", "attrs.value")


def interval_scan(spark: SparkSession, d: str) -> DataFrame:
    return events_store(spark, d).between("2024-01-10 00:00:00", "2024-01-12 00:00:00").select("event_id", "event_type", "event_time")


def entity_scan(spark: SparkSession, d: str) -> DataFrame:
    return shipments_store(spark, d).of_entity({"supplier": "3"}).select("event_id", F.col("entities")["part"].alias("part"), "attrs.quantity")


_REGULAR: dict[str, Callable] = {
    f.__name__: f
    for f in (
        agg_quartiles, agg_winsorize, agg_last_map, scope_list, interval_offset, interval_since, interval_sessions, new_event, obs_interval_units, agg_values, group_by_map, group_by_number, rolling_frames, variables, select_query, context_event, obs_interval, obs_fixed, obs_specific, obs_all_events, obs_by_entity, obs_conditional, obs_event_specific,
        all_scope_link, all_scope_time, experiment_scope, global_events, weather_features, weekly_features, scan_all, entities, schema, ingest_json, append_events, interval_scan, entity_scan, store_counts, unique_events, point_lookup, type_scan,
    )
}


def _single(spark: SparkSession, d: str, text: str) -> DataFrame:
    return on_events(spark, d, [f"{text} as x"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: partial(_single, text=t) for k, (t, _) in (_AGGREGATES | _SPECIAL).items()}
    out |= {f"interval_{k}": partial(intervals_all, name=k) for k in _INTERVALS}
    out |= {"include_obs_date": partial(include_obs_date, inclusive=True), "exclude_obs_date": partial(include_obs_date, inclusive=False)}
    return out | _REGULAR


def _at_events(inclusive: bool) -> str:
    lo, hi, later = (">", "<=", ">") if inclusive else (">=", "<", ">=")
    return f"""{_EV.format(dates="(timestamp '2024-01-01')")}
select o.id as event_id, o.u as "user", count(e.id) filter (e.ts {hi} o.ts) as n, count(e.id) filter (e.ts {later} o.ts) as later,
  round(sum(e.value) filter (e.ts {lo} o.ts - interval 2 day and e.ts {hi} o.ts) + 1e-8, 6) as total from ev o left join ev e on e.u = o.u group by 1, 2"""


_EVENT_OBS = """select o.id as event_id, o.ts as obs_dt, o.u as "user", {select} from ev o left join ev e on e.u = o.u and {on} where {where} group by 1, 2, 3"""


def oracle_sql() -> dict[str, str]:
    head = _EV.format(dates="(timestamp '2024-01-01')")
    out = {k: _sql(f"{s} as x", _PAST if k in _NARROW else _LAST7) for k, (_, s) in _AGGREGATES.items()}
    out |= {k: s for k, (_, s) in _SPECIAL.items()}
    out |= {f"interval_{k}": _sql("count(e.id) as n, round(sum(e.value) + 1e-8, 6) as total", on, INTERVAL_DATES) for k, (_, on) in _INTERVALS.items()}
    out |= {"include_obs_date": _at_events(True), "exclude_obs_date": _at_events(False)}
    out["agg_values"] = _sql("string_agg(e.event_type, ',' order by e.ts, e.id) as x", _LAST7)
    counts = ", counts as (select o.u, o.t, {key} as g, count(*) as n from obs o join ev e on e.u = o.u and e.ts < o.t {where} group by 1, 2, 3)"
    text = "coalesce((select string_agg(g || ':' || n, ',' order by g) from counts c where c.u = o.u and c.t = o.t), '') as x"
    out["group_by_map"] = _own(text, counts.format(key="e.event_type", where=""))
    out["group_by_number"] = _own(text, counts.format(key="cast(cast(e.k as bigint) as varchar)", where="where e.k < 4"))
    seven = "e.ts >= o.t - interval {} day and e.ts < o.t"
    out["rolling_frames"] = _sql(
        ", ".join((f"count(e.id) filter ({seven.format(3)}) as n3", f"round(avg(e.value) filter ({seven.format(7)}) + 1e-8, 6) as avg7", f"max(e.value) filter ({seven.format(14)}) as max14", f"min(e.value) filter ({seven.format(30)}) as min30", "round(sum(e.value) filter (e.ts < o.t) + 1e-8, 6) as total", "arg_max(e.value, e.ts) filter (e.ts < o.t) as newest", "arg_min(e.value, e.ts) filter (e.ts >= o.t) as upcoming")),
        "true",
    )
    out["variables"] = _own("round(m.above) as above, count(e.id) as n_above", ", means as (select o.u, o.t, avg(e.value) + 10 as above from obs o left join ev e on e.u = o.u and e.ts < o.t group by 1, 2)", "join means m on m.u = o.u and m.t = o.t left join ev e on e.u = o.u and e.ts < o.t and e.value > m.above group by 1, 2, 3")
    out["select_query"] = _sql("count(e.id) filter (e.event_type = 'purchase') as n", _PAST)
    out["context_event"] = f"{head} select o.id as event_id, round(o.value + 1e-8, 6) as own, o.event_type as kind, count(e.id) as larger from ev o left join ev e on e.u = o.u and e.ts >= o.ts - interval 10 day and e.ts < o.ts and e.value > o.value where o.event_type = 'purchase' group by 1, 2, 3"
    grid = """, spans as (select u, min(ts) - interval 1 millisecond as lo, max(ts) + interval 1 millisecond as hi from ev group by 1),
points as (select u, unnest(list_distinct(list_append(generate_series(lo, hi, interval 7 day), hi))) as t from spans)"""
    out["obs_interval"] = f"{head}{grid} select o.t as obs_dt, o.u as \"user\", count(e.id) as n, round(avg(e.value) + 1e-8, 6) as mean from points o left join ev e on e.u = o.u and {_LAST7} group by 1, 2"
    out["weekly_features"] = _weekly_sql(head, grid)
    out["agg_quartiles"] = _sql(", ".join(f"round(quantile_cont(e.value, {q}) + 1e-8, 6) as q{i}" for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))), _LAST7)
    ends = f", ends as (select o.u, o.t, quantile_cont(e.value, 0.1) as lo, quantile_cont(e.value, 0.9) as hi from obs o join ev e on e.u = o.u and {_LAST7} group by 1, 2)"
    out["agg_winsorize"] = _own("case when count(e.value) > 0 then cast(count(e.value) as integer) end as n, round(sum(least(greatest(e.value, lo), hi)) + 1e-8, 6) as total, round(max(least(greatest(e.value, lo), hi)) + 1e-8, 6) as most", ends, f"left join ends x on x.u = o.u and x.t = o.t left join ev e on e.u = o.u and {_LAST7} group by 1, 2")
    out["agg_last_map"] = """with users as (select distinct entities['user'] as u from app_event where experiment_id is null and entities['user'] is not null),
e as (select u, event_id, event_time, attrs.view_stats as m from (select entities['user'] as u, * from app_event) where experiment_id is null and u is not null
  union all select u, event_id, event_time, attrs.view_stats from users cross join app_event where experiment_id is null and coalesce(cardinality(entities), 0) = 0)
select users.u as "user", array_to_string(list_sort(map_keys(arg_max(m, (event_time, coalesce(event_id, ''))))), ',') as x from users left join e on e.u = users.u and m is not null
  and event_time >= timestamp '2024-03-02' and event_time < timestamp '2024-04-01' group by 1"""
    out["scope_list"] = """select o.l_orderkey || '-' || o.l_linenumber as event_id, count(e.l_orderkey) as n,
  round(sum(e.l_quantity) filter (e.l_returnflag = 'R' and e.l_shipdate >= o.l_shipdate - interval 90 day) + 1e-8, 6) as returned,
  round(median(e.l_quantity) filter (e.l_shipdate >= o.l_shipdate - interval 30 day) + 1e-8, 6) as middle
from (select * from (select *, row_number() over (partition by l_partkey, l_suppkey, l_shipdate order by l_orderkey || '-' || l_linenumber desc) as place from lineitem where l_quantity = 50) where place = 1) o
left join lineitem e on e.l_suppkey = o.l_suppkey and e.l_shipdate < o.l_shipdate group by 1, o.l_partkey, o.l_suppkey, o.l_shipdate"""
    out["interval_offset"] = _sql("count(e.id) as n, round(sum(e.value) + 1e-8, 6) as total", "e.ts >= timestamp '2024-01-05' and e.ts < timestamp '2024-01-11 23:59:59'")
    since = ", since as (select o.u, o.t, max(e.ts) as lo from obs o left join ev e on e.u = o.u and e.ts < o.t and e.event_type = 'purchase' group by 1, 2)"
    out["interval_since"] = _own("count(e.id) as n, round(sum(e.value) filter (e.event_type = 'view') + 1e-8, 6) as total", since, "join since s on s.u = o.u and s.t = o.t left join ev e on e.u = o.u and e.ts < o.t and (lo is null or e.ts >= lo) group by 1, 2")
    starts = """, marked as (select u, ts, case when ts - lag(ts) over (partition by u order by ts) <= interval 12 hour then 0 else 1 end as begins from ev),
starts as (select u, ts from marked where begins = 1),
lows as (select o.u, o.t, list_sort(list(s.ts), 'desc') as x from obs o left join starts s on s.u = o.u and s.ts < o.t group by 1, 2)"""
    out["interval_sessions"] = _own("count(e.id) filter (e.ts >= x[1]) as n, round(sum(e.value) filter (e.ts >= x[least(3, len(x))]) + 1e-8, 6) as total", starts, "join lows l on l.u = o.u and l.t = o.t left join ev e on e.u = o.u and e.ts < o.t group by 1, 2")
    out["new_event"] = """select cast(n_regionkey as varchar) as region, count(*) filter (n_nationkey < 14) as "count(*) over past", sum(cast(n_nationkey as double)) filter (n_nationkey >= 14) as "sum(size) over future" from nation group by 1"""
    steps = " union all ".join(f"select u, unnest(list_distinct(list_append(generate_series(lo, hi, interval '{n} {unit}s'), hi))) as t, '{unit}' as unit from spans" for n, unit in ((36, "hour"), (14, "day"), (5000, "minute"), (400_000, "second"), (700_000_000, "millisecond"))).replace("'day' as unit", "'week' as unit")
    out["obs_interval_units"] = f"{head}{grid.split(chr(10))[0]} points as ({steps}) select o.t as obs_dt, o.u as \"user\", o.unit, count(e.id) as n from points o left join ev e on e.u = o.u and e.ts >= o.t - interval 36 hour and e.ts < o.t group by 1, 2, 3"
    out["obs_fixed"] = _sql("count(e.id) as n", _PAST)
    out["obs_specific"] = f"""{head}, points as (select u, t from (values ('1'), ('2'), ('3'), ('999999')) a(u) cross join (values (timestamp '2024-01-10'), (timestamp '2024-01-20')) b(t))
select o.t as obs_dt, o.u as "user", count(e.id) as n from points o left join ev e on e.u = o.u and {_PAST} group by 1, 2"""
    five = "e.ts >= o.ts - interval 5 day and e.ts < o.ts"
    out["obs_all_events"] = head + _EVENT_OBS.format(select="count(e.id) as n, round(sum(e.value) + 1e-8, 6) as total", on=five, where="true")
    out["obs_conditional"] = head + _EVENT_OBS.format(select="count(e.id) filter (e.event_type = 'error') as n", on=five, where="o.event_type = 'error' and o.value > 50")
    out["obs_event_specific"] = head + _EVENT_OBS.format(select="count(e.id) as n", on="e.ts >= o.ts", where="o.event_type = 'signup'")
    out["obs_by_entity"] = """with o as (select distinct l_partkey, l_suppkey, l_shipdate from lineitem)
select o.l_shipdate as obs_dt, cast(o.l_partkey as varchar) as part, cast(o.l_suppkey as varchar) as supplier, count(e.l_orderkey) as n, round(sum(e.l_quantity) filter (e.l_returnflag = 'R') + 1e-8, 6) as returned
from o left join lineitem e on e.l_partkey = o.l_partkey and e.l_suppkey = o.l_suppkey and e.l_shipdate < o.l_shipdate group by 1, 2, 3"""
    out["all_scope_link"] = """with o as (select s, t from (select distinct l_suppkey as s from lineitem) cross join (values (timestamp '1996-06-01'), (timestamp '1998-01-01')) d(t))
select o.t as obs_dt, cast(o.s as varchar) as supplier, round(sum(e.l_quantity) + 1e-8, 6) as total from o left join lineitem e on e.l_suppkey = o.s and e.l_returnflag = 'A' and e.l_shipdate < o.t group by 1, 2"""
    out["all_scope_time"] = f"""{head}, points as (select unnest(generate_series(timestamp '2024-01-02', timestamp '2024-01-02' + interval (13 * 39) hour, interval 13 hour)) as t)
select o.t as obs_dt, count(e.id) as n, round(max(e.value) + 1e-8, 6) as most from points o left join ev e on e.ts >= o.t - interval 6 hour and e.ts < o.t group by 1"""
    out["experiment_scope"] = """with users as (select distinct entities['user'] as u from app_event where experiment_id is null and entities['user'] is not null),
x as (select * from (values ('none'), ('experiment_1'), ('experiment_5')) v(x)),
e as (select entities['user'] as u, experiment_id, event_type, event_time from app_event where event_time < timestamp '2024-04-01' and entities['user'] is not null
  union all select u, experiment_id, event_type, event_time from users cross join app_event where event_time < timestamp '2024-04-01' and coalesce(cardinality(entities), 0) = 0)
select o.u as "user", x.x as experiment, count(e.event_time) as n, count(e.event_time) filter (e.event_type = 'ViewEvent' and e.event_time >= timestamp '2024-03-02') as views
from users o cross join x left join e on e.u = o.u and (e.experiment_id is null or e.experiment_id = x.x) group by 1, 2"""
    out["global_events"] = f"""{_EV.format(dates=", ".join(f"(timestamp '{x}')" for x in DATES[:2]))}, users as (select distinct u from ev where event_type <> 'signup'),
points as (select u.u, o.t from users u cross join (select distinct t from obs) o)
select o.t as obs_dt, o.u as "user", count(e.id) as n, count(e.id) filter (e.event_type = 'signup') as signups, round(max(e.value) filter (e.ts >= o.t - interval 2 day) + 1e-8, 6) as most
from points o left join ev e on (e.event_type = 'signup' or e.u = o.u) and e.ts < o.t group by 1, 2"""
    out["weather_features"] = _weather_sql()
    flat = """select cast(event_id as varchar) as event_id, event_type, ts as event_time, cast(user_id as varchar) as "user", value, cast(json_extract(props, '$.k') as double) as k from events"""
    out["scan_all"] = out["ingest_json"] = flat
    out["entities"] = """select distinct 'user' as entity_type, entities['user'] as entity_id from app_event where experiment_id is null and entities['user'] is not null
union all select distinct 'device', entities['device'] from app_event where experiment_id is null and entities['device'] is not null
union all select distinct 'location', entities['location'] from app_event where experiment_id is null and entities['location'] is not null"""
    out["schema"] = """select distinct event_type, unnest(['value', 'props', 'props.k']) as attr_name, unnest(['Num', 'Map', 'Num']) as attr_type from events where value is not null"""
    out["append_events"] = """select event_type, count(*) as n, cast(null as double) as price, round(sum(value) + 1e-8, 6) as value, cast(0 as bigint) as statuses from events group by 1
union all select 'order', count(*), round(sum(o_totalprice) + 1e-8, 6), null, count(o_orderstatus) from orders"""
    out["interval_scan"] = "select cast(event_id as varchar) as event_id, event_type, ts as event_time from events where ts between timestamp '2024-01-10' and timestamp '2024-01-12'"
    out["store_counts"] = f"""select 'events' as what, count(*) as n from app_event union all select 'entities', count(*) from ({out["entities"]})
union all select 'with_experiment_1', count(*) from app_event where experiment_id is null or experiment_id = 'experiment_1'
union all select 'flushed', count(*) from app_event where experiment_id is null
union all select 'without_experiment_1', count(*) from app_event where experiment_id is null or experiment_id <> 'experiment_1'"""
    out["unique_events"] = """with x as (select event_type, event_id, row_number() over (partition by event_id, case when event_id is null then row_id end order by event_time, event_type) as place from app_event)
select event_type, count(*) as n, count(event_id) as ids from x where place = 1 group by 1"""
    out["point_lookup"] = "select cast(event_id as varchar) as event_id, event_type, ts as event_time, value from events where event_id = 77"
    out["type_scan"] = "select cast(event_id as varchar) as event_id, ts as event_time, value from events where event_type = 'error'"
    out["entity_scan"] = "select l_orderkey || '-' || l_linenumber as event_id, cast(l_partkey as varchar) as part, l_quantity as quantity from lineitem where l_suppkey = 3"
    return out
