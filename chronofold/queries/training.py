"""Queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.common import counted, micros, table, use_utc
from chronofold.operators import asof, drift, entity_features, rolling, sessions, timestamps


def _app(spark: SparkSession, d: str) -> DataFrame:
    use_utc(spark)
    return table(spark, d, "app_event")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    log = drift.changes(table(spark, d, "raw_event"), table(spark, d, "event_file"))
    return log.select("feed_id", "file_id", "change_kind", "attr_path", "old_path")


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    others = ("event_type", "event_time", "entities", "experiment_id")
    return drift.consistent(table(spark, d, "raw_event"), table(spark, d, "event_file"), table(spark, d, "attribute_value_type"), absent={}, others=others)


#: Parts in which the lines of a file find its place, since a file may hold very many.
_FILE_SALTS = 8


def _time_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lines in the order of their feed's files by period, in blocks of 4,096 lines of a file; observations in that of their ids."""
    feed = table(spark, d, "feed").select("feed_id", F.col("feed_zone").alias("zone"), "day_first")
    files = table(spark, d, "event_file")
    seq = F.row_number().over(Window.partitionBy("feed_id").orderBy("period_start", "file_id"))
    place = files.dropna(subset=["feed_id", "file_id"]).select("feed_id", "file_id", seq.cast("bigint").alias("seq")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_FILE_SALTS - 1))))
    at = F.coalesce("line_no", F.col("raw_id").bitwiseAND(0x7FFFFFFF)).cast("bigint")
    lines = table(spark, d, "raw_event").select("raw_id", "feed_id", "file_id", at.alias("pos"), F.col("event_time").alias("text")).withColumn("salt", F.pmod("raw_id", F.lit(_FILE_SALTS)).cast("int"))
    events = lines.join(place, ["feed_id", "file_id", "salt"], "left").select(
        F.lit("raw_event").alias("record_table"),
        F.col("raw_id").alias("record_id"),
        "feed_id",
        (F.coalesce("seq", F.lit(0)) * F.lit(1 << 21) + F.shiftright("pos", 12)).alias("block"),
        "pos",
        "text",
    )
    asked = table(spark, d, "raw_observation").select(
        F.lit("raw_observation").alias("record_table"),
        F.col("req_id").alias("record_id"),
        "feed_id",
        F.shiftright("req_id", 12).alias("block"),
        F.col("req_id").alias("pos"),
        F.col("observation_time_datetime").alias("text"),
    )
    return events.unionByName(asked).join(feed, "feed_id", "left").withColumnRenamed("feed_id", "source")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise(_time_texts(spark, d)).select("record_table", "record_id", "utc_us")


def p2_undeclared(spark: SparkSession, d: str) -> DataFrame:
    """The records whose day order is settled by the sequence alone: slash dates that can be read both ways, read without the feeds' declared
    order, beside the reading in that order."""
    texts = _time_texts(spark, d)
    numbers = [F.regexp_extract("text", rf"^\s*{p}", 1).try_cast("int") for p in (r"(\d{1,2})/\d{1,2}/\d{4}", r"\d{1,2}/(\d{1,2})/\d{4}")]
    both = texts.filter((numbers[0] <= 12) & (numbers[1] <= 12) & (numbers[0] != numbers[1])).select("record_table", "record_id")
    free = timestamps.normalise(texts.withColumn("day_first", F.lit(None).cast("boolean")))
    declared = timestamps.normalise(texts).select("record_table", "record_id", F.col("utc_us").alias("declared_us"))
    return free.join(both, ["record_table", "record_id"]).join(declared, ["record_table", "record_id"]).select("record_table", "record_id", "utc_us", "declared_us")


def _purchases(spark: SparkSession, d: str) -> DataFrame:
    """Counted purchases: ``entity, day, cents, late``, whether they were ingested in the last 30 days of the table's ingestion."""
    app = _app(spark, d)
    rows = counted(
        app,
        "row_id",
        F.col("event_type"),
        F.col("entities")["user"].alias("entity"),
        F.to_date("event_time").alias("day"),
        F.round(F.nanvl("attrs.purchase_amount", F.lit(None).cast("double")) * 100).cast("bigint").alias("cents"),
        F.col("ingested_at").alias("known"),
    ).filter("event_type = 'PurchaseEvent'")
    cut = app.agg(F.max("ingested_at") - F.expr("interval 30 days")).scalar()
    return rows.select("entity", "day", "cents", F.coalesce(F.col("known") >= cut, F.lit(True)).alias("late"))


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    """The state of what was ingested before the last 30 days, advanced by those days' arrivals, late rows being corrections of earlier days."""
    days = _purchases(spark, d).dropna(subset=["entity", "day"]).groupBy("entity", "day", "late").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"))
    return rolling.advance(rolling.rolling_state(days.filter("not late").drop("late")), days.filter("late").drop("late"), 1)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    quiet = (F.col("n_7") == 0) & (F.col("n_30") >= 4)
    burst = (F.col("since_first") >= 29) & (F.col("cents_30") > 0) & (F.col("cents_7") * 30 > 3 * 7 * F.col("cents_30"))
    form = F.array_compact(F.array(F.when(quiet, F.lit("quiet")), F.when(burst, F.lit("burst"))))
    return _rolling(spark, d).select(F.col("entity").alias("user_id"), F.date_format("day", "yyyy-MM-dd").alias("on_day"), F.explode(form).alias("case_form"))


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda w: (F.col(f"cents_{w}") / F.when(F.col(f"n_{w}") > 0, F.col(f"n_{w}")) / 100).alias(f"mean_{w}")
    return _rolling(spark, d).select(
        F.col("entity").alias("user_id"), F.date_format("day", "yyyy-MM-dd").alias("on_day"), "n_7", "cents_7", mean(7), "n_30", "cents_30", mean(30)
    )


def p3_versions(spark: SparkSession, d: str) -> DataFrame:
    """The advanced state against one computed at once: by user, the days of either and the days that are equal in both."""
    columns = ["entity", "day", "n", "cents", "n_7", "cents_7", "n_30", "cents_30", "since_first"]
    whole = rolling.rolling_state(rolling.daily(_purchases(spark, d))).select("entity", "day", F.struct(*columns).alias("whole"))
    both = _rolling(spark, d).select("entity", "day", F.struct(*columns).alias("advanced"), "version").join(whole, ["entity", "day"], "full_outer")
    return both.groupBy(F.col("entity").alias("user_id")).agg(F.count(F.lit(1)).alias("n_days"), F.count_if(F.col("whole").eqNullSafe(F.col("advanced"))).alias("n_equal"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = counted(_app(spark, d), "row_id", micros(F.col("event_time")).alias("us"), *(F.col("entities")[t].alias(t) for t in ("user", "device")))
    each = rows.select("us", F.explode(F.array(*(F.struct(F.lit(t).alias("entity_type"), F.col(t).alias("entity_id")) for t in ("user", "device")))).alias("e"))
    rule = table(spark, d, "session_rule").select("entity_type", (F.col("max_inactive_time") * 1_000_000).alias("gap_us"))
    events = each.select("e.*", "us").filter("entity_id is not null").join(rule, "entity_type")
    return sessions.sessions(events)


def _known(spark: SparkSession, d: str) -> DataFrame:
    use_utc(spark)
    versions = counted(
        table(spark, d, "profile_change"),
        "change_id",
        F.col("entities")["user"].alias("entity"),
        F.col("attrs.attr_name").alias("attr"),
        micros(F.col("event_time")).alias("held_us"),
        micros(F.col("ingested_at")).alias("known_us"),
        F.col("change_id").alias("id"),
        F.col("attrs.attr_value").alias("value"),
    )
    asked = table(spark, d, "observation").select(
        "obs_id", F.col("entities")["user"].alias("entity"), micros(F.col("observation_time_datetime")).alias("us"), F.col("include_events_on_obs_date").alias("inclusive")
    )
    return asof.as_known(versions, asked)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d).select("obs_id", F.col("attr").alias("attr_name"), F.col("id").alias("change_id"))


def p6_attributes(spark: SparkSession, d: str) -> DataFrame:
    """One row per observation with its attributes as known at its time; observations without any have an empty map."""
    known = _known(spark, d).groupBy("obs_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attr", "value")))).alias("attributes"))
    none = F.create_map().cast("map<string,string>")
    return table(spark, d, "observation").select("obs_id").join(known, "obs_id", "left").select("obs_id", F.coalesce("attributes", none).alias("attributes"))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    rows = counted(
        _app(spark, d),
        "row_id",
        F.col("row_id").alias("salt"),
        F.col("entities")["user"].alias("entity"),
        F.col("event_type"),
        micros(F.col("event_time")).alias("us"),
        F.round(F.nanvl("attrs.purchase_amount", F.lit(None).cast("double")) * 100).cast("bigint").alias("cents"),
    )
    return entity_features.entity_type_stats(rows, F.col("salt"))


def p7_features(spark: SparkSession, d: str) -> DataFrame:
    seen = _app(spark, d).groupBy("event_type").agg(F.max(micros(F.col("event_time"))).alias("us")).filter("event_type is not null")
    return entity_features.feature_table(_stats(spark, d), seen).withColumnRenamed("entity", "user_id")


def p7_expanded(spark: SparkSession, d: str) -> DataFrame:
    """The entries of ``p7_features`` as rows."""
    each = p7_features(spark, d).select("user_id", F.explode("features").alias("event_type", "f"))
    return each.select("user_id", "event_type", F.col("f.n").alias("n_events"), "f.cents", "f.seconds_since_last")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).select(F.col("entity").alias("user_id"), "event_type", F.col("n").alias("n_events"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_table, p2_found, p2_undeclared, p3_found, p3_rolling, p3_versions, p4_found, p6_found, p6_attributes, p7_found, p7_features, p7_expanded)}


_COUNTED = """with counted as (
  select * from (select *, row_number() over (partition by event_id, case when event_id is null then {id} end order by ingested_at, {id}) as rank from {table})
  where rank = 1 and experiment_id is null)"""
_ROLLING = (
    _COUNTED.format(table="app_event", id="row_id")
    + """, days as (
  select entities['user'] as user_id, cast(event_time as date) as day, count(*) as n, sum(coalesce(cast(round(attrs.purchase_amount * 100) as bigint), 0)) as cents
  from counted where event_type = 'PurchaseEvent' and entities['user'] is not null group by 1, 2),
spine as (select user_id, cast(unnest(generate_series(cast(min(day) as timestamp), cast(max(day) as timestamp), interval 1 day)) as date) as day, min(day) as first_day from days group by user_id),
filled as (select s.user_id, s.day, s.first_day, coalesce(d.n, 0) as n, coalesce(d.cents, 0) as cents from spine s left join days d on s.user_id = d.user_id and s.day = d.day),
totals as (select user_id, day, date_diff('day', first_day, day) as since_first,
  sum(n) over w7 as n_7, sum(cents) over w7 as cents_7, sum(n) over w30 as n_30, sum(cents) over w30 as cents_30 from filled
  window w7 as (partition by user_id order by day rows between 6 preceding and current row), w30 as (partition by user_id order by day rows between 29 preceding and current row))
"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _ROLLING
        + """select user_id, strftime(day, '%Y-%m-%d') as on_day, 'quiet' as case_form from totals where n_7 = 0 and n_30 >= 4
union all select user_id, strftime(day, '%Y-%m-%d'), 'burst' from totals where since_first >= 29 and cents_30 > 0 and cents_7 * 30 > 21 * cents_30""",
        "p3_rolling": _ROLLING
        + """select user_id, strftime(day, '%Y-%m-%d') as on_day, cast(n_7 as bigint) as n_7, cast(cents_7 as bigint) as cents_7, cents_7 / nullif(n_7, 0) / 100 as mean_7,
  cast(n_30 as bigint) as n_30, cast(cents_30 as bigint) as cents_30, cents_30 / nullif(n_30, 0) / 100 as mean_30 from totals""",
        "p3_versions": _ROLLING + "select user_id, count(*) as n_days, count(*) as n_equal from totals group by 1",
        "p4_found": _COUNTED.format(table="app_event", id="row_id")
        + """, each as (select 'user' as entity_type, entities['user'] as entity_id, epoch_us(event_time) as us from counted
  union all select 'device', entities['device'], epoch_us(event_time) from counted),
marked as (select e.*, case when us - lag(us) over (partition by e.entity_type, entity_id order by us) <= max_inactive_time * 1000000 then 0 else 1 end as begins
  from each e join session_rule r on e.entity_type = r.entity_type where entity_id is not null),
numbered as (select *, sum(begins) over (partition by entity_type, entity_id order by us, begins desc rows unbounded preceding) as no from marked)
select entity_type, entity_id, min(us) as start_us, max(us) as end_us, count(*) as n_events from numbered group by entity_type, entity_id, no""",
        "p6_found": _COUNTED.format(table="profile_change", id="change_id")
        + """, ranked as (select o.obs_id, c.attrs.attr_name as attr_name, c.change_id,
  row_number() over (partition by o.obs_id, c.attrs.attr_name order by c.event_time desc, c.ingested_at desc, c.change_id desc) as place
  from observation o join counted c on o.entities['user'] = c.entities['user']
  and (greatest(c.event_time, c.ingested_at) < o.observation_time_datetime or (o.include_events_on_obs_date and greatest(c.event_time, c.ingested_at) = o.observation_time_datetime)))
select obs_id, attr_name, change_id from ranked where place = 1 and attr_name is not null""",
        "p7_found": _COUNTED.format(table="app_event", id="row_id")
        + """ select entities['user'] as user_id, event_type, count(*) as n_events from counted where entities['user'] is not null and event_type is not null group by 1, 2""",
        "p7_expanded": _COUNTED.format(table="app_event", id="row_id")
        + """, stats as (select entities['user'] as user_id, event_type, count(*) as n, max(event_time) as last_at, sum(coalesce(cast(round(attrs.purchase_amount * 100) as bigint), 0)) as cents
  from counted where entities['user'] is not null and event_type is not null group by 1, 2),
types as (select distinct event_type from app_event where event_type is not null), users as (select distinct user_id from stats)
select u.user_id, t.event_type, coalesce(n, 0) as n_events, cast(coalesce(cents, 0) as bigint) as cents,
  (epoch_us((select max(event_time) from app_event where event_type is not null)) - epoch_us(last_at)) / 1e6 as seconds_since_last
from users u cross join types t left join stats s on s.user_id = u.user_id and s.event_type = t.event_type""",
    }
