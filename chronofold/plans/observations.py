"""Observation generators: for which entities and times features are computed.

All give ``entities`` map, ``obs_dt`` and ``event_id``, and, where the observation is an event, that event as ``ctx``. Equal entities and times are
one observation.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.fql.parser import Parser
from chronofold.plans.binder import Binder
from chronofold.sources.store import EventStore


@dataclass(frozen=True)
class Observations:
    rows: DataFrame
    #: Every observation has one entity, of one of these types, or of any if empty; None if observations may have several.
    single: tuple[str, ...] | None = None
    has_event: bool = False
    #: Every observation has one entity of each of these types, if known.
    together: tuple[str, ...] | None = None


_UNIT = {"millisecond": "milliseconds", "second": "seconds", "minute": "minutes", "hour": "hours", "day": "days", "week": "weeks"}
_EVENT = ["event_id", "event_type", "event_time", "entities", "attrs"]


def _of_entity(t: str, i: str) -> Column:
    return F.create_map(F.col(t), F.col(i))


def _none() -> Column:
    return F.lit(None).cast("string").alias("event_id")


def every(store: EventStore, nth: int, unit: str, entity_types: Iterable[str] | None = None) -> Observations:
    """Per entity from a millisecond before its first event in steps of ``nth`` units, and at the end a millisecond after its last event.
    Entities come from events without experiment; global events count for all of them."""
    if unit not in _UNIT or nth < 1:
        raise ValueError(f"steps of {nth} {unit}")
    types = tuple(entity_types) if entity_types else None
    base = store.visible().select("event_time", "entities")
    each = base.select("event_time", F.explode("entities").alias("t", "i")).filter("i is not null")
    if types:
        each = each.filter(F.col("t").isin(*types))
    span = each.groupBy("t", "i").agg(F.min("event_time").alias("lo"), F.max("event_time").alias("hi"))
    if store.has_global():
        g = base.filter(F.size("entities") == 0).agg(F.struct(F.min("event_time").alias("lo"), F.max("event_time").alias("hi"))).scalar()
        span = span.select("t", "i", F.least("lo", g["lo"]).alias("lo"), F.greatest("hi", g["hi"]).alias("hi"))
    lo, hi = F.col("lo") - F.expr("interval 1 millisecond"), F.col("hi") + F.expr("interval 1 millisecond")
    steps = F.array_distinct(F.array_append(F.sequence(lo, hi, F.expr(f"interval {nth} {_UNIT[unit]}")), hi))
    return Observations(span.select(_of_entity("t", "i").alias("entities"), F.explode(steps).alias("obs_dt"), _none()), types or ())


def fixed(store: EventStore, entity_types: Iterable[str], dates: Iterable[datetime | str]) -> Observations:
    """All entities of the types at each of the dates."""
    types = tuple(entity_types)
    at = F.array(*(F.lit(d).cast("timestamp_ntz") for d in dates))
    found = store.entities().filter(F.col("entity_type").isin(*types))
    return Observations(found.select(_of_entity("entity_type", "entity_id").alias("entities"), F.explode(at).alias("obs_dt"), _none()), types)


def listed(store: EventStore, rows: list[tuple[dict[str, str], datetime, str | None]] | DataFrame) -> Observations:
    """Given entities, times and, if any, event ids."""
    shape = T.StructType([T.StructField("entities", T.MapType(T.StringType(), T.StringType())), T.StructField("obs_dt", T.TimestampNTZType()), T.StructField("event_id", T.StringType())])
    if isinstance(rows, DataFrame):
        df = rows if "event_id" in rows.columns else rows.withColumn("event_id", _none())
        return Observations(df.select("entities", F.col("obs_dt").cast("timestamp_ntz").alias("obs_dt"), "event_id"))
    single = tuple({next(iter(e)) for e, *_ in rows}) if rows and all(len(e) == 1 for e, *_ in rows) else None
    return Observations(store.spark.createDataFrame([(e, d, i) for e, d, i in rows], shape), single)


def _from_events(events: DataFrame, together: tuple[str, ...] | None = None) -> Observations:
    return Observations(events.filter("event_time is not null").select("entities", F.col("event_time").alias("obs_dt"), "event_id", F.struct(*_EVENT).alias("ctx")), None, True, together)


def all_events(store: EventStore) -> Observations:
    """Each event that has an id, with all of its entities, experiments included."""
    return _from_events(store.events.filter("event_id is not null"))


def events_by_entity(store: EventStore, entity_types: Iterable[str]) -> Observations:
    """Events with exactly these entity types."""
    want = F.array(*(F.lit(t) for t in sorted(set(entity_types))))
    return _from_events(store.events.filter("event_id is not null").filter(F.array_sort(F.map_keys("entities")) == want), tuple(sorted(set(entity_types))))


def conditional(store: EventStore, condition: str) -> Observations:
    """Events that meet a condition of the query language."""
    p = Parser(condition)
    node = p.expr()
    p.end()
    test = Binder(store.events.schema["attrs"].dataType).bind(node, scan=True)
    rows = store.events.withColumn("e", F.struct(*_EVENT)).filter(F.coalesce(test.need("condition", "bool").cast("boolean"), F.lit(False))).drop("e")
    return _from_events(rows)


def of_events(store: EventStore, rows: list[tuple[dict[str, str], str]] | DataFrame) -> Observations:
    """The listed events, each for the listed entities."""
    shape = "entities map<string,string>, event_id string"
    want = rows.select("entities", "event_id") if isinstance(rows, DataFrame) else store.spark.createDataFrame(rows, shape)
    found = store.events.select(F.col("event_id"), F.struct(*_EVENT).alias("ctx"))
    joined = want.filter("event_id is not null").join(found, "event_id")
    return Observations(joined.select("entities", F.col("ctx.event_time").alias("obs_dt"), "event_id", "ctx"), None, True)
