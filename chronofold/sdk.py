"""A small client: plain dataclasses for events and configurations, and a session that takes events one by one or as tables.

Events given one by one are buffered on the driver and become a DataFrame with the next query; load tables for anything large.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from datetime import datetime
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.common import use_utc
from chronofold.plans import observations as O
from chronofold.plans.engine import ALL, RELATED, Engine
from chronofold.sources import EventStore


@dataclass
class Event:
    event_time: datetime | str
    event_type: str
    entities: dict[str, str] = field(default_factory=dict)
    attrs: dict[str, object] = field(default_factory=dict)
    event_id: str | None = None
    experiment_id: str | None = None

    def to_json(self) -> str:
        at = self.event_time if isinstance(self.event_time, str) else self.event_time.isoformat(sep=" ")
        return json.dumps(asdict(self) | {"event_time": at})


class DatePart(str, Enum):
    MILLISECOND, SECOND, MINUTE, HOUR, DAY, WEEK = "millisecond", "second", "minute", "hour", "day", "week"


@dataclass
class Interval:
    date_part: DatePart | str
    nth: int
    entity_types: list[str] = field(default_factory=list)


@dataclass
class Fixed:
    dates: list[datetime | str]
    entity_types: list[str]


@dataclass
class EntitySpecific:
    """Each (entities, time, event id or None)."""

    dates: list[tuple[dict[str, str], datetime, str | None]]


@dataclass
class ConditionalEvents:
    condition: str
    entity_types: list[str] = field(default_factory=list)


@dataclass
class EntitiesEventSpecific:
    """Each (entities, event id)."""

    dates: list[tuple[dict[str, str], str]]


@dataclass
class AllEvents:
    pass


@dataclass
class AllEventsByEntity:
    entity_types: list[str]


ObservationConfig = Interval | Fixed | EntitySpecific | ConditionalEvents | EntitiesEventSpecific | AllEvents | AllEventsByEntity


@dataclass
class EventScope:
    """Events of the observation's entities, of those of the listed types if any are, or all events that have entities."""

    all_events: bool = False
    related_entities_events: list[str] | None = None


@dataclass
class QueryConfig:
    include_events_on_obs_date: bool = False
    #: Spark decides on parallelism; kept so that configurations can be taken over.
    parallel: bool = True


def observations(store: EventStore, config: ObservationConfig) -> O.Observations:
    if isinstance(config, Interval):
        return O.every(store, config.nth, DatePart(config.date_part).value, config.entity_types)
    if isinstance(config, Fixed):
        return O.fixed(store, config.entity_types, config.dates)
    if isinstance(config, EntitySpecific):
        return O.listed(store, config.dates)
    if isinstance(config, ConditionalEvents):
        return O.conditional(store, config.condition)
    if isinstance(config, EntitiesEventSpecific):
        return O.of_events(store, config.dates)
    if isinstance(config, AllEventsByEntity):
        return O.events_by_entity(store, config.entity_types)
    return O.all_events(store)


class DuplicateEvent(ValueError):
    """An event id that the session has already."""


class Session:
    def __init__(self, spark: SparkSession, store: EventStore | None = None) -> None:
        use_utc(spark)
        self.spark, self._store, self._lines, self._ids = spark, store, [], set()

    def new_event(self, event: Event) -> None:
        if event.event_id is not None:
            if event.event_id in self._ids:
                raise DuplicateEvent(event.event_id)
            self._ids.add(event.event_id)
        self._lines.append(event.to_json())

    def new_json_event(self, text: str) -> None:
        found = json.loads(text)
        self.new_event(Event(**{k: found[k] for k in ("event_time", "event_type", "entities", "attrs", "event_id", "experiment_id") if k in found}))

    def insert_batch(self, events: Iterable[Event] | DataFrame) -> None:
        if isinstance(events, DataFrame):
            self._store = EventStore(events) if self._store is None else self._store.append(events)
        else:
            for e in events:
                self.new_event(e)

    @property
    def store(self) -> EventStore:
        """Everything given so far."""
        if self._lines or self._store is None:
            lines = self.spark.createDataFrame([(x,) for x in self._lines], "value string")
            new = EventStore.from_json(lines)
            self._store = new if self._store is None else self._store.append(new.events)
            self._lines = []
        return self._store

    def query(self, observation_config: ObservationConfig, query: str | list[str], scope: EventScope | None = None, config: QueryConfig | None = None, experiment_id: str | None = None) -> DataFrame:
        store, config = self.store, config or QueryConfig()
        how = ALL if scope is not None and scope.all_events else RELATED
        related = scope.related_entities_events or None if scope is not None else None
        return Engine(store).query(observations(store, observation_config), query, how, config.include_events_on_obs_date, experiment_id, related)

    def schema(self) -> str:
        return self.store.schema_json()

    def events(self) -> DataFrame:
        return self.store.sorted().select(F.to_json(F.struct("*")).alias("value"))

    def n_events(self) -> int:
        return self.store.count()

    def n_entities(self) -> int:
        return self.store.entities().count()

    def flush(self, experiment_id: str | None = None, experiments: bool = False) -> None:
        self._store = self.store.flush(experiment_id, experiments)
        if experiment_id is None and not experiments:
            self._ids.clear()


def to_csv(features: DataFrame, path: str) -> None:
    """Arrays and maps, which CSV can't hold, as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in features.dtypes]
    features.select(*flat).write.mode("overwrite").option("header", True).csv(path)
