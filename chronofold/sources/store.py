"""A store of events as one DataFrame: ``event_id, event_type, event_time, entities, experiment_id, attrs``.

Times are zone-free; an event without entities is global and visible to every entity; an event with an experiment is visible only
to queries that name it. Event types share one ``attrs`` struct, the union of their attributes; an attribute has one type.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.common import use_utc
from chronofold.functions.scalars import parse_time
from chronofold.functions.typed import kind_of

COLUMNS = ["event_id", "event_type", "event_time", "entities", "experiment_id", "attrs"]
_NAMES = {"num": "Num", "int": "Int", "bool": "Bool", "str": "Str", "date": "Date", "time": "DateTime", "null": "None", "map": "Map", "list": "Vec", "struct": "Map"}


class SchemaConflict(ValueError):
    """An attribute would change its type."""


def _type_name(t: T.DataType) -> str:
    if isinstance(t, T.MapType):
        return "MapNum" if isinstance(t.valueType, T.NumericType) else "MapStr"
    if isinstance(t, T.ArrayType):
        return "Vec" + _NAMES[kind_of(t.elementType)]
    return _NAMES[kind_of(t)]


def _paths(t: T.StructType, head: str = "") -> dict[str, T.DataType]:
    """Dotted paths of a struct: nested structs are kept and flattened."""
    out: dict[str, T.DataType] = {}
    for f in t.fields:
        out[head + f.name] = f.dataType
        if isinstance(f.dataType, T.StructType):
            out |= _paths(f.dataType, f"{head}{f.name}.")
    return out


def _merge(a: T.DataType, b: T.DataType, at: str) -> T.DataType:
    """The union of two types; structs by field, whole numbers widen to numbers, a null type gives way."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            fields[f.name] = _merge(fields[f.name], f.dataType, f"{at}{f.name}.") if f.name in fields else f.dataType
        return T.StructType([T.StructField(k, v) for k, v in fields.items()])
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_merge(a.elementType, b.elementType, at))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(T.StringType(), _merge(a.valueType, b.valueType, at))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return a if kind_of(a) == kind_of(b) == "int" and a.jsonValue() == "bigint" else T.LongType() if kind_of(a) == kind_of(b) == "int" else T.DoubleType()
    raise SchemaConflict(f"{at.rstrip('.')} is {a.simpleString()} and can't become {b.simpleString()}")


def _conform(c: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return c
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        own = {f.name: f.dataType for f in have.fields}
        cols = [(_conform(c.getField(f.name), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*cols)) if cols else c
    return c.cast(want)


class EventStore:
    """Holds a lazy DataFrame; nothing is copied or collected. Whether there are global events is looked up in the entities when a query needs to
    know; pass ``has_global`` to save the look."""

    def __init__(self, events: DataFrame, has_global: bool | None = None) -> None:
        self.spark: SparkSession = events.sparkSession
        use_utc(self.spark)
        self.events = self._normal(events)
        self._has_global = has_global

    @staticmethod
    def _normal(events: DataFrame) -> DataFrame:
        have = set(events.columns)
        empty = F.create_map().cast("map<string,string>")
        cols = {
            "event_id": F.col("event_id").cast("string") if "event_id" in have else F.lit(None).cast("string"),
            "event_type": F.col("event_type").cast("string") if "event_type" in have else F.lit(""),
            "event_time": F.col("event_time").cast("timestamp_ntz"),
            "entities": F.coalesce(F.col("entities").cast("map<string,string>"), empty) if "entities" in have else empty,
            "experiment_id": F.col("experiment_id").cast("string") if "experiment_id" in have else F.lit(None).cast("string"),
            "attrs": F.col("attrs") if "attrs" in have else F.lit(None).cast("struct<>"),
        }
        return events.select(*(c.alias(k) for k, c in cols.items()))

    # ingestion

    @classmethod
    def from_json(cls, lines: DataFrame, column: str = "value", attrs: T.StructType | None = None) -> EventStore:
        """One JSON event per row. Without ``attrs`` the type of the attributes is inferred in one pass over the rows; numbers are doubles.
        Lines that are no object, or whose time isn't zone-free, are left out."""
        use_utc(lines.sparkSession)
        if attrs is None:
            found = lines.select(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).first()
            attrs = _attrs_of(found["s"] if found else None)
        shape = T.StructType([*(T.StructField(n, T.StringType()) for n in ("event_id", "event_type", "event_time", "experiment_id")), T.StructField("entities", T.MapType(T.StringType(), T.StringType())), T.StructField("attrs", attrs)])
        rows = lines.select(F.from_json(column, shape).alias("j")).select("j.*")
        rows = rows.withColumn("event_time", parse_time(F.col("event_time"))).filter("event_time is not null and event_type is not null")
        return cls(rows)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> EventStore:
        return cls(spark.read.parquet(path))

    @classmethod
    def read_jdbc(cls, spark: SparkSession, url: str, attrs: T.StructType, **options: str) -> EventStore:
        """Tables ``events`` (event_id, event_type, event_time, attrs as JSON text, experiment_id) and ``events_entities`` (event_id, entity_type,
        entity_id). Pass ``partitionColumn`` and bounds in ``options`` to read in parallel."""
        load = lambda t: spark.read.format("jdbc").options(url=url, dbtable=t, **options).load()
        pairs = load("events_entities").groupBy("event_id").agg(F.map_from_entries(F.collect_set(F.struct("entity_type", "entity_id"))).alias("entities"))
        return cls(load("events").withColumn("attrs", F.from_json("attrs", attrs)).join(pairs, "event_id", "left"))

    def append(self, events: DataFrame) -> EventStore:
        """Adds events; their attributes are merged into the schema, a change of type is an error."""
        more = self._normal(events)
        have, new = self.events.schema["attrs"].dataType, more.schema["attrs"].dataType
        both = _merge(have, new, "")
        shape = lambda df, t: df.withColumn("attrs", _conform(F.col("attrs"), t, both))
        return EventStore(shape(self.events, have).unionByName(shape(more, new)))

    def unique(self) -> EventStore:
        """One event per id, the earliest by time and type; events without id all stay."""
        null = F.when(F.col("event_id").isNull(), F.xxhash64(F.monotonically_increasing_id()))
        keyed = self.events.withColumn("_own", null)
        picked = keyed.groupBy("event_id", "_own").agg(F.min_by(F.struct(*COLUMNS[1:]), F.struct("event_time", "event_type")).alias("r"))
        return EventStore(picked.select("event_id", "r.*"))

    # looking

    def schema(self) -> dict[str, str]:
        """Attribute path -> type name."""
        return {p: _type_name(t) for p, t in _paths(self.events.schema["attrs"].dataType).items()}

    def schema_by_type(self) -> DataFrame:
        """``event_type, attr_name, attr_type`` of the attributes that occur, in one aggregation."""
        paths = _paths(self.events.schema["attrs"].dataType)
        seen = self.events.groupBy("event_type").agg(*(F.max(F.col(f"attrs.{p}").isNotNull()).alias(f"p{i}") for i, p in enumerate(paths)))
        pairs = F.array(*(F.when(F.col(f"p{i}"), F.struct(F.lit(p).alias("attr_name"), F.lit(_type_name(t)).alias("attr_type"))) for i, (p, t) in enumerate(paths.items())))
        return seen.select("event_type", F.explode(F.array_compact(pairs)).alias("a")).select("event_type", "a.*")

    def schema_json(self) -> str:
        out: dict[str, dict[str, str]] = {}
        for r in self.schema_by_type().collect():  # a row per event type and attribute
            out.setdefault(r.event_type, {})[r.attr_name] = r.attr_type
        return json.dumps(out, sort_keys=True)

    def visible(self, experiment_id: str | None = None) -> DataFrame:
        e = F.col("experiment_id")
        return self.events.filter(e.isNull() if experiment_id is None else e.isNull() | (e == experiment_id))

    def entities(self, experiment_id: str | None = None) -> DataFrame:
        """Distinct ``entity_type, entity_id``."""
        return self.visible(experiment_id).select(F.explode("entities").alias("entity_type", "entity_id")).filter("entity_id is not null").distinct()

    def sorted(self) -> DataFrame:
        return self.events.orderBy("event_time", "event_id")

    def by_id(self, event_id: str) -> DataFrame:
        return self.events.filter(F.col("event_id") == event_id)

    def of_type(self, event_type: str) -> DataFrame:
        return self.events.filter(F.col("event_type") == event_type)

    def between(self, low: object, high: object) -> DataFrame:
        """Events with entities in a closed interval, each once."""
        return self.events.filter(F.col("event_time").between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")) & (F.size("entities") > 0) & F.col("experiment_id").isNull())

    def of_entity(self, entities: dict[str, str]) -> DataFrame:
        """Events of all the given entities."""
        test = F.lit(True)
        for k, v in entities.items():
            test = test & F.coalesce(F.col("entities")[k] == v, F.lit(False))
        return self.events.filter(test)

    def count(self) -> int:
        return self.events.count()

    def has_global(self) -> bool:
        if self._has_global is None:
            self._has_global = not self.events.filter(F.size("entities") == 0).isEmpty()
        return self._has_global

    def as_json(self) -> DataFrame:
        return self.events.select(F.to_json(F.struct(*COLUMNS), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value"))

    # removing and writing

    def flush(self, experiment_id: str | None = None, experiments: bool = False) -> EventStore:
        """Without events at all, without any experiment's, or without one experiment's."""
        e = F.col("experiment_id")
        if experiments:
            return EventStore(self.events.filter(e.isNull()))
        return EventStore(self.events.filter(F.lit(False) if experiment_id is None else e.isNull() | (e != experiment_id)))

    def write(self, path: str, mode: str = "append") -> None:
        """Parquet, partitioned by event type, so that FROM reads only its type."""
        self.events.write.mode(mode).partitionBy("event_type").parquet(path)

    def write_jdbc(self, url: str, batch: int = 10_000, **options: str) -> None:
        flat = self.events.withColumn("attrs", F.to_json("attrs"))
        put = lambda df, t: df.write.format("jdbc").options(url=url, dbtable=t, batchsize=batch, **options).mode("append").save()
        put(flat.drop("entities"), "events")
        put(self.events.select("event_id", F.explode("entities").alias("entity_type", "entity_id")), "events_entities")


def _attrs_of(variant: str | None) -> T.StructType:
    """The type of ``attrs`` from the schema of a variant; numbers become doubles."""
    if not variant:
        return T.StructType([])
    whole = T.DataType.fromDDL(variant.replace("OBJECT<", "STRUCT<"))

    def widen(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, widen(f.dataType)) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(widen(t.elementType))
        if isinstance(t, T.NumericType):
            return T.DoubleType()
        return T.StringType() if isinstance(t, (T.NullType, T.VariantType)) else t

    found = {f.name: f.dataType for f in whole.fields}.get("attrs") if isinstance(whole, T.StructType) else None
    return widen(found) if isinstance(found, T.StructType) else T.StructType([])
