"""Binding of syntax trees to columns.

A row of a plan has the observation's columns ``o_entities`` (map), ``obs_dt``, ``ctx`` (its own event or null), ``v_NAME`` (variables) and ``a_N``
(computed aggregates), and, where events are scanned, the event as struct ``e``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.fql import nodes as N
from chronofold.fql.lexer import QueryError
from chronofold.functions import scalars
from chronofold.functions.typed import INT, MAP, STR, STRUCT, TIME, Typed, literal, of_type


def attribute(struct: Column, t: T.StructType, path: str) -> Typed:
    """A dotted path through structs and maps."""
    col, at = struct, t
    parts = path.split(".")
    for i, part in enumerate(parts):
        if isinstance(at, T.StructType):
            rest = ".".join(parts[i:])
            exact = [f for f in at.fields if f.name == rest] or [f for f in at.fields if f.name == part] or [f for f in at.fields if f.name.lower() == part.lower()]
            if len(exact) != 1:
                raise QueryError(f"unknown attribute {path!r}")
            col, at = col.getField(exact[0].name), exact[0].dataType
            if exact[0].name == rest:
                break
        elif isinstance(at, T.MapType):
            return of_type(F.try_element_at(col, F.lit(".".join(parts[i:]))), at.valueType)
        else:
            raise QueryError(f"unknown attribute {path!r}")
    return of_type(col, at)


def root_of(t: T.StructType, path: str) -> str:
    """The outermost field that ``attribute`` reads for a path."""
    part = path.split(".")[0]
    for names in ([f.name for f in t.fields if f.name == path], [f.name for f in t.fields if f.name == part], [f.name for f in t.fields if f.name.lower() == part.lower()]):
        if len(names) == 1:
            return names[0]
    raise QueryError(f"unknown attribute {path!r}")


def narrow(event: dict[str, Column], t: T.StructType, paths: Iterable[str]) -> Column:
    """An event as struct with only the attributes that the paths read, so that no others are scanned or moved."""
    roots = sorted({root_of(t, p) for p in paths})
    attrs = F.struct(*(event["attrs"].getField(r).alias(r) for r in roots)) if roots else F.struct(F.lit(None).cast("int").alias("_none"))
    return F.struct(*(c.alias(n) for n, c in event.items() if n != "attrs"), attrs.alias("attrs"))


@dataclass
class Binder:
    attrs: T.StructType
    variables: dict[str, Typed] = field(default_factory=dict)
    #: Computed aggregates by their repr.
    aggregates: dict[str, Typed] = field(default_factory=dict)

    def bind(self, node: N.Node, scan: bool = False) -> Typed:
        """``scan``: names mean the scanned event, else the observation's own."""
        event = F.col("e") if scan else F.col("ctx")
        if isinstance(node, N.Agg):
            found = self.aggregates.get(repr(node))
            if found is None:
                raise QueryError("an aggregate can't stand here")
            return found
        if isinstance(node, N.Lit):
            return literal(node.value)
        if isinstance(node, N.Star):
            return Typed(F.lit(1).cast("bigint"), INT)
        if isinstance(node, N.ObsDt):
            return Typed(F.col("obs_dt"), TIME)
        if isinstance(node, N.Field):
            c = event.getField(node.name)
            return Typed(F.coalesce(c, F.lit("")), STR) if node.name == "event_id" else Typed(c, TIME if node.name == "event_time" else STR)
        if isinstance(node, N.Entity):
            entities = F.col("o_entities") if node.context else event.getField("entities")
            return Typed(F.try_element_at(entities, F.lit(node.kind)), STR)
        if isinstance(node, N.Name):
            if node.context:
                found = self.variables.get(node.path)
                return found if found is not None else attribute(F.col("ctx").getField("attrs"), self.attrs, node.path)
            return attribute(event.getField("attrs"), self.attrs, node.path)
        if isinstance(node, N.Binary):
            return scalars.binary(node.op, self.bind(node.left, scan), self.bind(node.right, scan))
        if isinstance(node, N.Negative):
            return scalars.num(-self.bind(node.value, scan).num("-"))
        if isinstance(node, N.Not):
            return Typed(~F.coalesce(self.bind(node.value, scan).need("not", "bool").cast("boolean"), F.lit(False)), "bool")
        if isinstance(node, N.In):
            return scalars.inside(self.bind(node.value, scan), node.options, node.negated)
        if isinstance(node, N.Call):
            args = [self.bind(x, scan) for x in node.args]
            return scalars.call(node.name, args, [x.value if isinstance(x, N.Lit) else None for x in node.args])
        raise QueryError(f"{type(node).__name__} can't stand here")


def uses_event(node: N.Node) -> bool:
    """Does a top-level expression read the observation's own event? Aggregates' insides don't count, but their @names do."""
    if isinstance(node, N.Agg):
        return any(isinstance(x, N.Name) and x.context for x in node.walk()) or any(uses_event(x) for x in node.walk() if x is not node and isinstance(x, N.Between))
    if isinstance(node, (N.Name, N.Field)) or isinstance(node, N.Entity) and not node.context:
        return True
    return any(uses_event(x) for x in node.children())


def uses_observation(node: N.Node) -> bool:
    return any(isinstance(x, N.ObsDt) or isinstance(x, (N.Name, N.Entity)) and x.context or isinstance(x, N.Agg) for x in node.walk())


def group_key(x: Typed) -> Column:
    """A map key: whole numbers without fraction, null as an empty text."""
    if x.kind in (MAP, STRUCT, "list"):
        text = F.to_json(x.col)
    elif x.kind == "num":
        text = F.regexp_replace(x.col.cast("string"), r"\.0$", "")
    else:
        text = x.col.cast("string")
    return F.coalesce(text, F.lit(""))
