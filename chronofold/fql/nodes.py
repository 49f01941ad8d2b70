"""Syntax tree of the feature query language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Node:
    def children(self) -> Iterator[Node]:
        for f in fields(self):
            v = getattr(self, f.name)
            for x in v if isinstance(v, tuple) else (v,):
                if isinstance(x, Node):
                    yield x

    def walk(self) -> Iterator[Node]:
        yield self
        for x in self.children():
            yield from x.walk()


@dataclass(frozen=True)
class Lit(Node):
    value: object


@dataclass(frozen=True)
class Star(Node):
    pass


@dataclass(frozen=True)
class ObsDt(Node):
    pass


@dataclass(frozen=True)
class Field(Node):
    """``event_type``, ``event_time`` or ``event_id``."""

    name: str


@dataclass(frozen=True)
class Name(Node):
    """An attribute path; with ``context`` written with @: a variable or an attribute of the observation's own event."""

    path: str
    context: bool = False


@dataclass(frozen=True)
class Entity(Node):
    """``entities.T``, or with ``context`` ``@entities.T``."""

    kind: str
    context: bool = False


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Negative(Node):
    value: Node


@dataclass(frozen=True)
class Not(Node):
    value: Node


@dataclass(frozen=True)
class In(Node):
    value: Node
    options: tuple
    negated: bool


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Interval(Node):
    pass


@dataclass(frozen=True)
class Whole(Interval):
    """``past`` or ``future``."""

    past: bool


@dataclass(frozen=True)
class Span(Interval):
    """``last 7 days``, ``next 2 weeks``: length in microseconds."""

    past: bool
    micros: int


@dataclass(frozen=True)
class Calendar(Interval):
    keyword: str


@dataclass(frozen=True)
class Between(Interval):
    low: Node
    high: Node


@dataclass(frozen=True)
class Sessions(Interval):
    """``last 2 sessions of 30 minutes``: from the start of a session of the entity, which ends with longer inactivity, to the observation."""

    count: int
    gap: int

    @property
    def column(self) -> str:
        return f"s_{self.count}_{self.gap}"


@dataclass(frozen=True)
class Agg(Node):
    name: str
    args: tuple[Node, ...]
    interval: Interval
    source: str | None = None
    where: Node | None = None
    group_by: Node | None = None
    extreme: str | None = None
    having: Node | None = None


@dataclass(frozen=True)
class Feature:
    """An item of a query. A variable is computed but not returned."""

    name: str
    expr: Node
    variable: bool = False
