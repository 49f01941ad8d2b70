"""Queries as DataFrame plans.

Aggregates are computed in rounds, each round's as soon as the variables they read are known, by one of two plans:

* blocks: aggregates that add up, over any interval but ``between``. See ``blocks``; linear in the events, whatever the intervals. Global events are
  a sequence of their own whose sums are added to every entity's, and all events without link by entity are one sequence.
* join: observations are joined to their events by entity within the hull of the round's intervals, and aggregated per observation. For
  ordered lists, medians, conditions on the observation, grouping and extremes. Intervals of fixed length are joined by stretches of time,
  else entities with very many events are split over salts.

Where no entity links the two sides of a join, they are joined by time buckets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.fql import nodes as N
from chronofold.fql import parse_query
from chronofold.fql.lexer import QueryError
from chronofold.functions import aggregates
from chronofold.functions.aggregates import Built, Rows
from chronofold.functions.typed import MAP, Typed
from chronofold.operators import sessions
from chronofold.plans import blocks, intervals
from chronofold.plans.binder import Binder, group_key, narrow, uses_event, uses_observation
from chronofold.plans.observations import Observations
from chronofold.sources.store import EventStore

RELATED, ALL = "related", "all"
_EVENT = ["event_id", "event_type", "event_time", "entities", "attrs"]
_KEY = ["o_key", "o_us"]
#: Events of an entity are split in joins into parts of about so many; so at most one entity of so many rows is, and the list of them fits every task.
HOT_ROWS = 2_000_000
#: Joins by stretches of time have stretches of at least this length.
LEAST_STRETCH_US = 86_400_000_000
#: Parts that results of all entities' events are repeated in, since many observations may have one time.
TIME_SALTS = 8
#: Time buckets that the span of the events is cut into for joins without a key.
BUCKETS = 512


@dataclass
class _Agg:
    node: N.Agg
    column: str
    #: Set when computed.
    result: Typed | None = None


@dataclass
class _State:
    rows: DataFrame
    binder: Binder
    observations: Observations
    #: The observations before anything is computed for them.
    asked: DataFrame
    aggs: dict[str, _Agg] = field(default_factory=dict)


def canonical_key(entities: Column) -> Column:
    """Entity types and ids as one text."""
    pairs = F.transform(F.map_entries(entities), lambda e: F.concat_ws("\x01", e["key"], e["value"]))
    return F.array_join(F.array_sort(pairs), "\x02")


def variable_order(features: list[N.Feature]) -> list[N.Feature]:
    """Features so that variables come before their uses; source order otherwise."""
    named = {f.name: f for f in features if f.variable}
    out: list[N.Feature] = []
    state: dict[int, int] = {}

    def visit(f: N.Feature, path: tuple[str, ...]) -> None:
        if state.get(id(f)) == 2:
            return
        if state.get(id(f)) == 1:
            raise QueryError("variables depend on each other: " + " -> ".join(path))
        state[id(f)] = 1
        for x in f.expr.walk():
            if isinstance(x, N.Name) and x.context and x.path in named:
                visit(named[x.path], (*path, x.path))
        state[id(f)] = 2
        out.append(f)

    for f in features:
        visit(f, (f.name,))
    return out


class Engine:
    def __init__(self, store: EventStore) -> None:
        self.store = store

    def query(
        self,
        observations: Observations,
        query: str | list[str],
        scope: str = RELATED,
        include_events_on_obs_date: bool = False,
        experiment_id: str | None = None,
        related: Iterable[str] | None = None,
    ) -> DataFrame:
        """A row per observation, a column per feature, in the order of the query. ``scope``: events of the observation's entities and global events,
        or all events that have entities. ``related``: entity types; events are found by the observation's entities of these types alone."""
        if scope not in (RELATED, ALL):
            raise ValueError(f"scope {scope!r}")
        features = parse_query(query)
        self.inclusive, self.scope, self.experiment = include_events_on_obs_date, scope, experiment_id
        self.related = None if related is None else sorted(set(related))
        attrs = self.store.events.schema["attrs"].dataType
        self.attrs = attrs if isinstance(attrs, T.StructType) else T.StructType([])
        asked = self._observations(observations, features)
        state = _State(asked, Binder(self.attrs), observations, asked)
        done: set[int] = set()
        ordered = variable_order(features)
        variables = {f.name for f in features if f.variable}
        columns: dict[int, Typed] = {}
        while len(done) < len(ordered):
            self._round(state, [f for f in ordered if id(f) not in done], variables)
            progress = False
            for f in ordered:
                if id(f) in done or not self._ready(state, f.expr, variables):
                    continue
                value = state.binder.bind(f.expr)
                done.add(id(f))
                progress = True
                if f.variable:
                    name = f"v_{f.name}"
                    state.rows = state.rows.withColumn(name, value.col)
                    state.binder.variables[f.name] = Typed(F.col(name), value.kind, value.type)
                else:
                    columns[id(f)] = value
            if not progress and not self._pending(state, [f for f in ordered if id(f) not in done], variables):
                raise QueryError("the query can't be ordered")
        shown = [f for f in features if not f.variable]
        return state.rows.select(*(columns[id(f)].col.alias(f"c{i}") for i, f in enumerate(shown))).toDF(*(f.name for f in shown))

    # observations

    def _observations(self, o: Observations, features: list[N.Feature]) -> DataFrame:
        rows = o.rows
        variables = {f.name for f in features if f.variable}
        named = {x.path for f in features for x in f.expr.walk() if isinstance(x, N.Name) and x.context} - variables
        needs = bool(named) or any(uses_event(f.expr) for f in features)
        inside = {id(x) for f in features for a in f.expr.walk() if isinstance(a, N.Agg) for y in (*a.args, a.where, a.group_by, a.having) if y is not None for x in y.walk()}
        own = {x.path for f in features for x in f.expr.walk() if isinstance(x, N.Name) and not x.context and id(x) not in inside}
        if needs and not o.has_event:
            found = self.store.events.filter("event_id is not null").select(F.col("event_id"), narrow({c: F.col(c) for c in _EVENT}, self.attrs, named | own).alias("ctx"))
            rows = rows.join(found, "event_id", "left")
        elif needs:
            rows = rows.withColumn("ctx", narrow({c: F.col("ctx").getField(c) for c in _EVENT}, self.attrs, named | own))
        else:
            rows = rows.drop("ctx").withColumn("ctx", F.lit(None).cast("struct<event_id: string>"))
        entities = F.coalesce("entities", F.create_map().cast("map<string,string>"))
        keyed = rows.filter("obs_dt is not null").select(entities.alias("o_entities"), "obs_dt", "ctx").select(canonical_key(F.col("o_entities")).alias("o_key"), F.unix_micros(F.col("obs_dt").cast("timestamp")).alias("o_us"), "o_entities", "obs_dt", "ctx")
        if o.has_event and needs:
            # of several events at one time the one with the highest id
            best = keyed.groupBy(*_KEY).agg(F.max_by(F.struct("o_entities", "obs_dt", "ctx"), F.coalesce("ctx.event_id", F.lit(""))).alias("r"))
            return best.select(*_KEY, "r.*")
        return keyed.dropDuplicates(_KEY)

    # rounds

    def _ready(self, state: _State, node: N.Node, variables: set[str]) -> bool:
        if isinstance(node, N.Agg):
            return repr(node) in state.binder.aggregates
        if isinstance(node, N.Name) and node.context and node.path in variables and node.path not in state.binder.variables:
            return False
        return all(self._ready(state, x, variables) for x in node.children())

    def _pending(self, state: _State, features: list[N.Feature], variables: set[str]) -> list[N.Agg]:
        """Aggregates not computed yet whose insides are known."""
        out: dict[str, N.Agg] = {}

        def visit(node: N.Node) -> None:
            if isinstance(node, N.Agg):
                if repr(node) in state.binder.aggregates:
                    return
                if all(self._ready(state, x, variables) for x in node.children()):
                    out[repr(node)] = node
                    return
            for x in node.children():
                visit(x)

        for f in features:
            visit(f.expr)
        return list(out.values())

    def _round(self, state: _State, features: list[N.Feature], variables: set[str]) -> None:
        todo = [_Agg(n, f"a_{len(state.binder.aggregates) + i}") for i, n in enumerate(self._pending(state, features, variables))]
        for a in todo:
            self._check(a.node)
        summed = [a for a in todo if self._summed(state, a.node)]
        # those that look at the row before apart by what they look at, as the others need not wait for it
        apart: dict[str, list[_Agg]] = {}
        for a in summed:
            apart.setdefault(f"{a.node.args!r} {a.node.source!r} {a.node.where!r}" if a.node.name in aggregates.LAGGED else "", []).append(a)
        for group in apart.values():
            self._blocks(state, group)
        by_link: dict[tuple, list[_Agg]] = {}
        for a in todo:
            if a not in summed:
                by_link.setdefault(self._link(a.node), []).append(a)
        for link, group in by_link.items():
            self._joins(state, group, link)
        for a in todo:
            state.binder.aggregates[repr(a.node)] = a.result

    @staticmethod
    def _check(node: N.Agg) -> None:
        found = aggregates.find(node.name)
        if len(node.args) != found.arity:
            raise QueryError(f"{node.name} takes {found.arity} arguments, not {len(node.args)}")
        if node.having is not None and node.group_by is not None:
            raise QueryError("GROUP BY and HAVING can't be combined")

    def _summed(self, state: _State, node: N.Agg) -> bool:
        inside = [*node.args, *([node.where] if node.where else [])]
        if node.name in aggregates.LAGGED:  # what is before a row can be of the same sequence only
            adds_up = self.scope == RELATED and self.related is None and aggregates.LAGGED[node.name](self._rows(F.lit(True)), state.binder.bind(node.args[0], True)) is not None
        else:
            adds_up = node.name in aggregates.PARTS
        return (
            adds_up
            and isinstance(node.interval, (N.Whole, N.Span, N.Calendar))
            and node.group_by is None
            and node.having is None
            and not any(uses_observation(x) for x in inside)
            and (self._parts(state, node, self._rows(F.lit(True))) is not None if node.name in aggregates.PARTS else not self.store.has_global())
        )

    def _events(self, nodes: list[N.Agg]) -> DataFrame:
        """What the aggregates can read of the store: ``e``, ``e_us`` and ``e_entities``."""
        df = self.store.visible(None if self.scope == ALL else self.experiment).filter("event_time is not null")
        types = [event_types(n) for n in nodes]
        if all(t is not None for t in types):
            df = df.filter(F.col("event_type").isin(*sorted(set().union(*types))))
        paths = {x.path for n in nodes for x in n.walk() if isinstance(x, N.Name) and not x.context}
        e = narrow({c: F.col(c) for c in _EVENT}, self.attrs, paths)
        return df.select(e.alias("e"), F.unix_micros(F.col("event_time").cast("timestamp")).alias("e_us"), F.col("entities").alias("e_entities"))

    @staticmethod
    def _rows(use: Column) -> Rows:
        return Rows(use, F.col("e_us"), F.col("e").getField("event_time"), F.coalesce(F.col("e").getField("event_id"), F.lit("")))

    def _use(self, state: _State, node: N.Agg) -> Column:
        use = F.lit(True)
        if node.source is not None:
            use = use & F.coalesce(F.col("e").getField("event_type") == node.source, F.lit(False))
        if node.where is not None:
            use = use & F.coalesce(state.binder.bind(node.where, True).need("condition", "bool").cast("boolean"), F.lit(False))
        return use

    def _built(self, state: _State, node: N.Agg, rows: Rows) -> Built:
        found = aggregates.find(node.name)
        if found.arity == 2:
            value = node.args[1].value if isinstance(node.args[1], N.Lit) else None
            return found.build(rows, state.binder.bind(node.args[0], True), value)
        if node.name == "count" and isinstance(node.args[0], N.Star):
            return found.build(rows, None)
        return found.build(rows, state.binder.bind(node.args[0], True))

    def _parts(self, state: _State, node: N.Agg, rows: Rows) -> aggregates.Parts | None:
        star = node.name == "count" and isinstance(node.args[0], N.Star)
        return aggregates.PARTS[node.name](rows, None if star else state.binder.bind(node.args[0], True))

    def _linked(self) -> Column:
        """The entities by which an observation finds its events."""
        if self.related is None:
            return F.col("o_entities")
        return F.map_filter("o_entities", lambda t, _: t.isin(*self.related) if self.related else F.lit(False))

    def _keyed(self, events: DataFrame, state: _State, *columns: str) -> DataFrame:
        """The events by ``key``, once for each observed set of entity types of which they have all entities."""
        o, only = state.observations, self.related
        if o.single is not None:
            each = events.select(F.explode("e_entities").alias("t", "i"), *columns).filter("i is not null")
            for types in (o.single or None, only):
                if types is not None:
                    each = each.filter(F.col("t").isin(*types))
            return each.select(F.concat_ws("\x01", "t", "i").alias("key"), *columns)
        if o.together:
            own = [t for t in sorted(o.together) if only is None or t in only]
            sets = F.array(F.array(*(F.lit(t) for t in own))) if own else F.array().cast("array<array<string>>")
        else:  # the sets of entity types that occur, as a subquery
            own = F.array_sort(F.map_keys(self._linked()))
            sets = state.asked.select(own.alias("s")).filter(F.size("s") > 0).agg(F.collect_set("s")).scalar()
        each = events.select("e_entities", F.explode(sets).alias("s"), *columns).filter(F.forall("s", lambda t: F.try_element_at(F.col("e_entities"), t).isNotNull()))
        return each.select(canonical_key(F.map_filter("e_entities", lambda k, _: F.array_contains("s", k))).alias("key"), *columns)

    # block plan

    def _blocks(self, state: _State, aggs: list[_Agg]) -> None:
        events = self._events([a.node for a in aggs])
        columns: dict[str, tuple[str, Column, str]] = {}
        found: dict[str, tuple[aggregates.Parts, list[str]]] = {}
        lagged: dict[str, aggregates.Lagged] = {}
        for a in aggs:
            if a.node.name in aggregates.LAGGED:
                lagged[a.column] = aggregates.LAGGED[a.node.name](self._rows(self._use(state, a.node)), state.binder.bind(a.node.args[0], True))
                continue
            p = self._parts(state, a.node, self._rows(self._use(state, a.node)))
            names = []
            for k, (value, op) in enumerate(p.values):
                text = f"{op} {value._jc.toString()}"
                name = next((n for n, (t, _, _) in columns.items() if t == text), None)
                if name is None:
                    name = f"p{len(columns)}"
                    columns[name] = (text, value, op)
                names.append(name)
            found[a.column] = (p, names)
        # with the observation's own time, low < t <= high is low <= t - 1 < high
        us = F.col("e_us") - 1 if self.inclusive else F.col("e_us")
        # equal values share the look for the row before, over whatever intervals
        value_of: dict[tuple[str, bool], tuple[str, Column]] = {}
        raw = {c: value_of.setdefault((x.value._jc.toString(), x.by_value), (f"v{len(value_of)}", x.value))[0] for c, x in lagged.items()}
        tie = [F.coalesce(F.col("e").getField("event_id"), F.lit("")).alias("tie")] if raw else []
        ready = events.select("e_entities", us.alias("us"), *tie, *(v.alias(n) for n, (_, v, _) in columns.items()), *(v.alias(n) for n, v in value_of.values()))
        links = []
        if self.scope == RELATED:
            keyed = self._keyed(ready, state, *ready.columns[1:])
            for (_, by_value), (n, _) in value_of.items():
                keyed = blocks.previous(keyed, n, by_value, f"b{n}")
            for c, x in lagged.items():
                node = next(a.node for a in aggs if a.column == c)
                parts = {f"{node.name}_{raw[c]}_{k}": part for k, part in enumerate(x.parts(F.col(raw[c]), F.struct("us", "tie"), F.col(f"b{raw[c]}")))}
                keyed = keyed.withColumns({n: v for n, (v, _) in parts.items() if n not in columns})
                columns |= {n: (n, v, op) for n, (v, op) in parts.items()}
                low, _ = intervals.bounds(node.interval, F.col("o_us"), F.col("obs_dt"), state.binder.bind)
                found[c] = (aggregates.Parts((), partial(x.total, low=low), x.kind, x.empty), list(parts))
            links.append(("e", keyed, False))
            if self.store.has_global():
                links.append(("g", ready.filter(F.size("e_entities") == 0), True))
        else:
            links.append(("g", ready.filter(F.size("e_entities") > 0), True))
        pieces: dict[str, list[list[Column]]] = {a.column: [[] for _ in found[a.column][1]] for a in aggs}
        for i, (block, own) in enumerate(blocks.groups(list(dict.fromkeys(a.node.interval for a in aggs)))):
            mine = [a for a in aggs if a.node.interval in own]
            wanted: dict[str, list[N.Interval]] = {}
            for a in mine:
                for n in found[a.column][1]:
                    if a.node.interval not in wanted.setdefault(n, []):
                        wanted[n].append(a.node.interval)
            parts = {n: columns[n][2] for n in columns if n in wanted}
            for what, rows, whole in links:
                if whole:
                    length = next(n for n in range(min(block, blocks.MINUTE_US), 0, -1) if block % n == 0)
                    rows = rows.withColumn("key", F.lit(""))
                    asks = state.asked.select(F.lit("").alias("key"), "o_us").distinct()
                    result, terms = blocks.terms(rows, asks, asks, wanted, parts, length, True)
                    result = result.drop("key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(TIME_SALTS - 1))))
                elif self.related is not None:  # several observations may have the same of these entities
                    asks = state.asked.select(canonical_key(self._linked()).alias("key"), "o_us").distinct()
                    result, terms = blocks.terms(rows, asks, asks, wanted, parts, block, False)
                else:
                    asks = state.rows.select(F.col("o_key").alias("key"), "o_us", F.struct(*state.rows.columns).alias("o"))
                    result, terms = blocks.terms(rows, asks, state.asked.select(F.col("o_key").alias("key"), "o_us"), wanted, parts, block, False)
                    result = result.drop("key", "o_us")
                named = {c: f"{what}{i}_{c}" for c in result.columns if c not in ("o", "o_us", "salt", "key")}
                result = result.withColumnsRenamed(named)
                if whole:
                    salted = state.rows.withColumn("salt", F.pmod(F.xxhash64("o_key"), F.lit(TIME_SALTS)).cast("int"))
                    state.rows = salted.join(result, ["o_us", "salt"], "left").drop("salt")
                elif self.related is not None:
                    state.rows = state.rows.withColumn("key", canonical_key(self._linked())).join(result, ["key", "o_us"], "left").drop("key")
                else:
                    state.rows = result.select("o.*", *named.values())
                for a in mine:
                    for k, n in enumerate(found[a.column][1]):
                        pieces[a.column][k] += [F.col(named[c]) for c in terms[n, a.node.interval]]
        final = {}
        for a in aggs:
            p, names = found[a.column]
            total = p.total(*(aggregates.merged(columns[n][2], x) for n, x in zip(names, pieces[a.column])))
            final[a.column] = total if p.empty is None else F.coalesce(total, F.lit(p.empty))
            a.result = Typed(F.col(a.column), p.kind, p.type)
        used = [c for c in state.rows.columns if re.match(r"[eg]\d+_", c)]
        state.rows = state.rows.withColumns(final).drop(*used)

    # join plan

    def _link(self, node: N.Agg) -> tuple:
        """How observations find their events: by their entities, by an equality of the condition, or by time alone."""
        if self.scope == RELATED:
            return ("entities",)
        for x in conjuncts(node.where) if node.where is not None else ():
            if isinstance(x, N.Binary) and x.op == "=" and isinstance(x.left, N.Entity) and isinstance(x.right, N.Entity) and x.left.context != x.right.context:
                event, own = (x.left, x.right) if x.right.context else (x.right, x.left)
                return ("equal", event.kind, own.kind)
        return ("time",)

    def _sessions(self, state: _State, interval: N.Sessions) -> None:
        """Adds to the observations where their last sessions begin. All visible events of an entity make up its sessions."""
        if self.scope != RELATED or self.related is not None:
            raise QueryError("sessions are those of the observation's entities")
        events = self.store.visible(self.experiment).filter("event_time is not null").select(F.col("entities").alias("e_entities"), F.unix_micros(F.col("event_time").cast("timestamp")).alias("us"))
        keyed = self._keyed(events, state, "us").select(F.lit("").alias("entity_type"), F.col("key").alias("entity_id"), "us", F.lit(interval.gap).cast("bigint").alias("gap_us"))
        found = sessions.sessions(keyed)
        low = F.col("start_us")
        if interval.count > 1:
            order = Window.partitionBy("entity_id").orderBy("start_us")
            low = F.coalesce(F.lag("start_us", interval.count - 1).over(order), F.min("start_us").over(order))
        # with the observation's own time, low < t <= high is low <= t - 1 < high
        own = 1 if self.inclusive else 0
        rows = found.select(F.col("entity_id").alias("key"), (F.col("start_us") - own).alias("us"), F.struct(F.col("start_us"), (low - own).alias("low")).alias("p"))
        asks = state.rows.select(F.col("o_key").alias("key"), "o_us", F.struct(*state.rows.columns).alias("o"))
        past = N.Whole(True)
        result, terms = blocks.terms(rows, asks, state.asked.select(F.col("o_key").alias("key"), "o_us"), {"p": [past]}, {"p": "max"}, blocks.DAY_US, False)
        state.rows = result.select("o.*", aggregates.merged("max", [F.col(c) for c in terms["p", past]])["low"].alias(interval.column))

    def _joins(self, state: _State, aggs: list[_Agg], link: tuple) -> None:
        for i in dict.fromkeys(a.node.interval for a in aggs):
            if isinstance(i, N.Sessions) and i.column not in state.rows.columns:
                self._sessions(state, i)
        obs = state.rows
        limits = {a.column: intervals.bounds(a.node.interval, F.col("o_us"), F.col("obs_dt"), state.binder.bind) for a in aggs}
        obs = obs.withColumns({"o_low": _hull([x for x, _ in limits.values()], F.least, -(2**62)), "o_high": _hull([x for _, x in limits.values()], F.greatest, 2**62)})
        events = self._events([a.node for a in aggs])
        near = (F.col("e_us") > F.col("o_low")) & (F.col("e_us") <= F.col("o_high")) if self.inclusive else (F.col("e_us") >= F.col("o_low")) & (F.col("e_us") < F.col("o_high"))
        spans = [a.node.interval for a in aggs]
        hull = None
        if all(isinstance(i, N.Span) for i in spans):
            hull = (-max((i.micros for i in spans if i.past), default=0), max((i.micros for i in spans if not i.past), default=0))
        pairs = self._pairs(obs, events, near, link, state, hull)
        extremes = {}
        for a in aggs:
            use = self._use(state, a.node) & intervals.inside(F.col("e_us"), *limits[a.column], self.inclusive)
            if a.node.having is not None:
                v = state.binder.bind(a.node.having, True).col
                v = F.when(use, v)
                extremes[a.column] = (v, (F.min if a.node.extreme == "min" else F.max)(v).over(Window.partitionBy(*_KEY)))
        plain = [a for a in aggs if a.node.group_by is None]
        found: list[DataFrame] = []
        results: dict[str, Built] = {}
        if plain:
            base = pairs.withColumns({f"x_{c}": F.coalesce(v == m, F.lit(False)) for c, (v, m) in extremes.items()}) if extremes else pairs
            cols = []
            for a in plain:
                use = self._use(state, a.node) & intervals.inside(F.col("e_us"), *limits[a.column], self.inclusive)
                if a.column in extremes:
                    use = use & F.col(f"x_{a.column}")
                results[a.column] = b = self._built(state, a.node, self._rows(use))
                cols.append(b.over.alias(a.column))
            found.append(base.groupBy(*_KEY).agg(*cols))
        by_group: dict[str, list[_Agg]] = {}
        for a in aggs:
            if a.node.group_by is not None:
                by_group.setdefault(repr(a.node.group_by), []).append(a)
        for group in by_group.values():
            key = group_key(state.binder.bind(group[0].node.group_by, True))
            cols, entries = [], []
            for a in group:
                use = self._use(state, a.node) & intervals.inside(F.col("e_us"), *limits[a.column], self.inclusive)
                b = self._built(state, a.node, self._rows(use))
                cols += [b.over.alias(a.column), F.count(F.when(use, F.lit(1))).alias(f"n_{a.column}")]
                entries.append((a, b))
            each = pairs.withColumn("g", key).groupBy(*_KEY, "g").agg(*cols)
            maps = [F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(f"n_{a.column}") > 0, F.struct(F.col("g"), aggregates.finished(b, F.col(a.column)).alias("v")))))).alias(a.column) for a, b in entries]
            found.append(each.groupBy(*_KEY).agg(*maps))
        rows = state.rows
        for f in found:
            rows = rows.join(f, _KEY, "left")
        final = {}
        for a in aggs:
            if a.column in results:
                b = results[a.column]
                final[a.column] = aggregates.finished(b, F.col(a.column))
                a.result = Typed(F.col(a.column), b.kind, b.type)
            else:
                t = rows.schema[a.column].dataType
                final[a.column] = F.coalesce(F.col(a.column), F.create_map().cast(t))
                a.result = Typed(F.col(a.column), MAP, t)
        state.rows = rows.withColumns(final)

    def _pairs(self, obs: DataFrame, events: DataFrame, near: Column, link: tuple, state: _State, hull: tuple[int, int] | None) -> DataFrame:
        if link[0] == "equal":
            ek = F.try_element_at(F.col("e_entities"), F.lit(link[1]))
            ok = F.try_element_at(F.col("o_entities"), F.lit(link[2]))
            keyed = events.filter(F.size("e_entities") > 0).select("e", "e_us", ek.alias("k")).filter("k is not null")
            return self._by_key(obs.withColumn("j", ok), keyed, near, hull)
        has_entities = F.size("e_entities") > 0
        if link[0] == "time":
            return self._by_time(obs, events.filter(has_entities).select("e", "e_us"), near)
        each = self._keyed(events, state, "e", "e_us").withColumnRenamed("key", "k")
        pairs = self._by_key(obs.withColumn("j", F.col("o_key") if self.related is None else canonical_key(self._linked())), each, near, hull)
        if self.store.has_global():
            pairs = pairs.unionByName(self._by_time(obs, events.filter(~has_entities).select("e", "e_us"), near))
        return pairs

    @staticmethod
    def _by_key(obs: DataFrame, events: DataFrame, match: Column, hull: tuple[int, int] | None) -> DataFrame:
        """Joins ``j`` of observations to ``k`` of events, within stretches of time at least as long as the hull, or with the events of a hot key split
        over salts and its observations repeated for each."""
        if hull:
            length = F.lit(max(LEAST_STRETCH_US, hull[1] - hull[0])).cast("bigint")
            at = lambda us: F.floor(us / length)
            left = obs.withColumn("js", F.explode(F.sequence(at(F.col("o_us") + hull[0]), at(F.col("o_us") + hull[1]))))
            right = events.withColumn("ks", at(F.col("e_us")))
        else:
            counts = events.groupBy("k").count().filter(F.col("count") > HOT_ROWS)
            # a row for HOT_ROWS events at least
            hot = F.broadcast(counts.select(F.col("k").alias("h"), F.ceil(F.col("count") / F.lit(HOT_ROWS)).cast("int").alias("n")))
            salt = F.coalesce(F.pmod(F.xxhash64("e_us", F.col("e").getField("event_id")), F.col("n")), F.lit(0)).cast("int")
            left = obs.join(hot, F.col("j") == F.col("h"), "left").withColumn("js", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n") - 1, F.lit(0))))).drop("h", "n")
            right = events.join(hot, F.col("k") == F.col("h"), "left").withColumn("ks", salt).drop("h", "n")
        return left.join(right, (F.col("j") == F.col("k")) & (F.col("js") == F.col("ks")) & match).drop("j", "k", "js", "ks")

    @staticmethod
    def _by_time(obs: DataFrame, events: DataFrame, near: Column) -> DataFrame:
        """Joins by buckets of time: an observation goes into each bucket that its interval meets, an event into its own."""
        span = events.agg(F.struct(F.min("e_us").alias("lo"), F.max("e_us").alias("hi"))).scalar()
        lo, hi = F.coalesce(span["lo"], F.lit(0)), F.coalesce(span["hi"], F.lit(0))
        width = F.greatest(F.floor((hi - lo) / F.lit(BUCKETS)), F.lit(1)) + 1
        at = lambda c: F.floor((c - lo) / width)
        low, high = F.greatest(F.col("o_low"), lo), F.least(F.col("o_high"), hi)
        spread = obs.filter(low <= high).withColumn("j", F.explode(F.sequence(at(low), at(high))))
        return spread.join(events.withColumn("k", at(F.col("e_us"))), (F.col("j") == F.col("k")) & near).drop("j", "k")


def _hull(bounds: list[Column | None], f: Callable[..., Column], end: int) -> Column:
    """The outermost of bounds of which an open or null one is ``end``."""
    if any(b is None for b in bounds):
        return F.lit(end).cast("bigint")
    closed = [F.coalesce(b, F.lit(end)) for b in bounds]
    return f(*closed) if len(closed) > 1 else closed[0]


def conjuncts(node: N.Node) -> list[N.Node]:
    if isinstance(node, N.Binary) and node.op == "and":
        return conjuncts(node.left) + conjuncts(node.right)
    return [node]


def event_types(node: N.Agg) -> set[str] | None:
    """The event types an aggregate can use, if its FROM or an equality of its condition says so."""
    found = {node.source} if node.source is not None else None
    for x in conjuncts(node.where) if node.where is not None else ():
        own = None
        if isinstance(x, N.Binary) and x.op == "=":
            for a, b in ((x.left, x.right), (x.right, x.left)):
                if isinstance(a, N.Field) and a.name == "event_type" and isinstance(b, N.Lit) and isinstance(b.value, str):
                    own = {b.value}
        elif isinstance(x, N.In) and not x.negated and isinstance(x.value, N.Field) and x.value.name == "event_type":
            own = {str(o) for o in x.options}
        if own is not None:
            found = own if found is None else found & own
    return found
