"""Sliding aggregates in linear time, from parts that add up.

An interval [low, high) of an entity's time is cut at the borders of blocks: what its first block holds from ``low`` on, whole blocks, and what
its last block holds before ``high``. Running aggregates in a block, forwards and backwards, give the two ends; a block is one group of rows
by entity and time, so an entity that holds a third of all rows spreads over as many tasks as it has blocks. Whole blocks are aggregated once
before any shuffle, and only these sums, one per entity and block, are aggregated over the blocks of an interval. No event is aggregated
more than once in each direction, however many observations' intervals it is in, and all intervals of a round share the two passes.

Without an entity (global events, all events by time) one sequence holds all rows; its blocks are a minute long at most, and whole blocks are found in
a tree of block sums, of which any interval takes at most two nodes a level.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.fql.nodes import Calendar, Interval, Span, Whole
from chronofold.functions import aggregates
from chronofold.plans import intervals

DAY_US = 86_400_000_000
MINUTE_US = 60_000_000
#: An interval has at most so many whole blocks, so a step of a frame over block sums is bounded.
MOST_BLOCKS = 512
#: A lone interval up to this length is its own block.
LONE_US = 31 * DAY_US
#: Sums of blocks shorter than an hour are put together in stretches of so many blocks.
STRETCH = 8 * MOST_BLOCKS
#: The tree of block sums: levels, and the place of 1970 among its leaves.
LEVELS, ORIGIN = 36, 1 << 35


@dataclass(frozen=True)
class Cut:
    """How an interval is cut: the marks of its ends (None: at a border or open), and its whole blocks as (mark, kind, argument)."""

    low: str | None
    high: str | None
    middle: tuple[str, str, object] | None


def groups(found: list[Interval]) -> list[tuple[int, list[Interval]]]:
    """Intervals that share blocks, with the length of the blocks. Calendar intervals and the whole past need blocks of a day."""
    lengths = sorted({i.micros for i in found if isinstance(i, Span)}, reverse=True)
    daily = [i for i in found if not isinstance(i, Span)]
    out: list[list] = []  # block length, longest, lengths, fixed
    if daily:
        out.append([DAY_US, DAY_US, [], True])
    for n in lengths:
        for group in out:
            block, longest, own, fixed = group
            both = gcd(block, n)
            if max(longest, n) // both <= MOST_BLOCKS and (not fixed or both == block):
                group[0], group[1] = both, max(longest, n)
                own.append(n)
                break
        else:
            out.append([n, n, [n], False])
    result = []
    for block, _, own, fixed in out:
        if len(own) == 1 and not fixed and own[0] > LONE_US and own[0] % DAY_US == 0:
            days = own[0] // DAY_US
            block = next(k for k in range(1, days + 1) if days % k == 0 and days // k <= MOST_BLOCKS) * DAY_US
        result.append((block, [i for i in found if (i.micros in own if isinstance(i, Span) else fixed)]))
    return result


def cut(interval: Interval, block: int) -> Cut:
    if isinstance(interval, Whole):
        return Cut(None, "t", ("t", "before", None)) if interval.past else Cut("t", None, ("t", "after", None))
    if isinstance(interval, Span):
        n, k = interval.micros, interval.micros // block
        return Cut(f"-{n}", "t", ("t", "back", k) if k > 1 else None) if interval.past else Cut("t", f"+{n}", ("t", "ahead", k) if k > 1 else None)
    assert isinstance(interval, Calendar)
    unit = intervals.unit_of(interval.keyword)
    mark = "t" if intervals.to_date(interval.keyword) else f"@{interval.keyword}"
    return Cut(None, mark, None if unit == "day" else (mark, "unit", unit))


def place(mark: str) -> Column:
    """The time of a mark, from the observation's."""
    us = F.col("o_us")
    if mark == "t":
        return us
    if mark[0] == "@":
        at = F.timestamp_micros("o_us").cast("timestamp_ntz")
        return intervals.bounds(Calendar(mark[1:]), us, at, None)[1]
    return us + F.lit(int(mark)).cast("bigint")


def _block(us: Column, length: int) -> Column:
    n = F.lit(length).cast("bigint")
    return F.round((us - F.pmod(us, n)) / n).cast("bigint")


def _unit_start(block: Column, unit: str) -> Column:
    """The first day of a calendar unit, of a block that is a day."""
    return F.trunc(F.date_from_unix_date(block.cast("int")), unit)


def _sums(rows: DataFrame, parts: dict[str, str], *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(aggregates.gather(op, F.col(n)).alias(n) for n, op in parts.items()))


def terms(rows: DataFrame, asks: DataFrame, asked: DataFrame, wanted: dict[str, list[Interval]], parts: dict[str, str], block: int, tree: bool) -> tuple[DataFrame, dict[tuple[str, Interval], list[str]]]:
    """``rows``: ``key, us`` and the parts; ``asks``: ``key, o_us`` and, to be carried through, ``o``; ``asked``: the same keys
    and times, without what was computed for them so far, so that plans don't grow with each use; ``wanted``: intervals by part; ``parts``: how each
    is combined. Returns ``key, o_us`` (and ``o``) with columns, and the columns that add up to each part over each interval."""
    cuts = {i: cut(i, block) for own in wanted.values() for i in own}
    marks = sorted({m for c in cuts.values() for m in (c.low, c.high) if m})
    carried = ["o"] if "o" in asks.columns else []
    at = lambda c: _block(c, block)
    ends = lambda o: [F.struct(F.lit(i).alias("mark"), place(m).alias("us"), *([F.col("o") if i == 0 else F.lit(None).cast(asks.schema["o"].dataType).alias("o")] if o else [])) for i, m in enumerate(marks)]
    marked = asks.select("key", "o_us", F.explode(F.array(*ends(carried))).alias("m")).select("key", "o_us", "m.mark", "m.us", *(f"m.{c}" for c in carried)).withColumn("block", at(F.col("us")))
    types = {n: rows.schema[n].dataType for n in parts}
    nothing = [F.lit(None).cast(t).alias(n) for n, t in types.items()]
    none = [F.lit(None).cast("bigint").alias("o_us"), F.lit(None).cast("int").alias("mark"), *(F.lit(None).cast(asks.schema["o"].dataType).alias("o") for _ in carried)]
    blocked = rows.select("key", "us", *parts).withColumn("block", at(F.col("us")))
    both = blocked.select("key", "block", "us", F.lit(1).alias("turn"), *parts, *none).unionByName(marked.select("key", "block", "us", F.lit(0).alias("turn"), *nothing, "o_us", "mark", *carried))
    # a mark stands before the events of its moment: forwards they are later, backwards they are in
    way = {
        "f": Window.partitionBy("key", "block").orderBy("us", "turn").rowsBetween(Window.unboundedPreceding, 0),
        "b": Window.partitionBy("key", "block").orderBy(F.desc("us"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0),
    }
    ways = {(n, w) for n, own in wanted.items() for i in own for w, m in (("f", cuts[i].high), ("b", cuts[i].low)) if m}
    running = [aggregates.gather(op, F.col(n), lambda c, w=w: c.over(way[w])).alias(f"{n}_{w}") for w in way for n, op in parts.items() if (n, w) in ways]
    done = both.select("key", "block", "us", "turn", "o_us", "mark", *carried, *running).filter("mark is not null")
    # whole blocks
    found: dict[tuple[str, Interval], list[str]] = {}
    columns: dict[str, Column] = {}

    def column(part: str, interval: Interval, name: str, mark: str, source: str) -> None:
        columns[name] = F.max(F.when(F.col("mark") == marks.index(mark), F.col(source))) if len(marks) > 1 else F.col(source)
        found.setdefault((part, interval), []).append(name)

    middles = {(n, cuts[i].middle) for n, own in wanted.items() for i in own if cuts[i].middle}
    if middles and not tree:
        places = asked.select("key", F.explode(F.array(*ends([]))).alias("m")).select("key", at(F.col("m.us")).alias("block"))
        done = done.join(_frames(blocked, places, middles, parts, types, block), ["key", "block"], "left")
    for n, own in wanted.items():
        for i in own:
            c = cuts[i]
            if c.low:
                column(n, i, f"b_{n}_{marks.index(c.low)}", c.low, f"{n}_b")
            if c.middle and not tree:
                mark, kind, arg = c.middle
                column(n, i, f"m_{n}_{kind}_{arg}_{marks.index(mark)}", mark, f"{n}_{kind}_{arg}")
            if c.high:
                column(n, i, f"f_{n}_{marks.index(c.high)}", c.high, f"{n}_f")
    if len(marks) > 1:
        out = done.groupBy("key", "o_us").agg(*(F.first("o", True).alias("o") for _ in carried), *(c.alias(k) for k, c in columns.items()))
    else:
        out = done.select("key", "o_us", *carried, *(c.alias(k) for k, c in columns.items()))
    if tree:
        by = {i: [n for n, own in wanted.items() if i in own] for i in cuts}
        for k, (i, own) in enumerate(by.items()):
            nodes = _nodes(blocked, asked, cuts[i], {n: parts[n] for n in own}, block, f"w{k}_")
            if nodes is not None:
                out = out.join(nodes, "o_us", "left")
                for n in own:
                    found[n, i].append(f"w{k}_{n}")
    return out, found


def _frames(blocked: DataFrame, places: DataFrame, middles: set, parts: dict[str, str], types: dict, block: int) -> DataFrame:
    """For each block with marks what the whole blocks around it add up to: ``key, block`` and ``PART_KIND_ARGUMENT``."""
    used = {n: op for n, op in parts.items() if any(n == p for p, _ in middles)}
    totals = _sums(blocked, used, "key", "block").withColumn("asked", F.lit(False))
    reach = {kind: max([m[2] for _, m in middles if m[1] == kind], default=1) - 1 for kind in ("back", "ahead")}
    asked = places.distinct().select("key", "block", *(F.lit(None).cast(totals.schema[n].dataType).alias(n) for n in used), F.lit(True).alias("asked"))
    by = ["key"]
    if block < 3_600_000_000:
        by = ["key", "stretch"]
        stretch = lambda c: F.floor(c / F.lit(STRETCH))
        totals = totals.withColumn("stretch", F.explode(F.sequence(stretch(F.col("block") - reach["ahead"]), stretch(F.col("block") + reach["back"]))))
        asked = asked.withColumn("stretch", stretch(F.col("block")))
    seq = totals.unionByName(asked)
    plain: dict[str, dict[str, str]] = {}
    for n, op in used.items():
        anchor = F.first(F.col(n)["m"], True).over(Window.partitionBy(*by)) if op == "moments" else None
        pieces = aggregates.addends(op, F.col(n), anchor)
        plain[n] = {f"{n}_{k}": o for k, (_, o) in pieces.items()}
        seq = seq.withColumns({f"{n}_{k}": c for k, (c, _) in pieces.items()})
    out: dict[str, Column] = {}
    up = Window.partitionBy(*by).orderBy("block")
    down = Window.partitionBy(*by).orderBy(F.desc("block"))
    for n, (_, kind, arg) in sorted(middles, key=str):
        if kind == "before":
            w = up.rangeBetween(Window.unboundedPreceding, -1)
        elif kind == "after":
            w = down.rangeBetween(Window.unboundedPreceding, -1)
        elif kind == "back":
            w = up.rangeBetween(1 - arg, -1)
        elif kind == "ahead":
            w = up.rangeBetween(1, arg - 1)
        else:
            w = Window.partitionBy("key", _unit_start(F.col("block"), arg)).orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
        out[f"{n}_{kind}_{arg}"] = aggregates.added(used[n], {k: aggregates.COMBINE[o](F.col(k)).over(w) for k, o in plain[n].items()}, n)
    return seq.select("key", "block", "asked", *(c.alias(k) for k, c in out.items())).filter("asked").drop("asked")


def _nodes(blocked: DataFrame, asked: DataFrame, c: Cut, parts: dict[str, str], block: int, head: str) -> DataFrame | None:
    """By ``o_us`` what the whole blocks of an interval add up to, from a tree of block sums."""
    at = lambda m: _block(place(m), block) + F.lit(ORIGIN)
    high = at(c.high) if c.high else F.lit(1 << LEVELS).cast("bigint")
    if c.low:
        low = at(c.low) + 1
    elif c.middle is None:
        low = F.lit(None).cast("bigint")
    elif c.middle[1] == "unit":
        day = F.to_date(F.timestamp_micros(place(c.high)))
        low = _block(intervals.start_of(F.trunc(day, c.middle[2])), block) + F.lit(ORIGIN)
    else:
        low = F.lit(0).cast("bigint")
    if c.middle is None and c.low is None:  # one calendar day
        low = _block(intervals.start_of(F.to_date(F.timestamp_micros(place(c.high)))), block) + F.lit(ORIGIN)
    node = lambda level, i: F.array(F.struct(level.cast("int").alias("level"), i.cast("bigint").alias("node")))
    nowhere = F.array().cast("array<struct<level:int,node:bigint>>")

    def step(s: Column, level: Column) -> Column:
        a, b = s["a"], s["b"]
        own = F.concat(s["nodes"], F.when((a < b) & (a % 2 == 1), node(level, a)).otherwise(nowhere), F.when((a < b) & (b % 2 == 1), node(level, b - 1)).otherwise(nowhere))
        return F.struct(F.shiftright(a + 1, 1).alias("a"), F.shiftright(b, 1).alias("b"), own.alias("nodes"))

    levels = F.sequence(F.lit(0), F.lit(LEVELS))
    wanted = asked.select("o_us").distinct().select("o_us", F.explode(F.aggregate(levels, F.struct(low.alias("a"), high.alias("b"), nowhere.alias("nodes")), step, lambda s: s["nodes"])).alias("n")).select("o_us", "n.*")
    leaves = _sums(blocked, parts, "block").withColumn("leaf", F.col("block") + F.lit(ORIGIN))
    pieces: dict[str, tuple[str, str, Column]] = {}
    for n, op in parts.items():
        anchor = leaves.agg(F.avg(F.col(n)["m"])).scalar() if op == "moments" else None
        pieces |= {f"{n}_{k}": (n, o, x) for k, (x, o) in aggregates.addends(op, F.col(n), anchor).items()}
    spread = leaves.select("leaf", *(x.alias(k) for k, (_, _, x) in pieces.items())).withColumn("level", F.explode(levels)).withColumn("node", F.expr("shiftright(leaf, level)"))
    tree = spread.groupBy("level", "node").agg(*(aggregates.COMBINE[o](k).alias(k) for k, (_, o, _) in pieces.items()))
    summed = wanted.join(tree, ["level", "node"]).groupBy("o_us").agg(*(aggregates.COMBINE[o](k).alias(k) for k, (_, o, _) in pieces.items()))
    return summed.select("o_us", *(aggregates.added(op, {k: F.col(k) for k, (own, _, _) in pieces.items() if own == n}, n).alias(head + n) for n, op in parts.items()))


def previous(rows: DataFrame, value: str, by_value: bool, name: str) -> DataFrame:
    """Adds as ``name`` the place and value (``us, tie, v``) of the last row before with a ``value``, of the same ``key``, or of the same key and value. Looked for in
    the row's day, else in the last of earlier days that has one, so that a hot key spreads."""
    by = ["key", value] if by_value else ["key"]
    at = F.struct(F.col("us"), F.col("tie"), F.col(value).alias("v"))
    daily = rows.withColumn("_day", _block(F.col("us"), DAY_US))
    here = F.last(F.when(F.col(value).isNotNull(), at), True).over(Window.partitionBy(*by, "_day").orderBy("us", "tie").rowsBetween(Window.unboundedPreceding, -1))
    lasts = daily.filter(F.col(value).isNotNull()).groupBy(*by, "_day").agg(F.max(at).alias("_last"))
    days = daily.select(*by, "_day").distinct().join(lasts, [*by, "_day"], "left") if not by_value else lasts
    before = days.withColumn("_before", F.last("_last", True).over(Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)))
    found = daily.withColumn("_here", here).join(before.select(*by, "_day", "_before"), [*by, "_day"], "left")
    return found.withColumn(name, F.coalesce("_here", "_before")).drop("_here", "_before", "_day")
