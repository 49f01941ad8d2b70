"""Aggregates of the query language as Spark aggregate columns, usable in a grouping, and, if they add up, as parts.

``Rows`` has what an aggregate needs of the scanned rows: ``use`` (does the row count for this feature), the time and a tiebreak. A value is
null where the row isn't used, so that aggregates skip it; ``empty`` is the result without any row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from difflib import get_close_matches

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.fql.lexer import QueryError
from chronofold.functions.typed import BOOL, DATE, INT, LIST, NUM, NUMBERS, STR, TIME, Typed

DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Rows:
    use: Column
    us: Column
    time: Column
    tie: Column


@dataclass(frozen=True)
class Built:
    #: Over used rows; null or wrong on none.
    over: Column
    kind: str
    #: What it is where no row is used; a null column if None.
    empty: object = None
    type: T.DataType | None = None
    #: Puts the aggregated column into its final form, after a grouping.
    finish: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Aggregate:
    build: Callable[..., Built]
    arity: int = 1


def _used(r: Rows, x: Column) -> Column:
    return F.when(r.use, x)


def _order(r: Rows, x: Column) -> Column:
    return F.when(r.use & x.isNotNull(), F.struct(r.us, r.tie))


def _same(x: Typed, over: Column, **more: object) -> Built:
    return Built(over, x.kind, type=x.type, **more)


def _count(r: Rows, x: Typed | None) -> Built:
    return Built(F.count(F.when(r.use, F.lit(1)) if x is None else _used(r, x.col)), INT, 0)


def _numeric(f: Callable[[Column], Column], kind: str = NUM) -> Callable[[Rows, Typed], Built]:
    return lambda r, x: Built(f(_used(r, x.num("argument"))), kind)


def _bool(r: Rows, x: Typed) -> Column:
    return _used(r, x.need("argument", BOOL).cast("boolean"))


def _extreme(f: Callable[[Column], Column]) -> Callable[[Rows, Typed], Built]:
    def build(r: Rows, x: Typed) -> Built:
        if x.kind == BOOL:
            return Built(f(_used(r, x.num())), NUM)
        return _same(x, f(_used(r, x.need("argument", *NUMBERS, STR, DATE, TIME))))

    return build


def _spread(f: Callable[[Column], Column]) -> Callable[[Rows, Typed], Built]:
    """Sample variance and deviation; 0 for one value."""

    def build(r: Rows, x: Typed) -> Built:
        v = _used(r, x.num("argument"))
        return Built(F.struct(F.count(v).alias("n"), f(v).alias("s")), NUM, finish=lambda c: F.when(c["n"] == 1, F.lit(0.0)).otherwise(c["s"]))

    return build


def _at(f: Callable[[Column, Column], Column]) -> Callable[[Rows, Typed], Built]:
    return lambda r, x: _same(x, f(x.col, _order(r, x.col)))


def _collected(r: Rows, x: Column) -> Column:
    """All used non-null values with their place; to be sorted in the end."""
    return F.collect_list(F.when(r.use & x.isNotNull(), F.struct(r.us.alias("us"), r.tie.alias("tie"), x.alias("x"))))


def _in_order(c: Column) -> Column:
    return F.transform(F.sort_array(c), lambda s: s["x"])


def _nth(r: Rows, x: Typed, n: object) -> Built:
    if not isinstance(n, int) or isinstance(n, bool):
        raise QueryError("nth takes a whole number")
    return _same(x, _collected(r, x.col), finish=lambda c: F.try_element_at(_in_order(c), F.lit(n + 1 if n >= 0 else n)))


def _values(r: Rows, x: Typed) -> Built:
    number = x.kind in (*NUMBERS, BOOL)
    v = x.num() if number else x.col.cast("string")
    return Built(_collected(r, v), LIST, type=T.ArrayType(T.DoubleType() if number else T.StringType()), finish=lambda c: F.when(F.size(c) > 0, _in_order(c)))


def _time_of(f: Callable[[Column], Column]) -> Callable[[Rows, Typed], Built]:
    return lambda r, x: Built(f(F.when(_bool(r, x), r.time)), TIME)


def _days_between(r: Rows, x: Typed) -> Built:
    """Mean of the gaps between true events in whole days; null for fewer than two."""

    def finish(c: Column) -> Column:
        s = F.sort_array(c)
        n = F.size(s)
        gaps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.floor((F.try_element_at(s, i + 1) - F.try_element_at(s, i)) / F.lit(DAY_US)).cast("double"))
        return F.when(n >= 2, F.aggregate(gaps, F.lit(0.0), lambda a, b: a + b) / (n - 1))

    return Built(F.collect_list(F.when(_bool(r, x), r.us)), NUM, finish=finish)


def _arg(low: bool) -> Callable[[Rows, Typed], Built]:
    """Time of the extreme, the earliest of equal ones."""

    def build(r: Rows, x: Typed) -> Built:
        v = x.num("argument") if x.kind == BOOL else x.need("argument", *NUMBERS, STR, DATE, TIME)
        key = F.when(r.use & v.isNotNull(), F.struct(v, r.us if low else -r.us))
        return Built((F.min_by if low else F.max_by)(r.time, key), TIME)

    return build


def _run(r: Rows, x: Typed) -> Built:
    """Longest run of true in time order."""

    def finish(c: Column) -> Column:
        step = lambda a, b: F.struct(F.when(b, a["now"] + 1).otherwise(F.lit(0)).alias("now"), F.greatest(a["most"], F.when(b, a["now"] + 1).otherwise(F.lit(0))).alias("most"))
        return F.aggregate(_in_order(c), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"]).cast("bigint")

    return Built(_collected(r, x.need("argument", BOOL).cast("boolean")), INT, 0, finish=finish)


def _twice(pick: Callable[[Column], Column] | None) -> Callable[[Rows, Typed], Built]:
    """Does any value, or the extreme, occur more than once?"""

    def finish(c: Column) -> Column:
        if pick is None:
            return F.size(c) > F.size(F.array_distinct(c))
        return F.size(F.filter(c, lambda v: v == pick(c))) > 1

    return lambda r, x: Built(F.collect_list(_used(r, x.col)), BOOL, False, finish=lambda c: F.coalesce(finish(c), F.lit(False)))


def _changes(r: Rows, x: Typed) -> Built:
    def finish(c: Column) -> Column:
        s = _in_order(c)
        n = F.size(s)
        steps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.abs(F.try_element_at(s, i + 1) - F.try_element_at(s, i)))
        return F.when(n == 1, F.lit(0.0)).when(n > 1, F.aggregate(steps, F.lit(0.0), lambda a, b: a + b))

    return Built(_collected(r, x.num("argument")), NUM, finish=finish)


AGGREGATES: dict[str, Aggregate] = {
    "count": Aggregate(_count),
    "sum": Aggregate(_numeric(F.sum)),
    "product": Aggregate(_numeric(F.product)),
    "min": Aggregate(_extreme(F.min)),
    "max": Aggregate(_extreme(F.max)),
    "avg": Aggregate(_numeric(F.avg)),
    "median": Aggregate(_numeric(lambda v: F.percentile(v, F.lit(0.5)))),
    "var": Aggregate(_spread(F.var_samp)),
    "stdev": Aggregate(_spread(F.stddev_samp)),
    "first": Aggregate(_at(F.min_by)),
    "last": Aggregate(_at(F.max_by)),
    "nth": Aggregate(_nth, arity=2),
    "timeoflast": Aggregate(_time_of(F.max)),
    "timeoffirst": Aggregate(_time_of(F.min)),
    "timeofnext": Aggregate(_time_of(F.min)),
    "avgdaysbetween": Aggregate(_days_between),
    "values": Aggregate(_values),
    "argmax": Aggregate(_arg(False)),
    "argmin": Aggregate(_arg(True)),
    "mode": Aggregate(lambda r, x: _same(x, F.mode(_used(r, x.col), True))),
    "any": Aggregate(lambda r, x: Built(F.bool_or(_bool(r, x)), BOOL, False)),
    "all": Aggregate(lambda r, x: Built(F.bool_and(_bool(r, x)), BOOL, True)),
    "maxconsecutivetrue": Aggregate(_run),
    # beyond the ones a reference query can reach
    "nunique": Aggregate(lambda r, x: Built(F.count_distinct(_used(r, x.col)), INT, 0)),
    "kurtosis": Aggregate(_numeric(F.kurtosis)),
    "skewness": Aggregate(_numeric(F.skewness)),
    "hasduplicate": Aggregate(_twice(None)),
    "hasduplicatemin": Aggregate(_twice(F.array_min)),
    "hasduplicatemax": Aggregate(_twice(F.array_max)),
    "rootmeansquare": Aggregate(lambda r, x: Built(F.avg(_used(r, x.num() * x.num())), NUM, finish=F.sqrt)),
    "absenergy": Aggregate(_numeric(lambda v: F.sum(v * v))),
    "absolutesumofchanges": Aggregate(_changes),
    "approxmedian": Aggregate(_numeric(lambda v: F.percentile_approx(v, F.lit(0.5), F.lit(10_000)))),
}


def find(name: str) -> Aggregate:
    found = AGGREGATES.get(name)
    if found is None:
        near = get_close_matches(name, list(AGGREGATES), 1, 0.75)
        raise QueryError(f"unknown aggregate {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    return found


def finished(b: Built, col: Column) -> Column:
    out = b.finish(col) if b.finish else col
    return out if b.empty is None else F.coalesce(out, F.lit(b.empty))


def _sorted_values(r: Rows, x: Typed) -> Column:
    return F.collect_list(_used(r, x.num("argument")))


def _percentile(s: Column, share: float) -> Column:
    """Between the closest ranks of a sorted array, in proportion."""
    rank = (F.size(s) - 1) * F.lit(share)
    low = F.floor(rank).cast("int")
    a, b = F.try_element_at(s, low + 1), F.try_element_at(s, F.least(low + 2, F.size(s)))
    return a + (b - a) * (rank - low)


def _deviation(c: Column) -> Column:
    """Median of the distances from the median, scaled to agree with a normal deviation."""
    s = F.sort_array(c)
    return _percentile(F.sort_array(F.transform(s, lambda v: F.abs(v - _percentile(s, 0.5)))), 0.5) * F.lit(1.4826)


def _some(c: Column, value: Column) -> Column:
    return F.when(F.size(c) > 0, value)


AGGREGATES |= {
    "stdevpct": Aggregate(lambda r, x: Built(F.struct(F.count(_used(r, x.num())).alias("n"), F.stddev_samp(_used(r, x.num())).alias("s"), F.avg(_used(r, x.num())).alias("m")), NUM, finish=lambda c: F.when(c["n"] == 1, F.lit(0.0)).otherwise(c["s"] / F.nullif(c["m"], F.lit(0.0)) * 100))),
    "medianabsdev": Aggregate(lambda r, x: Built(_sorted_values(r, x), NUM, finish=lambda c: _some(c, _deviation(c)))),
    "medianabsdevpct": Aggregate(lambda r, x: Built(_sorted_values(r, x), NUM, finish=lambda c: _some(c, _deviation(c) / F.nullif(_percentile(F.sort_array(c), 0.5), F.lit(0.0)) * 100))),
    "quartiles": Aggregate(lambda r, x: Built(_sorted_values(r, x), LIST, type=T.ArrayType(T.DoubleType()), finish=lambda c: _some(c, F.array(*(_percentile(F.sort_array(c), q) for q in (0.25, 0.5, 0.75)))))),
    "iqr": Aggregate(lambda r, x: Built(_sorted_values(r, x), NUM, finish=lambda c: _some(c, _percentile(F.sort_array(c), 0.75) - _percentile(F.sort_array(c), 0.25)))),
    "percentile": Aggregate(lambda r, x, p: Built(_sorted_values(r, x), NUM, finish=lambda c: _some(c, _percentile(F.sort_array(c), float(p) / 100))), arity=2),
}


def _winsorized(r: Rows, x: Typed, p: object) -> Built:
    """The values in time order, those beyond the percentile p and its counterpart being set to these."""

    def finish(c: Column) -> Column:
        v = _in_order(c)
        s = F.sort_array(v)
        low, high = _percentile(s, float(p) / 100), _percentile(s, 1 - float(p) / 100)
        return _some(c, F.transform(v, lambda a: F.when(a > high, high).when(a < low, low).otherwise(a)))

    return Built(_collected(r, x.num("argument")), LIST, type=T.ArrayType(T.DoubleType()), finish=finish)


AGGREGATES["winsorize"] = Aggregate(_winsorized, arity=2)


@dataclass(frozen=True)
class Parts:
    """An aggregate as parts that add up: each a value per row and how values are combined; ``total`` makes the result of the combined parts."""

    values: tuple[tuple[Column, str], ...]
    total: Callable[..., Column]
    kind: str
    empty: object = None
    type: T.DataType | None = None


COMBINE: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max, "or": F.bool_or, "and": F.bool_and}
_BOTH: dict[str, Callable[[Column, Column], Column]] = {"sum": lambda a, b: a + b, "product": lambda a, b: a * b, "or": lambda a, b: a | b, "and": lambda a, b: a & b}


def gather(op: str, x: Column, over: Callable[[Column], Column] = lambda c: c) -> Column:
    """Aggregates a part of rows. Moments are count, mean and sum of squared distances from it, which no subtraction spoils."""
    if op != "moments":
        return over(COMBINE[op](x))
    n = over(F.count(x))
    return F.when(n > 0, F.struct(n.cast("double").alias("n"), over(F.avg(x)).alias("m"), (over(F.var_pop(x)) * n).alias("q")))


def addends(op: str, x: Column, anchor: Column | None) -> dict[str, tuple[Column, str]]:
    """A gathered part as columns that built-in aggregates combine; moments are taken around an anchor that is near the values."""
    if op != "moments":
        return {"": (x, op)}
    d = x["m"] - anchor
    return {"n": (x["n"], "sum"), "s": (x["n"] * d, "sum"), "q": (x["q"] + x["n"] * d * d, "sum"), "a": (anchor, "max")}


def added(op: str, found: dict[str, Column], head: str) -> Column:
    """The gathered part of combined ``addends``, named ``head_NAME``."""
    if op != "moments":
        return found[f"{head}_"]
    n, s, q, a = (found[f"{head}_{k}"] for k in "nsqa")
    return F.when(n > 0, F.struct(n.alias("n"), (a + s / n).alias("m"), F.greatest(q - s * s / n, F.lit(0.0)).alias("q")))


def merged(op: str, parts: list[Column]) -> Column:
    """Gathered parts of separate rows as one; null ones are of no row."""
    if len(parts) == 1:
        return parts[0]
    if op in ("min", "max"):
        return (F.least if op == "min" else F.greatest)(*parts)
    out = parts[0]
    for b in parts[1:]:
        a = out
        if op == "moments":
            n, d = a["n"] + b["n"], b["m"] - a["m"]
            both = F.struct(n.alias("n"), (a["m"] + d * b["n"] / n).alias("m"), (a["q"] + b["q"] + d * d * a["n"] * b["n"] / n).alias("q"))
            out = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)
        else:
            out = F.coalesce(_BOTH[op](a, b), a, b)
    return out


def _one(op: str, kind: str, value: Callable[[Rows, Typed], Column], empty: object = None) -> Callable[[Rows, Typed], Parts]:
    return lambda r, x: Parts(((value(r, x), op),), lambda a: a, kind, empty)


def _number(r: Rows, x: Typed) -> Column:
    return _used(r, x.num("argument"))


def _mean_parts(square: bool) -> Callable[[Rows, Typed], Parts]:
    def build(r: Rows, x: Typed) -> Parts:
        v = x.num("argument")
        v = _used(r, v * v if square else v)
        return Parts(((v, "sum"), (F.when(v.isNotNull(), F.lit(1)), "sum")), lambda s, n: F.sqrt(s / n) if square else s / n, NUM)

    return build


def _edge_parts(op: str) -> Callable[[Rows, Typed], Parts | None]:
    """The value at the first or last place."""

    def build(r: Rows, x: Typed) -> Parts | None:
        if x.kind in ("map", "struct", "list"):
            return None  # has no order
        placed = F.when(r.use & x.col.isNotNull(), F.struct(r.us.alias("us"), r.tie.alias("tie"), x.col.alias("x")))
        return Parts(((placed, op),), lambda s: s["x"], x.kind, type=x.type)

    return build


def _extreme_parts(op: str) -> Callable[[Rows, Typed], Parts]:
    def build(r: Rows, x: Typed) -> Parts:
        if x.kind == BOOL:
            return Parts(((_number(r, x), op),), lambda a: a, NUM)
        return Parts(((_used(r, x.need("argument", *NUMBERS, STR, DATE, TIME)), op),), lambda a: a, x.kind)

    return build


def _arg_parts(low: bool) -> Callable[[Rows, Typed], Parts]:
    def build(r: Rows, x: Typed) -> Parts:
        v = x.num("argument") if x.kind == BOOL else x.need("argument", *NUMBERS, STR, DATE, TIME)
        placed = F.when(r.use & v.isNotNull(), F.struct(v.alias("v"), (r.us if low else -r.us).alias("us"), r.time.alias("t")))
        return Parts(((placed, "min" if low else "max"),), lambda s: s["t"], TIME)

    return build


def _time_parts(op: str) -> Callable[[Rows, Typed], Parts]:
    return _one(op, TIME, lambda r, x: F.when(_bool(r, x), r.time))


def _moment_parts(total: Callable[[Column], Column]) -> Callable[[Rows, Typed], Parts]:
    return lambda r, x: Parts(((_number(r, x), "moments"),), lambda s: F.when(s["n"] == 1, F.lit(0.0)).otherwise(total(s)), NUM)


PARTS: dict[str, Callable[[Rows, Typed], Parts | None]] = {
    "var": _moment_parts(lambda s: s["q"] / (s["n"] - 1)),
    "stdev": _moment_parts(lambda s: F.sqrt(s["q"] / (s["n"] - 1))),
    "stdevpct": _moment_parts(lambda s: F.sqrt(s["q"] / (s["n"] - 1)) / F.nullif(s["m"], F.lit(0.0)) * 100),
    "count": lambda r, x: Parts(((F.when(r.use & (F.lit(True) if x is None else x.col.isNotNull()), F.lit(1)), "sum"),), lambda a: a.cast("bigint"), INT, 0),
    "sum": _one("sum", NUM, _number),
    "product": _one("product", NUM, _number),
    "min": _extreme_parts("min"),
    "max": _extreme_parts("max"),
    "avg": _mean_parts(False),
    "rootmeansquare": _mean_parts(True),
    "absenergy": _one("sum", NUM, lambda r, x: _used(r, x.num("argument") * x.num("argument"))),
    "first": _edge_parts("min"),
    "last": _edge_parts("max"),
    "timeoflast": _time_parts("max"),
    "timeoffirst": _time_parts("min"),
    "timeofnext": _time_parts("min"),
    "argmax": _arg_parts(False),
    "argmin": _arg_parts(True),
    "any": _one("or", BOOL, _bool, False),
    "all": _one("and", BOOL, _bool, True),
}


@dataclass(frozen=True)
class Lagged:
    """An aggregate that adds up once each used row knows the used one before it, of its entity or of its entity and value, whether or not that is in
    the interval: what the first row of the interval has from before it is known by its place and taken off."""

    #: Null where the row isn't used.
    value: Column
    by_value: bool
    #: Parts of a row from its value, its place (time and tiebreak) and the row before, of which null means none.
    parts: Callable[[Column, Column, Column], tuple[tuple[Column, str], ...]]
    #: The result from the parts and the low bound of the interval, None if open.
    total: Callable[..., Column]
    kind: str
    empty: object = None


_NEVER = 2**62


def _again(pick: str | None) -> Callable[[Rows, Typed], Lagged | None]:
    """A value, or the extreme, is there twice if it was there before, but not before the interval."""

    def build(r: Rows, x: Typed) -> Lagged | None:
        if x.kind in ("map", "struct", "list"):
            return None  # can't be compared
        was = lambda before: F.coalesce(before["us"], F.lit(-_NEVER))
        sign = -1 if pick == "min" else 1
        parts = lambda v, _, before: ((F.when(v.isNotNull(), was(before) if pick is None else F.struct(v.alias("v"), (was(before) * sign).alias("was"))), pick or "max"),)

        def total(a: Column, low: Column | None) -> Column:
            last = a if pick is None else a["was"] * sign
            return last > -_NEVER if low is None else last >= low

        return Lagged(_used(r, x.col), True, parts, total, BOOL, False)

    return build


def _steps(step: Callable[[Column, Column, Column], Column], value: Callable[[Rows, Typed], Column], total: Callable[[Column, Column], Column]) -> Callable[[Rows, Typed], Lagged]:
    """Steps from each row to the next; the one into the interval's first row is taken off."""

    def parts(v: Column, place: Column, before: Column) -> tuple[tuple[Column, str], ...]:
        d = F.when(v.isNotNull(), F.coalesce(step(v, place, before), F.lit(0.0)))
        first = F.when(v.isNotNull(), F.struct(place["us"].alias("us"), place["tie"].alias("tie"), d.alias("d")))
        return (d, "sum"), (first, "min"), (F.when(v.isNotNull(), F.lit(1)), "sum")

    return lambda r, x: Lagged(value(r, x), False, parts, lambda all_, first, n, low: total(F.when(n > 1, all_ - first["d"]).otherwise(F.lit(0.0)), n), NUM)


LAGGED: dict[str, Callable[[Rows, Typed], Lagged | None]] = {
    "hasduplicate": _again(None),
    "hasduplicatemin": _again("min"),
    "hasduplicatemax": _again("max"),
    "absolutesumofchanges": _steps(lambda v, _, before: F.abs(v - before["v"]), _number, lambda total, n: F.when(n > 0, total)),
    "avgdaysbetween": _steps(lambda _, place, before: F.floor((place["us"] - before["us"]) / F.lit(DAY_US)).cast("double"), lambda r, x: F.when(_bool(r, x), F.lit(True)), lambda total, n: F.when(n > 1, total / (n - 1))),
}
