"""Scalar functions: name without underscores -> (numbers of arguments, build). Unknown values give unknown results."""

from __future__ import annotations

from collections.abc import Callable
from difflib import get_close_matches

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.fql.lexer import QueryError
from chronofold.functions.typed import BOOL, DATE, INT, LIST, NULL, NUM, NUMBERS, STR, TIME, Typed
from pyspark.sql import types as T

_INF, _NAN = float("inf"), float("nan")
#: Fixed value: numbers closer than the epsilon of single precision are equal.
EPSILON = 1.1920929e-7


def num(col: Column) -> Typed:
    return Typed(col.cast("double"), NUM)


def _log(log: Callable[[Column], Column], bound: float = 0.0) -> Callable[[Typed], Typed]:
    """Logarithms give -infinity at ``bound`` and NaN below."""

    def build(x: Typed) -> Typed:
        v = x.num()
        return num(F.when(v > bound, log(v)).when(v == bound, F.lit(-_INF)).when(v.isNotNull(), F.lit(_NAN)))

    return build


def _math(f: Callable[[Column], Column]) -> Callable[[Typed], Typed]:
    return lambda x: num(f(x.num()))


def _trunc(v: Column) -> Column:
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("double")


def divide(a: Column, b: Column) -> Column:
    """Division by zero gives infinity or NaN."""
    zero = F.when(a > 0, F.lit(_INF)).when(a < 0, F.lit(-_INF)).otherwise(F.lit(_NAN))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def _rem_euclid(a: Typed, b: Typed) -> Typed:
    x, m = a.num(), F.abs(b.num())
    return num(F.when(m == 0, F.lit(_NAN)).otherwise(F.pmod(x, F.when(m != 0, m))))


def _div_euclid(a: Typed, b: Typed) -> Typed:
    x, y = a.num(), b.num()
    return num(divide(x - F.pmod(x, F.abs(F.when(y != 0, y))), y))


def _clamp(x: Typed, low: Typed, high: Typed) -> Typed:
    v, a, b = x.num(), low.num(), high.num()
    return num(F.when(v.isNotNull() & a.isNotNull() & b.isNotNull(), F.least(F.greatest(v, a), b)))


def common_kind(a: Typed, b: Typed, what: str) -> str:
    if NULL in (a.kind, b.kind):
        return a.kind if b.kind == NULL else b.kind
    if a.kind == b.kind:
        return a.kind
    if a.kind in NUMBERS and b.kind in NUMBERS:
        return NUM
    if {a.kind, b.kind} == {DATE, TIME}:
        return TIME
    raise QueryError(f"{what} of {a.kind} and {b.kind}")


def as_kind(x: Typed, kind: str) -> Column:
    to = {NUM: "double", INT: "bigint", STR: "string", BOOL: "boolean", DATE: "date", TIME: "timestamp_ntz"}.get(kind)
    return x.col.cast(to) if to else x.col


def _if(c: Typed, a: Typed, b: Typed) -> Typed:
    kind = common_kind(a, b, "if")
    test = c.need("condition", BOOL)
    return Typed(F.when(test, as_kind(a, kind)).when(~test, as_kind(b, kind)), kind, a.type or b.type)


def _coalesce(a: Typed, b: Typed) -> Typed:
    kind = common_kind(a, b, "coalesce")
    return Typed(F.coalesce(as_kind(a, kind), as_kind(b, kind)), kind, a.type or b.type)


def _text(f: Callable[..., Column], kind: str = STR) -> Callable[..., Typed]:
    return lambda *xs: Typed(f(*(x.need("text", STR) for x in xs)), kind)


def _substr(s: Typed, start: Typed, length: Typed) -> Typed:
    """From 0; null if it reaches out of the text."""
    t, a, n = s.need("text", STR), start.need("start", *NUMBERS).cast("int"), length.need("length", *NUMBERS).cast("int")
    return Typed(F.when((a >= 0) & (n >= 0) & (a + n <= F.length(t)), F.substring(t, a + 1, n)), STR)


def _date(x: Typed) -> Typed:
    if x.kind == STR:
        t = x.col
        return Typed(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")), DATE)
    return Typed(x.need("date", DATE, TIME).cast("date"), DATE)


def parse_time(t: Column) -> Column:
    """Zone-free times: date and time with T or blank, seconds and fractions optional, or a date alone (midnight); others are null."""
    whole = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2}(?:\.\d{1,9})?)?)?$"
    day, minute, second = (F.regexp_extract(t, whole, i) for i in (1, 2, 3))
    text = F.concat(day, F.lit(" "), F.when(minute == "", F.lit("00:00")).otherwise(minute), F.when(second == "", F.lit(":00")).otherwise(second))
    return F.when(t.rlike(whole), text.try_cast("timestamp_ntz"))


def _day(x: Typed) -> Column:
    return parse_time(x.col).cast("date") if x.kind == STR else x.need("date", DATE, TIME).cast("date")


def _of_day(f: Callable[[Column], Column], kind: str = INT) -> Callable[[Typed], Typed]:
    return lambda x: Typed(f(_day(x)).cast("bigint") if kind == INT else f(_day(x)), kind)


def _of_time(f: Callable[[Column], Column]) -> Callable[[Typed], Typed]:
    return lambda x: Typed(f(x.need("time", TIME)).cast("bigint"), INT)


_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth}


def _part(part: Typed, x: Typed) -> Typed:
    d, p = _day(x), F.lower(part.need("part", STR))
    out = F.lit(None).cast("bigint")
    for name, f in _PARTS.items():
        out = F.when(p == name, f(d).cast("bigint")).otherwise(out)
    return Typed(out, INT)


#: Strftime codes and Spark's letters for them.
_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%%": "%"}


def java_format(strftime: str) -> str:
    out, i = "", 0
    while i < len(strftime):
        if strftime[i] == "%":
            code = strftime[i : i + 2]
            if code not in _STRFTIME:
                raise QueryError(f"unknown code {code!r} in a date format")
            out, i = out + _STRFTIME[code], i + 2
        else:
            c = strftime[i]
            out, i = out + (f"'{c}'" if c.isalpha() else "''" if c == "'" else c), i + 1
    return out


def _trim(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


FUNCTIONS: dict[str, tuple[tuple[int, ...], Callable[..., Typed]]] = {
    "floor": ((1,), _math(F.floor)),
    "ceil": ((1,), _math(F.ceil)),
    "round": ((1,), _math(lambda v: F.round(v, 0))),
    "trunc": ((1,), _math(_trunc)),
    "fract": ((1,), _math(lambda v: v - _trunc(v))),
    "abs": ((1,), _math(F.abs)),
    "signum": ((1,), _math(lambda v: F.when(v >= 0, F.lit(1.0)).when(v < 0, F.lit(-1.0)))),
    "diveuclid": ((2,), _div_euclid),
    "remeuclid": ((2,), _rem_euclid),
    "powf": ((2,), lambda a, b: num(F.pow(a.num(), b.num()))),
    "sqrt": ((1,), _math(F.sqrt)),
    "exp": ((1,), _math(F.exp)),
    "exp2": ((1,), _math(lambda v: F.pow(F.lit(2.0), v))),
    "ln": ((1,), _log(F.ln)),
    "log": ((2,), lambda x, b: num(divide(_log(F.ln)(x).col, _log(F.ln)(b).col))),
    "log2": ((1,), _log(F.log2)),
    "log10": ((1,), _log(F.log10)),
    "sin": ((1,), _math(F.sin)),
    "cos": ((1,), _math(F.cos)),
    "tan": ((1,), _math(F.tan)),
    "asin": ((1,), _math(F.asin)),
    "acos": ((1,), _math(F.acos)),
    "atan": ((1,), _math(F.atan)),
    "expm1": ((1,), _math(F.expm1)),
    "ln1p": ((1,), _log(F.log1p, -1.0)),
    "sinh": ((1,), _math(F.sinh)),
    "cosh": ((1,), _math(F.cosh)),
    "tanh": ((1,), _math(F.tanh)),
    "asinh": ((1,), _math(F.asinh)),
    "acosh": ((1,), _math(F.acosh)),
    "atanh": ((1,), _math(F.atanh)),
    "clamp": ((3,), _clamp),
    "if": ((3,), _if),
    "coalesce": ((2,), _coalesce),
    "len": ((1,), _text(lambda t: F.octet_length(t).cast("bigint"), INT)),
    "trim": ((1,), _text(_trim)),
    "lower": ((1,), _text(F.lower)),
    "upper": ((1,), _text(F.upper)),
    "concat": ((2,), _text(F.concat)),
    "contains": ((2,), _text(F.contains, BOOL)),
    "startswith": ((2,), _text(F.startswith, BOOL)),
    "endswith": ((2,), _text(F.endswith, BOOL)),
    "substr": ((3,), _substr),
    "replace": ((3,), _text(F.replace)),
    "regexmatch": ((2,), _text(F.regexp_like, BOOL)),
    "regexextract": ((2,), _text(lambda t, p: F.regexp_substr(t, p))),
    "regexreplace": ((3,), _text(F.regexp_replace)),
    "regexsplit": ((2,), lambda t, p: Typed(F.split(t.need("text", STR), p.need("pattern", STR)), LIST, T.ArrayType(T.StringType()))),
    "regexcount": ((2,), _text(lambda t, p: F.regexp_count(t, p).cast("bigint"), INT)),
    "date": ((1,), _date),
    "dateadd": ((2,), lambda d, n: Typed(F.date_add(_day(d), n.need("days", *NUMBERS).cast("int")), DATE)),
    "datesub": ((2,), lambda d, n: Typed(F.date_sub(_day(d), n.need("days", *NUMBERS).cast("int")), DATE)),
    "datediff": ((2,), lambda a, b: Typed(F.date_diff(_day(a), _day(b)).cast("bigint"), INT)),
    "year": ((1,), _of_day(F.year)),
    "month": ((1,), _of_day(F.month)),
    "day": ((1,), _of_day(F.dayofmonth)),
    "week": ((1,), _of_day(F.weekofyear)),
    "weekday": ((1,), _of_day(lambda d: F.weekday(d) + 1)),
    "dayofyear": ((1,), _of_day(F.dayofyear)),
    "quarter": ((1,), _of_day(F.quarter)),
    "isstartofmonth": ((1,), _of_day(lambda d: F.dayofmonth(d) == 1, BOOL)),
    "isendofmonth": ((1,), _of_day(lambda d: F.last_day(d) == d, BOOL)),
    "isweekend": ((1,), _of_day(lambda d: F.weekday(d) >= 5, BOOL)),
    "hour": ((1,), _of_time(F.hour)),
    "minute": ((1,), _of_time(F.minute)),
    "second": ((1,), _of_time(F.second)),
    "microsecond": ((1,), _of_time(lambda t: F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(1_000_000)))),
    "datepart": ((2,), _part),
    "extract": ((2,), _part),
    "now": ((0,), lambda: Typed(F.localtimestamp(), TIME)),
    "currentdate": ((0,), lambda: Typed(F.current_date(), DATE)),
    "currenttime": ((0,), lambda: Typed(F.date_format(F.localtimestamp(), "HH:mm:ss"), STR)),
}
_FORMAT = "formatdate"


def call(name: str, args: list[Typed], literals: list[object]) -> Typed:
    """``literals``: the value of each argument that is one, else None."""
    if name == _FORMAT:
        if len(args) != 2 or not isinstance(literals[0], str):
            raise QueryError("format_date takes a format and a date")
        return Typed(F.date_format(args[1].need("date", DATE, TIME).cast("timestamp_ntz"), java_format(literals[0])), STR)
    found = FUNCTIONS.get(name)
    if found is None:
        near = get_close_matches(name, [*FUNCTIONS, _FORMAT], 1, 0.75)
        raise QueryError(f"unknown function {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    if len(args) not in found[0]:
        raise QueryError(f"{name} takes {' or '.join(map(str, found[0]))} arguments, not {len(args)}")
    return found[1](*args)


def equal(a: Typed, b: Typed) -> Column:
    """Never null: nothing equals null, not even null."""
    kind = common_kind(a, b, "comparison")
    if NULL in (a.kind, b.kind):
        return F.lit(False)
    if kind in NUMBERS:
        if a.kind == b.kind == INT:
            return F.coalesce(a.col == b.col, F.lit(False))
        x, y = a.num(), b.num()
        return F.coalesce((F.abs(x - y) < EPSILON) | ((x == y) & ~F.isnan(x)), F.lit(False))
    return F.coalesce(as_kind(a, kind) == as_kind(b, kind), F.lit(False))


def binary(op: str, a: Typed, b: Typed) -> Typed:
    if op in ("and", "or"):
        x, y = a.need(op, BOOL).cast("boolean"), b.need(op, BOOL).cast("boolean")
        return Typed(F.when(x.isNull() | y.isNull(), F.lit(False)).otherwise(x & y if op == "and" else x | y), BOOL)
    if op == "=":
        return Typed(equal(a, b), BOOL)
    if op == "!=":
        return Typed(~equal(a, b), BOOL)
    if op in ("<", "<=", ">", ">="):
        kind = common_kind(a, b, "comparison")
        if kind not in (*NUMBERS, DATE, TIME, NULL):
            raise QueryError(f"{op} of {a.kind} and {b.kind}")
        x, y = (as_kind(v, kind) for v in (a, b))
        test = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if kind == NUM:
            test = test & ~F.isnan(x) & ~F.isnan(y)
        return Typed(F.coalesce(test, F.lit(False)), BOOL)
    x, y = a.num(op), b.num(op)
    return num({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: divide(x, y), "^": lambda: F.pow(x, y)}[op]())


def inside(value: Typed, options: tuple, negated: bool) -> Typed:
    """A null is in nothing."""
    kinds = {type(o) for o in options}
    if not (len(kinds) == 1 or kinds <= {int, float}):
        raise QueryError("the options of in must be of one type")
    if kinds <= {int, float} and not bool in kinds:
        found = F.lit(False)
        v = value.num("in")
        for o in options:
            found = found | (F.abs(v - float(o)) < EPSILON)
    else:
        found = value.need("in", BOOL if bool in kinds else STR).isin(list(options))
    found = F.coalesce(found, F.lit(False))
    return Typed(~found if negated else found, BOOL)
