"""Interval bounds in microseconds since 1970, as columns of an observation.

Bounds are half open: without the observation's own time ``low <= t < high``, with it ``low < t <= high``; a null bound is open.
Calendar intervals end at 23:59:59 of their last day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.fql.nodes import Between, Calendar, Interval, Sessions, Span, Star, Whole
from chronofold.functions.typed import DATE, NULL, STR, TIME, Typed

DAY_US = 86_400_000_000
_LAST_SECOND = DAY_US - 1_000_000


def start_of(day: Column) -> Column:
    return F.unix_date(day).cast("bigint") * F.lit(DAY_US)


def end_of(day: Column) -> Column:
    return start_of(day) + F.lit(_LAST_SECOND)


def _days(low: Column, high: Column | None = None) -> tuple[Column, Column]:
    return start_of(low), end_of(low if high is None else high)


def _period(unit: str, months: int, offset: int) -> Callable[[Column], tuple[Column, Column]]:
    """A whole calendar period, ``offset`` periods away."""

    def build(d: Column) -> tuple[Column, Column]:
        first = F.add_months(F.trunc(d, unit), months * offset)
        return _days(first, F.date_sub(F.add_months(first, months), 1))

    return build


def _week(offset: int) -> Callable[[Column], tuple[Column, Column]]:
    def build(d: Column) -> tuple[Column, Column]:
        monday = F.date_add(F.trunc(d, "week"), 7 * offset)
        return _days(monday, F.date_add(monday, 6))

    return build


def _next_work_day(d: Column) -> tuple[Column, Column]:
    w = F.weekday(d)  # Monday 0
    return _days(F.date_add(d, F.when(w == 4, 3).when(w == 5, 2).otherwise(1)))


def _last_work_day(d: Column) -> tuple[Column, Column]:
    w = F.weekday(d)
    return _days(F.date_sub(d, F.when(w == 0, 3).when(w == 6, 2).otherwise(1)))


def _shift(days: int) -> Callable[[Column], tuple[Column, Column]]:
    return lambda d: _days(F.date_add(d, days))


_CALENDAR: dict[str, Callable[[Column], tuple[Column, Column]]] = {
    "yesterday": _shift(-1),
    "tomorrow": _shift(1),
    "lastweek": _week(-1),
    "nextweek": _week(1),
    "lastmonth": _period("month", 1, -1),
    "nextmonth": _period("month", 1, 1),
    "lastquarter": _period("quarter", 3, -1),
    "nextquarter": _period("quarter", 3, 1),
    "lastyear": _period("year", 12, -1),
    "nextyear": _period("year", 12, 1),
    "samedaylastweek": _shift(-7),
    "samedaynextweek": _shift(7),
    "samedaylastmonth": _shift(-30),
    "samedaynextmonth": _shift(30),
    "samedaylastyear": lambda d: _days(F.add_months(d, -12)),
    "samedaynextyear": lambda d: _days(F.add_months(d, 12)),
    "nextworkday": _next_work_day,
    "nextbusinessday": _next_work_day,
    "previousworkday": _last_work_day,
    "previousbusinessday": _last_work_day,
}
_TO_DATE = {"ytd": "year", "mtd": "month", "wtd": "week"}


def to_date(keyword: str) -> bool:
    """Does the interval end with the observation?"""
    return keyword in _TO_DATE


def unit_of(keyword: str) -> str:
    """The calendar unit whose start is the start of the interval, and in one of which the interval lies."""
    if unit := _TO_DATE.get(keyword):
        return unit
    return next((u for u in ("week", "month", "quarter", "year") if keyword in (f"last{u}", f"next{u}")), "day")


def _bound(x: Typed, high: bool) -> Column | None:
    """A date is its first or last second; texts and nulls are open."""
    if x.kind == DATE:
        return end_of(x.col) if high else start_of(x.col)
    if x.kind == TIME:
        return F.unix_micros(x.col.cast("timestamp"))
    if x.kind in (NULL, STR):
        return None
    raise ValueError(f"a bound must be a date or a time, not {x.kind}")


def bounds(interval: Interval, obs_us: Column, obs_dt: Column, bind: Callable[[object], Typed]) -> tuple[Column | None, Column | None]:
    """Low and high; None is open. ``bind`` binds scalar expressions of the observation."""
    if isinstance(interval, Whole):
        return (None, obs_us) if interval.past else (obs_us, None)
    if isinstance(interval, Sessions):
        return F.col(interval.column), obs_us
    if isinstance(interval, Span):
        return (obs_us - interval.micros, obs_us) if interval.past else (obs_us, obs_us + interval.micros)
    d = obs_dt.cast("date")
    if isinstance(interval, Calendar):
        if unit := _TO_DATE.get(interval.keyword):
            return start_of(F.trunc(d, unit)), obs_us
        return _CALENDAR[interval.keyword](d)
    if isinstance(interval, Between):
        return tuple(None if isinstance(x, Star) else _bound(bind(x), high) for x, high in ((interval.low, False), (interval.high, True)))
    raise TypeError(interval)


def inside(us: Column, low: Column | None, high: Column | None, inclusive: bool) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (F.coalesce(us > low, F.lit(True)) if inclusive else F.coalesce(us >= low, F.lit(True)))
    if high is not None:
        out = out & (F.coalesce(us <= high, F.lit(True)) if inclusive else F.coalesce(us < high, F.lit(True)))
    return out
