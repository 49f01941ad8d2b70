"""Mixed timestamp texts to one UTC instant.

Every text is expanded into the array of its valid interpretations (format, instant, cost of breaking a declared rule of
its source), and one of them is chosen by a Viterbi pass over each source's record order that penalises rules broken, backward
jumps in time, the longer the more up to a week, and format switches. The pass works on bounded blocks of records: each block is summed up as
a min-plus transfer matrix between the readings of its first and its last record. Min-plus products can be put together in any grouping, so the
matrices are multiplied level by level, in groups of bounded size, up to one per source; the cheapest ends are then fixed at the top
and pushed down level by level, and each block is traced back between its fixed ends. The result is that of one pass over the whole
source. Steps between two records of one reading each cost the same whatever is chosen and are left out.

A record's choice saves at most the cost of its two steps, 6, so a declared rule, which costs 1000 to break, always holds where a reading
keeps it; the steps choose between readings that keep the rules, or all of them where the source declares no day order.

Defined cases: null, blank and unreadable texts, impossible dates and times, and texts of which every reading breaks a declared
rule have no interpretation and no row in the result of ``normalise``; a null ``zone`` is read as UTC; where ``day_first`` is
null both orders of a slash date are equal to start with; repeated records are resolved one by one; ties go to the first
interpretation in the array.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs of breaking a declared rule of the source, of a jump back by a week or more, and of a format switch.
RULE, BACKWARD, SWITCH = 1000.0, 2.0, 1.0
FULL_JUMP_US = 7 * 86_400_000_000
#: Bits of the block number that are dropped from level to level of the tree of blocks.
LEVELS = (16, 31)

# Month names by their first three letters.
_MONTHS = {m.lower(): i for i, m in enumerate(calendar.month_abbr) if m}
_TIME = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp]\.?[Mm]\.?)(?![A-Za-z]))?"
_ZONE = r"\s*(?P<off>[Zz]|[+-]\d{2}(?::?\d{2})?)?\s*(?:\[?(?P<zone>[A-Za-z][A-Za-z0-9_+\-]*(?:/[A-Za-z0-9_+\-]+)*)\]?)?"
_WHEN = rf"(?:(?:[Tt]|,?\s+){_TIME}{_ZONE})?"
_FORMS = [
    ("iso", re.compile(rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}}){_WHEN}")),
    ("basic", re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[Tt](?P<H>\d{{2}})(?P<M>\d{{2}})(?P<S>\d{{2}})?(?:[.,](?P<f>\d+))?{_ZONE}")),
    ("slash_year", re.compile(rf"(?P<y>\d{{4}})/(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}}){_WHEN}")),
    ("slash", re.compile(rf"(?P<a>\d{{1,2}})/(?P<b>\d{{1,2}})/(?P<y>\d{{4}}){_WHEN}")),
    ("dots", re.compile(rf"(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<y>\d{{4}}){_WHEN}")),
    ("day_name", re.compile(rf"(?:[A-Za-z]{{3,9}},?\s+)?(?P<d>\d{{1,2}})[ -](?P<mon>[A-Za-z]{{3,9}})\.?,?[ -](?P<y>\d{{4}}){_WHEN}")),
    ("name_day", re.compile(rf"(?:[A-Za-z]{{3,9}},\s+)?(?P<mon>[A-Za-z]{{3,9}})\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}){_WHEN}")),
]
_NUMBER = re.compile(r"(\d{9,17})(?:\.(\d+))?")
_EPOCH = datetime(1970, 1, 1)


@lru_cache(4096)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None


@lru_cache(65536)
def _abbreviation(abbr: str, zone: str) -> timedelta | None:
    """The offset an abbreviation stands for in a zone: that of the last instant known by it there."""
    if abbr.upper() in ("UTC", "GMT", "Z", "UT"):
        return timedelta(0)
    tz = _zone(zone)
    if tz is None:
        return None
    for year in range(2037, 1969, -1):
        for month in range(12, 0, -1):
            at = datetime(year, month, 15, tzinfo=tz)
            if at.tzname() == abbr:
                return at.utcoffset()
    return None


def _us(at: datetime) -> int:
    d = at - _EPOCH
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def _offset(text: str) -> timedelta | None:
    if text in "Zz":
        return timedelta(0)
    digits = text[1:].replace(":", "")
    h, m = int(digits[:2]), int(digits[2:] or 0)
    if h > 18 or m > 59:
        return None
    return timedelta(hours=h, minutes=m) * (-1 if text[0] == "-" else 1)


def interpretations(text: str | None, zone: str | None, day_first: bool | None) -> list[tuple[str, int, float]]:
    """All valid readings of a text: (format, microseconds since 1970 UTC, cost of breaking the source's rules). None if all break a rule."""
    if text is None or not (text := text.strip()):
        return []
    if m := _NUMBER.fullmatch(text):
        digits, frac = m[1], m[2]
        if len(digits) <= 11:
            return [("unix_s", int(digits) * 1_000_000 + int(((frac or "") + "000000")[:6]), 0.0)]
        if len(digits) <= 14:
            return [("unix_ms", int(digits) * 1000 + int(((frac or "") + "000")[:3]), 0.0)]
        return [("unix_us", int(digits), 0.0)]
    out: list[tuple[str, int, float]] = []
    for form, pattern in _FORMS:
        if not (m := pattern.fullmatch(text)):
            continue
        g = m.groupdict()
        year = int(g["y"])
        if form == "slash":
            a, b = int(g["a"]), int(g["b"])
            orders = [("slash_dmy", a, b, RULE if day_first is False else 0.0), ("slash_mdy", b, a, RULE if day_first is True else 0.0)]
        elif "mon" in g:
            if not (month := _MONTHS.get(g["mon"][:3].lower())):
                continue
            orders = [(form, int(g["d"]), month, 0.0)]
        else:
            orders = [(form, int(g["d"]), int(g["m"]), 0.0)]
        for name, day, month, cost in orders:
            out += _instants(name, year, month, day, g, zone or "UTC", cost)
        break
    return list(dict.fromkeys(out)) if any(x[2] < RULE for x in out) else []


def _instants(form: str, year: int, month: int, day: int, g: dict, zone: str, cost: float) -> list[tuple[str, int, float]]:
    h, mi, s = int(g.get("H") or 0), int(g.get("M") or 0), int(g.get("S") or 0)
    if ap := g.get("ap"):
        if not 1 <= h <= 12:
            return []
        h = h % 12 + 12 * (ap[0] in "Pp")
    try:
        wall = datetime(year, month, day, h, mi, s, int(((g.get("f") or "") + "000000")[:6]))
    except ValueError:
        return []
    if off := g.get("off"):
        delta = _offset(off)
        return [(form + "_offset", _us(wall) - int(delta.total_seconds()) * 1_000_000, cost)] if delta is not None else []
    form += "_hm" if g.get("H") and not g.get("S") else "_day" if not g.get("H") else ""
    if named := g.get("zone"):
        tz = _zone(named) if "/" in named or named.upper() == "UTC" else None
        if tz is None:
            delta = _abbreviation(named, zone)
            return [(form + "_name", _us(wall) - int(delta.total_seconds()) * 1_000_000, cost)] if delta is not None else []
        form += "_zone"
    elif (tz := _zone(zone)) is None:
        return []
    try:
        early, late = (int(wall.replace(tzinfo=tz, fold=x).utcoffset().total_seconds()) * 1_000_000 for x in (0, 1))
    except OverflowError:
        return []
    if early > late:  # the wall time occurs twice: the rule prefers the earlier instant
        return [(form, _us(wall) - early, cost), (form, _us(wall) - late, cost + RULE)]
    return [(form, _us(wall) - early, cost)]  # once, or skipped: the offset before the skip


def step_cost(a: tuple[str, int, float], b: tuple[str, int, float]) -> float:
    return SWITCH * (a[0] != b[0]) + BACKWARD * min(max(a[1] - b[1], 0) / FULL_JUMP_US, 1.0)


Block = list[list[tuple[str, int, float]]]


def reduced(block: Block) -> list[int]:
    """Places of a block that the choice depends on: its ends, records of several readings, and their neighbours."""
    n = len(block)
    return sorted({0, n - 1} | {j for i, x in enumerate(block) if len(x) > 1 for j in (i - 1, i, i + 1) if 0 <= j < n})


def transfer(block: Block) -> tuple[np.ndarray, list[np.ndarray]]:
    """Least cost from each reading of a block's first record to each of its last, and the back-pointers per place (see ``reduced``)."""
    at = reduced(block)
    costs = np.full((len(block[0]), len(block[0])), np.inf)
    np.fill_diagonal(costs, [x[2] for x in block[0]])
    back = []
    for i, j in zip(at, at[1:]):
        before, now = block[i], block[j]
        if len(before) == len(now) == 1:  # the cost of a step without a choice, or of the left out ones between
            back.append(np.zeros((len(costs), 1), int))
            continue
        step = np.array([[step_cost(a, b) + b[2] for b in now] for a in before])
        through = costs[:, :, None] + step[None, :, :]
        back.append(through.argmin(axis=1))
        costs = through.min(axis=1)
    return costs, back


def trace(block: Block, back: list[np.ndarray], first: int, last: int) -> list[int]:
    """The readings chosen in a block whose first and last ones are given."""
    at = reduced(block)
    chosen = [0] * len(block)
    chosen[at[-1]] = last
    for k in range(len(back) - 1, -1, -1):
        chosen[at[k]] = last = int(back[k][first, last])
    return chosen


Sum = tuple[list, list, np.ndarray]


def product(sums: list[Sum]) -> Sum:
    """Consecutive (first readings, last readings, transfer matrix) as one."""
    firsts, lasts, whole = sums[0]
    for to, end, matrix in sums[1:]:
        step = np.array([[step_cost(a, b) for b in to] for a in lasts])
        if whole.size == step.size == matrix.size == 1:
            whole = whole + step + matrix
        else:
            whole = (whole[:, :, None] + step[None]).min(axis=1)
            whole = (whole[:, :, None] + matrix[None]).min(axis=1)
        lasts = end
    return firsts, lasts, whole


def chain(blocks: list[Sum], ends: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """Chosen first and last readings of each of consecutive blocks, the outermost ones being given or free."""
    best, path = None, []
    for i, (firsts, lasts, matrix) in enumerate(blocks):
        if i == 0:
            enter, came = np.zeros(len(firsts)), np.zeros(len(firsts), int)
            if ends is not None:
                enter[:] = np.inf
                enter[ends[0]] = 0.0
        else:
            step = best[:, None] + np.array([[step_cost(a, b) for b in firsts] for a in blocks[i - 1][1]])
            enter, came = step.min(axis=0), step.argmin(axis=0)
        total = enter[:, None] + matrix
        best = total.min(axis=0)
        path.append((came, total.argmin(axis=0)))
    out, last = [], int(best.argmin()) if ends is None else ends[1]
    for came, first_of in reversed(path):
        first = int(first_of[last])
        out.append((first, last))
        last = int(came[first])
    return out[::-1]


_READINGS = "forms array<string>, us array<bigint>, costs array<double>"
_PLACE = "record_table string, record_id bigint, source bigint, block bigint, pos bigint"


def _columns(found: list[Block]) -> list[pa.Array]:
    types = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64()))
    return [pa.array([[x[k] for x in own] for own in found], t) for k, t in enumerate(types)]


def _interpret(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, zone, first = (batch.column(i).to_pylist() for i in (5, 6, 7))
        found = [interpretations(*x) for x in zip(text, zone, first)]
        keep = pa.array([i for i, x in enumerate(found) if x], pa.int64())
        kept = batch.select(list(range(5))).take(keep)
        yield pa.RecordBatch.from_arrays([*kept.columns, *_columns([x for x in found if x])], names=[*kept.schema.names, "forms", "us", "costs"])


def _blocks(batches: Iterator[pa.RecordBatch], extra: tuple[str, ...] = ()) -> Iterator[tuple[tuple, list[int], Block, tuple]]:
    """The blocks of a partition that is sorted by block: key, record ids, readings, and the first values of the extra columns."""
    key, ids, block, more = None, [], [], ()
    for batch in batches:
        col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for i, now in enumerate(zip(col["record_table"], col["source"], col["block"])):
            if now != key:
                if block:
                    yield key, ids, block, more
                key, ids, block, more = now, [], [], tuple(col[x][i] for x in extra)
            ids.append(col["record_id"][i])
            block.append(list(zip(col["forms"][i], col["us"][i], col["costs"][i])))
    if block:
        yield key, ids, block, more


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_ENDS = [(f"{end}_{n}", pa.list_(t)) for end in ("first", "last") for n, t in (("forms", pa.string()), ("us", pa.int64()), ("costs", pa.float64()))]
_SUM = pa.schema([("record_table", pa.string()), ("source", pa.int64()), ("block", pa.int64()), *_ENDS, ("matrix", pa.list_(pa.float64()))])
_SUM_DDL = "record_table string, source bigint, block bigint, first_forms array<string>, first_us array<bigint>, first_costs array<double>, last_forms array<string>, last_us array<bigint>, last_costs array<double>, matrix array<double>"


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for key, _, block, _ in _blocks(batches):
        matrix, _ = transfer(block)
        rows.append((*key, *([x[k] for x in block[end]] for end in (0, -1) for k in range(3)), matrix.ravel().tolist()))
    yield _table(rows, _SUM)


_FIXED = pa.schema([("record_table", pa.string()), ("source", pa.int64()), ("block", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_FIXED_DDL = "record_table string, source bigint, block bigint, first int, last int"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[int], list[Sum], tuple[int, int] | None]]:
    """The sums of a partition that is sorted by group and block, group by group: key, blocks, sums, and the ends if they are given."""
    key, blocks, sums, ends = None, [], [], None
    for batch in batches:
        col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for i, now in enumerate(zip(col["record_table"], col["source"], col["above"])):
            if now != key:
                if blocks:
                    yield key, blocks, sums, ends
                key, blocks, sums = now, [], []
                ends = (col["up_first"][i], col["up_last"][i]) if "up_first" in col else None
            firsts, lasts = (list(zip(*(col[f"{end}_{n}"][i] for n in ("forms", "us", "costs")))) for end in ("first", "last"))
            blocks.append(col["block"][i])
            sums.append((firsts, lasts, np.array(col["matrix"][i]).reshape(len(firsts), len(lasts))))
    if blocks:
        yield key, blocks, sums, ends


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for key, _, sums, _ in _groups(batches):
        *both, matrix = product(sums)
        rows.append((*key, *([x[k] for x in end] for end in both for k in range(3)), matrix.ravel().tolist()))
    yield _table(rows, _SUM)


def _fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, blocks, sums, ends in _groups(batches):
        yield _table([(*key[:2], block, *fixed) for block, fixed in zip(blocks, chain(sums, ends))], _FIXED)


_CHOSEN = pa.schema([("record_table", pa.string()), ("record_id", pa.int64()), ("utc_us", pa.int64()), ("form", pa.string())])


def _trace_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, ids, block, (first, last) in _blocks(batches, ("first", "last")):
        _, back = transfer(block)
        picked = [x[i] for x, i in zip(block, trace(block, back, first, last))]
        yield _table([(key[0], i, x[1], x[0]) for i, x in zip(ids, picked)], _CHOSEN)


def normalise(records: DataFrame) -> DataFrame:
    """``records``: ``record_table`` string, ``record_id`` bigint, ``source`` bigint, ``block`` bigint from 0 (of a bounded number of
    records, ascending in the source's order), ``pos`` bigint (order in the block), ``text``, ``zone`` string,
    ``day_first`` boolean. Returns ``record_table, record_id, utc_us, form``, a row for each readable record.

    The readings are computed once, brought together by block and used again from that shuffle. A task holds a block, or the sums of a group of blocks,
    which have the same number but for the bits of ``LEVELS``.
    """
    key = ["record_table", "source"]
    read = records.select("record_table", "record_id", "source", "block", "pos", "text", "zone", "day_first").mapInArrow(_interpret, f"{_PLACE}, {_READINGS}")
    spread = read.repartition("record_table", "source", "block").sortWithinPartitions("record_table", "source", "block", "pos", "record_id")
    levels = [spread.mapInArrow(_sum_up, _SUM_DDL)]
    gathered = []
    for shift in (*levels_from(LEVELS), None):
        above = F.shiftright("block", shift) if shift is not None else F.lit(0).cast("bigint")
        together = levels[-1].withColumn("above", above).repartition(*key, "above")
        gathered.append(together)
        if shift is not None:
            levels.append(together.sortWithinPartitions(*key, "above", "block").mapInArrow(_multiply, _SUM_DDL))
    ends = None
    for together in reversed(gathered):
        own = together
        if ends is not None:
            up = ends.select(*key, F.col("block").alias("above"), F.col("first").alias("up_first"), F.col("last").alias("up_last"))
            own = together.alias("t").join(up.alias("e"), F.expr("t.record_table <=> e.record_table and t.source <=> e.source and t.above <=> e.above")).select("t.*", "up_first", "up_last").repartition(*key, "above")
        ends = own.sortWithinPartitions(*key, "above", "block").mapInArrow(_fix, _FIXED_DDL)
    with_ends = (
        spread.alias("t")
        .join(ends.alias("e"), F.expr("t.record_table <=> e.record_table and t.source <=> e.source and t.block <=> e.block"))
        .select("t.*", "e.first", "e.last")
        .repartition("record_table", "source", "block")
        .sortWithinPartitions("record_table", "source", "block", "pos", "record_id")
    )
    return with_ends.mapInArrow(_trace_blocks, "record_table string, record_id bigint, utc_us bigint, form string")


def levels_from(bits: tuple[int, ...]) -> list[int]:
    """Bits dropped from one level to the next, from bits dropped in all."""
    return [b - a for a, b in zip((0, *bits), bits)]
