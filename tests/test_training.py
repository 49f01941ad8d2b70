"""The training-data operators against plain versions and on edge cases."""

import json
import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import __spark_entry__ as entry
import brute_drift
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.common import counted
from chronofold.operators import asof, drift, entity_features, rolling, sessions, timestamps

LINES = "raw_id bigint, feed_id bigint, file_id bigint, line_no int, event_id string, attrs string, value string"
FILES = "file_id bigint, feed_id bigint, period_start timestamp_ntz, file_name string"
LOCK = "feed_id bigint, event_type string, attr_name string, attr_type string"


# drift


def _drift_data(rnd):
    lines, files, raw = [], [], 0
    for feed in (1, 2):
        names = {"a": 5, "b.c": "x", "d": True, "e": ["p"]}
        events = []
        for no in range(8):
            file = feed * 100 + no
            files.append((file, feed, datetime(2024, 1, 1) + timedelta(days=no), "x"))
            if no == 3:
                continue  # a file without lines
            if no == 2:
                names = {("aa" if k == "a" else k): v for k, v in names.items()}
            if no == 4:
                names["new.deep.er"] = 1.5
            if no == 5:
                names.pop("d", None)
            if no == 6:
                names["e"] = "text"
            redelivered = rnd.sample(events, min(3, len(events)))
            events = []
            for e, values in [*redelivered, *[(f"ev{raw + i}_{feed}_{no}", {k: rnd.randint(0, 10**6) for k in "abcdefghn"}) for i in range(6)]]:
                flat = {}
                for k, kind in names.items():
                    seed = values["a" if k in ("a", "aa") else k[0]]
                    flat[k] = seed if isinstance(kind, (int, float)) and not isinstance(kind, bool) else seed % 2 == 0 if isinstance(kind, bool) else [f"s{seed}"] if isinstance(kind, list) else f"s{seed}"
                    if rnd.random() < 0.1:
                        flat[k] = rnd.choice([None, "n/a"])
                nested = {}
                for k, v in flat.items():
                    at = nested
                    *head, last = k.split(".")
                    for h in head:
                        at = at.setdefault(h, {})
                    at[last] = v
                text = json.dumps(nested)
                raw += 1
                lines.append((raw, feed, file, raw, e if rnd.random() > 0.1 else None, text if rnd.random() > 0.05 else rnd.choice([text[:-3], None, "", "[1]", "null"]), "clash"))
                events.append((e, values))
    return lines, files


@pytest.mark.parametrize("seed", range(3))
def test_drift_equals_plain_version(spark, seed):
    lines, files = _drift_data(random.Random(seed))
    want = brute_drift.report([(x[1], x[2], x[4], x[5]) for x in lines], [x[:3] for x in files])
    got = drift.changes(spark.createDataFrame(lines, LINES), spark.createDataFrame(files, FILES)).select("feed_id", "file_id", "change_kind", "attr_path", "old_path").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r[2] for r in want} >= {"added", "removed"}


def test_consistent_table(spark):
    lines = [
        (1, 1, 1, 1, "x", '{"a": 1, "b": {"c": "u"}}', "clash"),
        (2, 1, 2, 1, "x", '{"aa": 1, "b": {"c": 7}, "n": "new"}', "clash"),
        (3, 1, 2, 2, "y", '{"aa": "n/a", "b": {"c": 8}}', "clash"),
        (4, 1, 2, 3, None, None, "clash"),
        (5, 1, 2, 4, None, "broken{", None),
        (2**60 + 1, None, 2, 4, None, '{"q": 1}', None),
        (2**60 + 3, 1, None, None, None, '{"q": "x"}', None),
    ]
    files = [(1, 1, datetime(2024, 1, 1), "f"), (2, 1, datetime(2024, 1, 2), "f")]
    locked = [(1, "t", "a", "Num"), (1, "t", "b.c", "Str")]
    rows = {r.raw_id: r for r in drift.consistent(spark.createDataFrame(lines, LINES), spark.createDataFrame(files, FILES), spark.createDataFrame(locked, LOCK)).collect()}
    assert len(rows) == 7 and rows[2**60 + 1].nums == {"q": 1.0} and rows[2**60 + 3].strs == {"q": "x"}
    assert rows[1].nums == {"a": 1.0} and rows[1].strs == {"b.c": "u"}
    assert rows[2].nums == {"a": 1.0} and rows[2].strs == {"b.c": "7", "n": "new"}  # renamed and cast
    assert rows[3].nums == {} and rows[3].uncast == ["aa"]
    assert rows[4].nums == {} and rows[5].strs == {} and rows[5].uncast == []
    assert [rows[i].schema_version for i in (1, 2, 3)] == [1, 2, 2]
    filled = drift.consistent(spark.createDataFrame(lines, LINES), spark.createDataFrame(files, FILES), spark.createDataFrame(locked, LOCK), {"a": 0, "z": True}).filter("raw_id in (1, 3)").orderBy("raw_id").collect()
    assert [r.nums for r in filled] == [{"a": 1.0}, {"a": 0.0}] and filled[0].bools == {"z": True}


def test_arrays_come_back_as_numbers(spark):
    """number -> array -> number and boolean -> array: no value is lost, and what can't be cast is kept as it came."""
    lines = [
        (1, 1, 1, 1, "x", '{"a": 5, "b": true}', None),
        (2, 1, 2, 1, "y", '{"a": [6.5], "b": [false]}', None),
        (3, 1, 2, 2, "z", '{"a": ["7"], "b": ["true"]}', None),
        (4, 1, 2, 3, "s", '{"a": [1, 2], "b": [null]}', None),
        (5, 1, 2, 4, "t", '{"a": [[3]], "b": [{"c": 1}]}', None),
        (6, 1, 2, 5, "u", '{"a": [], "b": "n/a"}', None),
        (7, 1, 3, 1, "v", '{"a": 8, "b": true}', None),
    ]
    files = [(i, 1, datetime(2024, 1, i), "f") for i in (1, 2, 3)]
    rows = drift.consistent(spark.createDataFrame(lines, LINES), spark.createDataFrame(files, FILES), spark.createDataFrame([(1, "t", "a", "Num")], LOCK)).orderBy("raw_id").collect()
    assert [r.nums.get("a") for r in rows] == [5.0, 6.5, 7.0, None, None, None, 8.0]
    assert [r.bools.get("b") for r in rows] == [True, False, True, None, None, None, True]
    assert [r.uncast_json for r in rows[3:6]] == [{"a": "[1, 2]", "b": "[null]"}, {"a": "[[3]]", "b": '[{"c": 1}]'}, {"a": "[]", "b": '"n/a"'}]
    assert all(sorted(r.uncast_json) == r.uncast for r in rows) and not any(r.vecs for r in rows)


def test_default_rules_of_versions(spark):
    """What a version lacks, by a later added or an earlier removed step, has its default; what only a line lacks stays missing."""
    lines = [
        (1, 1, 1, 1, "x", '{"a": 5, "t": "u"}', "E"),
        (2, 1, 2, 1, "y", '{"aa": 6, "n": 1, "t": "v"}', "F"),
        (3, 1, 2, 2, "x", '{"aa": 5}', None),
        (4, 1, 3, 1, "z", '{"n": 2}', "G"),
        (5, 2, 4, 1, "z", '{"q": true}', "H"),
        (6, None, None, 1, "z", '{"q": true}', "I"),
    ]
    files = [(i, 1 + (i == 4), datetime(2024, 1, i), "f") for i in (1, 2, 3, 4)]
    locked = [(1, "t", "a", "Num")]
    data = [spark.createDataFrame(*x) for x in ((lines, LINES), (files, FILES), (locked, LOCK))]
    rows = drift.consistent(*data, absent={}, others=("value",)).orderBy("raw_id").collect()
    assert [r.nums for r in rows] == [{"a": 5.0, "n": None}, {"a": 6.0, "n": 1.0}, {"a": 5.0}, {"a": None, "n": 2.0}, {}, {}]
    assert [r.strs for r in rows] == [{"t": "u"}, {"t": "v"}, {}, {"t": None}, {}, {}]
    assert [r.value for r in rows] == ["E", "F", None, "G", "H", "I"] and rows[4].bools == {"q": True}
    declared = drift.consistent(*data, absent={"n": 7, "t": "-"}).orderBy("raw_id").collect()
    assert declared[0].nums == {"a": 5.0, "n": 7.0} and declared[2].nums == {"a": 5.0} and declared[3].strs == {"t": "-"} and declared[3].nums == {"a": None, "n": 2.0}


def test_renamed_and_added_again(spark):
    """A path that is renamed while its old name comes back for another attribute: both go on, no value is lost."""
    lines = [
        (1, 1, 1, 1, "x", '{"a": 1}', None),
        (2, 1, 2, 1, "x", '{"aa": 1}', None),
        (3, 1, 3, 1, "y", '{"aa": 5, "a": 9}', None),
        (4, 1, 4, 1, "y", '{"a": 9}', None),
        (5, 1, 5, 1, "z", '{"a": "t", "aa": 7, "a#2": 8}', None),
    ]
    files = [(i, 1, datetime(2024, 1, i), "f") for i in range(1, 6)]
    rows = drift.consistent(spark.createDataFrame(lines, LINES), spark.createDataFrame(files, FILES), spark.createDataFrame([(1, "t", "a", "Num")], LOCK)).orderBy("raw_id").collect()
    assert [r.nums for r in rows] == [{"a": 1.0}, {"a": 1.0}, {"a": 5.0, "a#2": 9.0}, {"a#2": 9.0}, {"a": 7.0, "a#2#2": 8.0}]
    assert rows[4].uncast_json == {"a": '"t"'}


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("most", [drift.FILE_LINES, 3])
def test_no_value_is_lost(spark, seed, most, monkeypatch):
    """Values in are values out and uncast ones, whatever the files are cut into."""
    monkeypatch.setattr(drift, "FILE_LINES", most)
    lines, files = _drift_data(random.Random(100 + seed))
    locked = [(f, "t", a, t) for f in (1, 2) for a, t in (("a", "Num"), ("b.c", "Str"), ("d", "Bool"), ("e", "VecStr"))]
    lines += [(900, None, 3, 1, None, '{"q": 1}', None), (901, 1, 101, None, None, '{"a": {"b": []}, "c": {}}', None)]
    rows = drift.consistent(spark.createDataFrame(lines, LINES), spark.createDataFrame(files, FILES), spark.createDataFrame(locked, LOCK)).collect()
    out = {r.raw_id: len(r.nums) + len(r.strs) + len(r.bools) + len(r.vecs) + len(r.uncast_json) for r in rows}
    assert out == {x[0]: len(drift.flatten(drift.parse(x[5]))) for x in lines} and len(rows) == len(lines)


def test_drift_of_empty_tables(spark):
    lines, files, locked = (spark.createDataFrame([], s) for s in (LINES, FILES, LOCK))
    assert drift.changes(lines, files).count() == 0
    assert drift.consistent(lines, files, locked).count() == 0


# timestamps


def _us(*a):
    return timestamps._us(datetime(*a))


READ = [
    ("2024-03-10T02:30:00", "America/New_York", None, _us(2024, 3, 10, 7, 30)),  # skipped: the offset before
    ("2024-11-03 01:30:00", "America/New_York", None, _us(2024, 11, 3, 5, 30)),  # twice: the earlier
    ("2024-11-03 01:30:00 EST", "America/New_York", None, _us(2024, 11, 3, 6, 30)),
    ("2024-11-03T01:30:00-05:00", "Europe/Berlin", None, _us(2024, 11, 3, 6, 30)),
    ("2024-11-03T01:30:00-05:00[Europe/Berlin]", None, None, _us(2024, 11, 3, 6, 30)),  # an offset outranks a name
    ("2024-01-05 10:00:00 America/New_York", "Asia/Tokyo", None, _us(2024, 1, 5, 15)),
    ("2024-01-05 10:00:00 Australia/Lord_Howe", "UTC", None, _us(2024, 1, 4, 23)),
    ("05/01/2024 1:05 PM", "UTC", True, _us(2024, 1, 5, 13, 5)),
    ("05/01/2024 12:05 AM", "UTC", False, _us(2024, 5, 1, 0, 5)),
    ("25/01/2024 12:05", "UTC", False, None),  # no such month in the source's order
    ("05.01.2024", "Europe/Berlin", False, _us(2024, 1, 4, 23)),
    ("Sun, 17 Sep 2023 22:00:59 +1030", None, None, _us(2023, 9, 17, 11, 30, 59)),
    ("Sep 17, 2023 8:52:14 AM", "UTC", None, _us(2023, 9, 17, 8, 52, 14)),
    ("5 Apr 2023 08:19:48", "UTC", None, _us(2023, 4, 5, 8, 19, 48)),
    ("1675943926.6339999", None, None, 1675943926633999),
    ("1675943926", None, None, 1675943926000000),
    ("1676848747924", None, None, 1676848747924000),
    ("1676289497705101", None, None, 1676289497705101),
    (" 2023-02-25 10:23:25,701 ", "UTC", None, _us(2023, 2, 25, 10, 23, 25, 701000)),
    ("2023-02-25 10:23:25.701000999", "UTC", None, _us(2023, 2, 25, 10, 23, 25, 701000)),
    ("20230222T222912Z", "Asia/Tokyo", None, _us(2023, 2, 22, 22, 29, 12)),
    ("2023-03-04t02:37:25z", "Asia/Tokyo", None, _us(2023, 3, 4, 2, 37, 25)),
    *((x, "UTC", True, None) for x in (None, "", "  ", "2023-02-29", "2024-13-05T10:00:00", "2024-05-06T25:61:00Z", "yesterday", "12:45:10", "null", "-", "x" * 5000)),
]


@pytest.mark.parametrize("text,zone,day_first,want", READ)
def test_readings(text, zone, day_first, want):
    found = timestamps.interpretations(text, zone, day_first)
    assert [x[1] for x in found if x[2] < timestamps.RULE] == ([] if want is None else [want])


def _whole_viterbi(records):
    """All sequences of readings, the cheapest first in order of the arrays."""
    best = {i: (x[2], [i]) for i, x in enumerate(records[0])}
    for before, now in zip(records, records[1:]):
        best = {j: min(((best[i][0] + timestamps.step_cost(a, b) + b[2], [*best[i][1], j]) for i, a in enumerate(before)), key=lambda x: x[0]) for j, b in enumerate(now)}
    return min(best.values(), key=lambda x: x[0])


@pytest.mark.parametrize("seed", range(30))
def test_blocks_cost_as_much_as_the_whole(seed):
    rnd = random.Random(seed)
    records = [[(rnd.choice("ab"), rnd.randint(0, 20) * timestamps.FULL_JUMP_US // 5, rnd.choice([0.0, 1.0])) for _ in range(rnd.randint(1, 3))] for _ in range(rnd.randint(1, 14))]
    cuts = sorted(rnd.sample(range(1, len(records)), min(len(records) - 1, rnd.randint(0, 3)))) if len(records) > 1 else []
    blocks = [records[a:b] for a, b in zip([0, *cuts], [*cuts, len(records)])]
    done = [timestamps.transfer(b) for b in blocks]
    ends = timestamps.chain([(b[0], b[-1], m) for b, (m, _) in zip(blocks, done)])
    path = [i for b, (_, back), (first, last) in zip(blocks, done, ends) for i in timestamps.trace(b, back, first, last)]
    picked = [r[i] for r, i in zip(records, path)]
    if len(blocks) > 2:  # products in any grouping, ends pushed down
        sums = [(b[0], b[-1], m) for b, (m, _) in zip(blocks, done)]
        tops = [timestamps.product(sums[:2]), timestamps.product(sums[2:])]
        tree = [x for own, ends in zip((sums[:2], sums[2:]), timestamps.chain(tops)) for x in timestamps.chain(own, ends)]
        again = [r[i] for r, i in zip(records, [i for b, (_, back), (first, last) in zip(blocks, done, tree) for i in timestamps.trace(b, back, first, last)])]
        assert sum(x[2] for x in again) + sum(timestamps.step_cost(a, b) for a, b in zip(again, again[1:])) == pytest.approx(_whole_viterbi(records)[0])
    cost = sum(x[2] for x in picked) + sum(timestamps.step_cost(a, b) for a, b in zip(picked, picked[1:]))
    assert cost == pytest.approx(_whole_viterbi(records)[0])


def test_hidden_order_is_recovered(spark):
    """On the planted tables, with the declared day order hidden."""
    rows = entry.queries()["p2_undeclared"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) > 50 and sum(r.utc_us == r.declared_us for r in rows) >= 0.9 * len(rows)


@pytest.mark.parametrize("bits", [(1, 2), (16, 31)])
def test_undeclared_order_is_settled_by_the_sequence(spark, bits, monkeypatch):
    """Slash dates of a source that doesn't declare its order: times go forward, so the day comes first."""
    monkeypatch.setattr(timestamps, "LEVELS", bits)
    shape = "record_table string, record_id bigint, source bigint, block bigint, pos bigint, text string, zone string, day_first boolean, utc_us string"
    rows = [("t", i, 7, i // 4, i, f"{1 + i:02d}/02/2024 10:00:00", "UTC", None, "clash") for i in range(12)]
    rows += [("t", 100 + i, 8, 0, i, f"2024-02-0{1 + i}", "UTC", None, None) for i in range(3)] + [("t", 200, None, 0, 0, "2024-02-01", None, None, None), ("t", 201, 7, 9, 0, None, None, None, None)]
    got = {r.record_id: r.utc_us for r in timestamps.normalise(spark.createDataFrame(rows, shape)).collect()}
    assert got == {i: _us(2024, 2, 1 + i, 10) for i in range(12)} | {100 + i: _us(2024, 2, 1 + i) for i in range(3)} | {200: _us(2024, 2, 1)}
    assert timestamps.normalise(spark.createDataFrame([], shape)).count() == 0


# rolling totals


def _plain_rolling(days):
    out = {}
    by = defaultdict(dict)
    for e, d, n, c in days:
        by[e][d] = (n, c)
    for e, own in by.items():
        d = min(own)
        while d <= max(own):
            window = lambda w: [own.get(d - timedelta(days=i), (0, 0)) for i in range(w)]  # noqa: B023, E731
            out[e, d] = tuple(sum(x[k] for x in window(w)) for w in (7, 30) for k in (0, 1))
            d += timedelta(days=1)
    return out


DAYS = "entity string, day date, n bigint, cents bigint"


def test_rolling_versions(spark):
    rnd = random.Random(3)
    start = date(2024, 1, 1)
    days = {(e, start + timedelta(days=rnd.randint(0, 90))): (rnd.randint(1, 5), rnd.randint(-500, 9000)) for e in "abc" for _ in range(15)}
    state = rolling.rolling_state(spark.createDataFrame([(e, d, n, c) for (e, d), (n, c) in days.items()], DAYS))
    shown = lambda s: {(r.entity, r.day): (r.n_7, r.cents_7, r.n_30, r.cents_30) for r in s.collect()}
    assert shown(state) == _plain_rolling([(*k, *v) for k, v in days.items()])
    # a correction in the middle, one that takes a day back, arrivals of a new day and a new entity
    day = sorted(d for e, d in days if e == "b")[5]
    gone = sorted(d for e, d in days if e == "c")[-1]
    batch = [("b", day, 1, 250), ("c", gone, -days["c", gone][0], -days["c", gone][1]), ("b", start + timedelta(days=120), 2, 99), ("z", start, 1, 1)]
    for e, d, n, c in batch:
        old = days.get((e, d), (0, 0))
        days[e, d] = (old[0] + n, old[1] + c)
    days = {k: v for k, v in days.items() if v != (0, 0)}
    after = rolling.advance(state, spark.createDataFrame(batch, DAYS), 1)
    assert shown(after) == _plain_rolling([(*k, *v) for k, v in days.items()])
    versions = {(r.entity, r.day): r.version for r in after.collect()}
    assert all(v == 0 for (e, _), v in versions.items() if e == "a")
    assert versions["b", day] == 1 and versions["b", day - timedelta(days=1)] == 0 and versions["b", day + timedelta(days=30)] in (0, 1)
    same = rolling.advance(after, spark.createDataFrame([], DAYS), 2)
    assert shown(same) == shown(after) and {r.version for r in same.collect()} <= {0, 1}


@pytest.mark.parametrize("seed", range(4))
def test_advanced_state_equals_the_whole(spark, seed):
    """Any batch, of new days, late days, days before the first, withdrawals, in any number of versions."""
    rnd, start = random.Random(seed), date(2024, 1, 1)
    parts = [[(e, start + timedelta(days=rnd.randint(10 + 30 * k, 80 + 60 * k) if rnd.random() < 0.9 else rnd.randint(0, 10)), rnd.randint(1, 3), rnd.randint(-90, 900)) for e in "abcdefg"[: 3 + 2 * k] for _ in range(rnd.randint(0, 6))] for k in range(3)]
    if seed % 2:
        parts[2] += [(e, d, -n, -c) for e, d, n, c in parts[0][::4]]
    state = rolling.rolling_state(rolling.daily_sum(spark.createDataFrame(parts[0], DAYS)))
    for k in (1, 2):
        state = rolling.advance(state, spark.createDataFrame(parts[k], DAYS), k)
    both = spark.createDataFrame([x for p in parts for x in p], DAYS)
    whole = rolling.rolling_state(rolling.daily_sum(both).filter("n != 0 or cents != 0"))
    rows = lambda s: sorted(map(tuple, s.drop("version").collect()))
    assert rows(state) == rows(whole)
    # days that no batch reaches keep their version
    assert {r.version for r in state.collect()} <= {0, 1, 2}


def test_rolling_edges(spark):
    rows = spark.createDataFrame([("a", date(2024, 1, 1), None), (None, date(2024, 1, 1), 5), ("a", None, 5), ("a", date(2024, 1, 1), 7)], "entity string, day date, cents bigint")
    (r,) = rolling.rolling_state(rolling.daily(rows)).collect()
    assert (r.n, r.cents, r.n_7, r.cents_30) == (2, 7, 2, 7)
    assert rolling.rolling_state(rolling.daily(rows.limit(0))).count() == 0


# sessions


def _plain_sessions(rows):
    by = defaultdict(list)
    for t, i, us, gap, *_ in rows:
        if None not in (t, i, us, gap):
            by[t, i].append((us, gap))
    out = []
    for (t, i), own in by.items():
        own.sort()
        at = [own[0][0]]
        for (us, gap), (before, _) in zip(own[1:], own):
            if us - before > gap:
                out.append((t, i, at[0], at[-1], len(at)))
                at = []
            at.append(us)
        out.append((t, i, at[0], at[-1], len(at)))
    return sorted(out)


@pytest.mark.parametrize("chunk", [7, 50, 1000, 10**9])
def test_sessions_whatever_the_chunks(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(rnd.choice(["user", "device"]), rnd.choice(["a", "b", "c", None]), rnd.choice([rnd.randint(-500, 3000), None, 100]), 20, 1) for _ in range(400)]
    rows += [("user", "hot", us, 20, 1) for us in range(0, 2000, 20)]  # gaps of exactly the threshold: one session over many chunks
    df = spark.createDataFrame(rows, "entity_type string, entity_id string, us bigint, gap_us bigint, n_events int")
    assert sorted(map(tuple, sessions.sessions(df, chunk).collect())) == _plain_sessions(rows)
    assert sessions.sessions(df.limit(0), chunk).count() == 0


# attributes as known


@pytest.mark.parametrize("shard", [5, 40, 10**6])
def test_as_known_whatever_the_shards(spark, shard):
    rnd = random.Random(shard)
    at = lambda: rnd.choice([rnd.randint(0, 100), rnd.randint(0, 100), rnd.randint(0, 100), None])
    versions = [(rnd.choice(["a", "b", None]), rnd.choice(["x", "y", None]), at(), at(), i, rnd.choice(["v", None]), 0) for i in range(120)]
    asked = [(i, rnd.choice(["a", "b", "nobody", None]), at(), rnd.choice([True, False, None])) for i in range(80)]
    want = set()
    for i, e, t, inclusive in asked:
        if e is None or t is None:
            continue
        for attr in ("x", "y"):
            seen = [v for v in versions if v[0] == e and v[1] == attr and None not in v[2:4] and (max(v[2:4]) < t or inclusive and max(v[2:4]) == t)]
            if seen:
                best = max(seen, key=lambda v: (v[2], v[3], v[4]))
                want.add((i, attr, best[4], best[5]))
    v = spark.createDataFrame(versions, "entity string, attr string, held_us bigint, known_us bigint, id bigint, value string, best int")
    o = spark.createDataFrame(asked, "obs_id bigint, entity string, us bigint, inclusive boolean")
    for rows in (asof.SHARD_ROWS, 7):
        assert set(map(tuple, asof.as_known(v, o, shard, rows).collect())) == want
    assert asof.as_known(v.limit(0), o, shard).count() == 0 and asof.as_known(v, o.limit(0), shard).count() == 0


# counted rows and entity features


def test_counted(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    rows = [(1, "a", t(2), None), (2, "a", t(1), None), (3, "a", t(1), None), (4, None, t(1), None), (5, None, t(1), "x"), (6, "b", t(1), "x"), (7, "b", t(2), None), (8, "c", None, None), (9, "c", t(3), None), (10, None, t(1), None)]
    df = spark.createDataFrame(rows, "row_id bigint, event_id string, ingested_at timestamp_ntz, experiment_id string")
    assert sorted(r.keep for r in counted(df, "row_id", F.col("row_id").alias("keep")).collect()) == [2, 4, 9, 10]


@pytest.mark.parametrize("salts", [1, 8])
def test_entity_features(spark, salts):
    rows = [("u", "A", 10_000_000, 5), ("u", "A", 30_000_000, None), ("u", "B", None, 7), ("w", "B", 1, 1), (None, "A", 1, 1), ("u", None, 1, 1)] + [("hot", "A", i, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "entity string, event_type string, us bigint, cents bigint").withColumn("have", F.lit(1))
    types = spark.createDataFrame([("C", 40_000_000), ("B", None), ("A", 3)], "event_type string, us bigint")
    got = {r.entity: r.features for r in entity_features.feature_table(entity_features.entity_type_stats(df, F.col("us"), salts), types).collect()}
    assert set(got) == {"u", "w", "hot"}
    assert tuple(got["u"]["A"]) == (2, 5, 10.0) and tuple(got["u"]["B"]) == (1, 7, None) and tuple(got["u"]["C"]) == (0, 0, None)
    assert got["hot"]["A"]["n"] == 500 and list(got["hot"]) == ["A", "B", "C"]
    assert entity_features.feature_table(entity_features.entity_type_stats(df.limit(0), F.col("us")), types.limit(0)).count() == 0


def test_entity_features_of_very_many_types(spark):
    df = spark.range(30_000).select(F.lit("u").alias("entity"), F.concat(F.lit("t"), "id").alias("event_type"), F.lit(5).cast("bigint").alias("us"), F.lit(1).cast("bigint").alias("cents"))
    types = df.select("event_type", "us").unionByName(spark.createDataFrame([("other", 1)], "event_type string, us bigint"))
    (r,) = entity_features.feature_table(entity_features.entity_type_stats(df, F.col("event_type")), types).collect()
    assert len(r.features) == 30_001 and tuple(r.features["other"]) == (0, 0, None) and tuple(r.features["t7"]) == (1, 1, 0.0)


def test_types_stay(spark):
    """Results have the documented columns."""
    assert drift.fingerprints(spark.createDataFrame([], LINES), spark.createDataFrame([], FILES)).schema["fields"].dataType == T.MapType(T.StringType(), T.StringType())
