"""Schemas that drift between files: one consistently typed table, and a report of every change.

Each file's schema is fingerprinted (dotted path -> commonest type), and a feed's version goes up where the fingerprint changes. Two consecutive
versions give the migration steps: added, removed, retyped and renamed attributes. Steps are chained into the rules of each
version, (path -> canonical attribute, canonical type), and every line is routed through the rules of its file's version. A version that
lacks an attribute of its feed, as it is added later or was removed before, has a default rule for it. Two paths of one version never
share a canonical attribute: a path that is added anew while another one goes on under its old name gets a name of its own (``NAME#2``).

Defined cases: a line whose ``attrs`` are null, broken or no object gives no attributes but keeps its row, as does one without feed or file, which is in no comparison; null values and
empty objects give no attribute; files without lines are left out; equally common types go by the order number, string,
boolean, array; a key that is repeated in an object holds its last value; an array of one element is cast to a number or
boolean as its element; a value that can't be cast to the canonical type becomes null, its path is listed in ``uncast`` and
``uncast_json`` keeps it as JSON by its path; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: In the order that settles ties.
TYPES = ("number", "string", "boolean", "array")
#: The store's names of the types.
STORE_TYPES = {"Num": "number", "Str": "string", "Bool": "boolean", "VecStr": "array"}


def kind(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "array" if isinstance(value, list) else "string"


def parse(text: str | None) -> dict:
    """The object in a text; empty if there is none."""
    if not isinstance(text, str):
        return {}
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def flatten(found: dict) -> dict[str, object]:
    """Dotted path -> non-null value that is not an object, without recursion."""
    out: dict[str, object] = {}
    todo = [("", found)]
    while todo:
        head, at = todo.pop()
        for k, v in at.items():
            if isinstance(v, dict):
                todo.append((f"{head}{k}.", v))
            elif v is not None:
                out[head + k] = v
    return out


def canonical(value: object) -> str:
    """A text that is equal for equal JSON values; 5 and 5.0 are equal."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


_COUNTS = pa.schema([("feed_id", pa.int64()), ("file_id", pa.int64()), ("attr_path", pa.string()), ("attr_type", pa.string()), ("n", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts by file, path and type, in sets of bounded size."""
    counts: Counter = Counter()
    for batch in batches:
        for feed, file, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for path, value in flatten(parse(text)).items():
                counts[feed, file, path, kind(value)] += 1
        if len(counts) > 200_000:
            yield _batch([(*k, v) for k, v in counts.items()], _COUNTS)
            counts = Counter()
    yield _batch([(*k, v) for k, v in counts.items()], _COUNTS)


def fingerprints(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``feed_id, file_id, n_lines, seq`` (the file's place among the feed's files with lines, from 1), ``fields``, a map from path to type, empty
    where no line gives an attribute, ``fingerprint``, a hash of the fields, ``version``, from 1, one more with each change of the
    fingerprint, and ``begins``, whether the file is the first of its version. ``lines``: feed_id, file_id, attrs; ``files``: feed_id, file_id,
    period_start."""
    lines = lines.select("feed_id", "file_id", "attrs").dropna(subset=["feed_id", "file_id"])
    counted = lines.mapInArrow(_profile, "feed_id bigint, file_id bigint, attr_path string, attr_type string, n bigint")
    order = F.create_map(*[x for i, t in enumerate(TYPES) for x in (F.lit(t), F.lit(i))])
    by_type = counted.groupBy("feed_id", "file_id", "attr_path", "attr_type").agg(F.sum("n").alias("n"))
    by_path = by_type.groupBy("feed_id", "file_id", "attr_path").agg(F.max_by("attr_type", F.struct(F.col("n"), -order[F.col("attr_type")])).alias("attr_type"))
    fields = by_path.groupBy("feed_id", "file_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attr_path", "attr_type")))).alias("fields"))
    used = lines.groupBy("feed_id", "file_id").agg(F.count(F.lit(1)).alias("n_lines"))
    ordered = files.select("feed_id", "file_id", "period_start").join(used, ["feed_id", "file_id"])
    seq = F.row_number().over(Window.partitionBy("feed_id").orderBy("period_start", "file_id"))
    none = F.create_map().cast("map<string,string>")
    found = ordered.withColumn("seq", seq).join(fields, ["feed_id", "file_id"], "left").select("feed_id", "file_id", "n_lines", "seq", F.coalesce("fields", none).alias("fields"))
    marked = found.withColumn("fingerprint", F.sha2(F.to_json("fields"), 256))
    w = Window.partitionBy("feed_id").orderBy("seq")
    changed = ~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(w))
    return marked.withColumn("begins", changed).withColumn("version", F.count_if("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def _steps(prints: DataFrame) -> DataFrame:
    """Each version that has one before it: its first file, the file before that, both versions' fields, and the paths that are gone and new."""
    w = Window.partitionBy("feed_id").orderBy("seq")
    pair = prints.withColumns({"old": F.lag("fields").over(w), "prev_file": F.lag("file_id").over(w)}).filter("begins and version > 1")
    return pair.withColumns({"gone": F.array_except(F.map_keys("old"), F.map_keys("fields")), "new": F.array_except(F.map_keys("fields"), F.map_keys("old"))})


_VALUES = pa.schema([("feed_id", pa.int64()), ("file_id", pa.int64()), ("event_id", pa.string()), ("is_new", pa.bool_()), ("attr_path", pa.string()), ("value", pa.string())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for feed, event, text, gone_for, gone, new_for, new in zip(*(batch.column(i).to_pylist() for i in range(7))):
            flat = flatten(parse(text))
            for file, paths, is_new in ((gone_for, gone, False), (new_for, new, True)):
                rows += [(feed, file, event, is_new, p, canonical(flat[p])) for p in paths or () if p in flat]
        yield _batch(rows, _VALUES)


def renames(lines: DataFrame, steps: DataFrame) -> DataFrame:
    """``feed_id, file_id, old_path, attr_path``: pairs of a gone and a new path whose values are the same in all events, at least
    one, that both files deliver with a value under both. Only lines of files beside such a step are read again, and only
    values of gone and new paths are shuffled, keyed by event."""
    both = steps.filter((F.size("gone") > 0) & (F.size("new") > 0))
    before = both.select("feed_id", F.col("prev_file").alias("file_id"), F.col("file_id").alias("gone_for"), "gone")
    after = both.select("feed_id", "file_id", F.col("file_id").alias("new_for"), "new")
    wanted = before.join(after, ["feed_id", "file_id"], "full_outer")
    values = (
        lines.filter("event_id is not null")
        .select("feed_id", "file_id", "event_id", "attrs")
        .join(wanted, ["feed_id", "file_id"])
        .select("feed_id", "event_id", "attrs", "gone_for", "gone", "new_for", "new")
        .mapInArrow(_extract, "feed_id bigint, file_id bigint, event_id string, is_new boolean, attr_path string, value string")
    )
    one = values.groupBy("feed_id", "file_id", "event_id", "is_new", "attr_path").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    sides = one.groupBy("feed_id", "file_id", "event_id").agg(
        *(F.collect_list(F.when(F.col("is_new") == flag, F.struct("attr_path", "low", "high"))).alias(name) for flag, name in ((False, "olds"), (True, "news")))
    )
    # paths of one event in one step: as many as its schema changed
    pairs = sides.filter((F.size("olds") > 0) & (F.size("news") > 0)).withColumn("o", F.explode("olds")).withColumn("n", F.explode("news"))
    same = (F.col("o.low") == F.col("n.low")) & (F.col("o.high") == F.col("n.high")) & (F.col("o.low") == F.col("o.high"))
    return (
        pairs.groupBy("feed_id", "file_id", F.col("o.attr_path").alias("old_path"), F.col("n.attr_path").alias("attr_path"))
        .agg(F.bool_and(same).alias("same"))
        .filter("same")
        .drop("same")
    )


def changes(lines: DataFrame, files: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """The migration steps between versions: ``feed_id, file_id`` (of the later file), ``change_kind``, ``attr_path``, ``old_path``, and ``old_type``,
    ``new_type`` of the attribute (null where it is gone or new), ``seq`` of the file."""
    steps = _steps(fingerprints(lines, files) if prints is None else prints)
    moved = renames(lines, steps)
    of = moved.groupBy("feed_id", "file_id").agg(F.collect_list(F.struct("old_path", "attr_path")).alias("moved"))
    s = steps.join(of, ["feed_id", "file_id"], "left")
    no = F.array().cast("array<struct<old_path:string,attr_path:string>>")
    s = s.withColumn("moved", F.coalesce("moved", no))
    kept = F.array_intersect(F.map_keys("old"), F.map_keys("fields"))
    step = lambda what, new, old: F.struct(F.lit(what).alias("change_kind"), new.alias("attr_path"), old.alias("old_path"))
    all_steps = F.concat(
        F.transform(F.array_except("new", F.transform("moved", lambda m: m["attr_path"])), lambda p: step("added", p, p)),
        F.transform(F.array_except("gone", F.transform("moved", lambda m: m["old_path"])), lambda p: step("removed", p, p)),
        F.transform(F.filter(kept, lambda p: F.col("old")[p] != F.col("fields")[p]), lambda p: step("retyped", p, p)),
        F.transform("moved", lambda m: step("renamed", m["attr_path"], m["old_path"])),
    )
    out = s.withColumn("c", F.explode(all_steps))
    return out.select(
        "feed_id", "file_id", "seq", "c.change_kind", "c.attr_path", "c.old_path",
        F.try_element_at("old", F.col("c.old_path")).alias("old_type"), F.try_element_at("fields", F.col("c.attr_path")).alias("new_type"),
    )


def chain_rules(prints: pd.DataFrame, steps: pd.DataFrame, locked: dict[str, str]) -> list[tuple[int, dict[str, tuple[str, str]]]]:
    """Rules of a feed by the first file of each version: path -> (canonical attribute, canonical type). A renamed attribute goes on under the
    name it had first; an attribute that returns under a name is the one that had it before, unless that one lives on under another path, when it
    gets a fresh name; the type is the locked one, else the first. Pure bookkeeping over the versions of one feed, of which there is
    an entry per change, not per line or file."""
    types, name, by_file, out = dict(locked), {}, defaultdict(list), []
    before: dict[str, tuple[str, str]] = {}
    for x in steps.itertuples():
        by_file[x.file_id].append(x)
    for x in prints.sort_values("seq").itertuples():
        fields = dict(x.fields)
        roots = {path: before[path][0] for path in fields if path in before}
        moved = sorted(((c.attr_path, c.old_path) for c in by_file.get(x.file_id, []) if c.change_kind == "renamed" and c.attr_path in fields))
        for path, old in moved:
            root = before[old][0] if old in before else name.get(old, old)
            if root not in roots.values():  # of several paths with one old path the first goes on
                roots[path] = root
        for path in sorted(set(fields) - set(roots)):
            root, n = name.get(path, path), 2
            while root in roots.values() or root != name.get(path, path) and root in types:
                root, n = f"{path}#{n}", n + 1
            roots[path] = root
        name.update(roots)
        before = {path: (roots[path], types.setdefault(roots[path], kind_)) for path, kind_ in fields.items()}
        assert len({root for root, _ in before.values()}) == len(before)
        out.append((x.file_id, before))
    return out


def default_rules(chained: list[tuple[int, dict[str, tuple[str, str]]]]) -> dict[int, dict[str, str]]:
    """By file, the canonical attributes of the feed that its version lacks, with their types."""
    whole = {name: kind_ for _, rules in chained for name, kind_ in rules.values()}
    return {file: {n: k for n, k in whole.items() if n not in have} for file, have in ((f, {n for n, _ in rules.values()}) for f, rules in chained)}


def _rules_of_feed(absent: dict[str, object] | None):
    """``absent``: declared values by canonical attribute; None for no default rules."""

    def book(pdf: pd.DataFrame) -> pd.DataFrame:
        prints = pdf[pdf["what"] == "file"]
        steps = pdf[pdf["what"] == "step"]
        locked = {r.attr_path: STORE_TYPES.get(r.old_type, "string") for r in pdf[pdf["what"] == "lock"].itertuples()}
        versions = dict(zip(prints["file_id"], prints["version"]))
        chained = chain_rules(prints, steps, locked)
        lacking = {} if absent is None else default_rules(chained)
        rows = []
        for file, rules in chained:
            own = [{"path": p, "name": a, "kind": b, "value": None} for p, (a, b) in rules.items()]
            own += [{"path": None, "name": a, "kind": b, "value": json.dumps(absent.get(a))} for a, b in lacking.get(file, {}).items()]
            rows.append((int(pdf["feed_id"].iloc[0]), int(versions[file]), own))
        return pd.DataFrame(rows, columns=["feed_id", "version", "rules"])

    return book


def cast(value: object, to: str) -> object:
    """A value as the canonical type; None if it can't be."""
    if to in ("number", "boolean") and isinstance(value, list) and len(value) == 1 and not isinstance(value[0], (list, dict, type(None))):
        value = value[0]  # what a cast to an array wraps
    is_ = kind(value)
    if to == is_:
        if to == "array":
            return [x if isinstance(x, str) else json.dumps(x) for x in value]
        return float(value) if to == "number" else value
    if to == "string":
        return json.dumps(value, ensure_ascii=False)
    if to == "array":
        if is_ == "string" and value[:1] == "[":
            try:
                found = json.loads(value)
            except ValueError:
                found = None
            if isinstance(found, list):
                return [x if isinstance(x, str) else json.dumps(x) for x in found]
        return [value if is_ == "string" else json.dumps(value)]
    if to == "number":
        if is_ == "boolean":
            return float(value)
        try:
            return float(value) if is_ == "string" else None
        except ValueError:
            return None
    if is_ == "number":
        return {0: False, 1: True}.get(value)
    return {"true": True, "false": False}.get(value.strip().lower()) if is_ == "string" else None


_CELLS = {k: pa.map_(pa.string(), t) for k, t in (("nums", pa.float64()), ("strs", pa.string()), ("bools", pa.bool_()), ("vecs", pa.list_(pa.string())))} | {"uncast": pa.list_(pa.string()), "uncast_json": pa.map_(pa.string(), pa.string())}
_SLOT = {"number": "nums", "string": "strs", "boolean": "bools", "array": "vecs"}


def _router(defaults: dict[str, object]):
    by_slot = {slot: {n: cast(v, k) for n, v in defaults.items() if kind(v) == k} for k, slot in _SLOT.items()}

    def read(rules: list[dict] | None) -> tuple[dict[str, tuple[str, str]], dict[str, dict]]:
        start = {k: dict(v) for k, v in by_slot.items()}
        by_path = {}
        for r in rules or ():
            if r["path"] is not None:
                by_path[r["path"]] = (r["name"], r["kind"])
            elif r["name"] not in start[_SLOT[r["kind"]]]:
                value = json.loads(r["value"])
                start[_SLOT[r["kind"]]][r["name"]] = None if value is None else cast(value, r["kind"])
        return by_path, start

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines come after the row with the rules of their file."""
        (by_path, start), version, file = read(None), None, None
        for batch in batches:
            cells: dict[str, list] = {k: [] for k in _CELLS}
            versions, lines = [], []
            rules, of_rules = batch.column("rules"), batch.column("version").to_pylist()
            files = zip(batch.column("feed_id").to_pylist(), batch.column("file_id").to_pylist())
            for i, (own, text, is_line) in enumerate(zip(files, batch.column("attrs").to_pylist(), batch.column("is_line").to_pylist())):
                if not is_line or own != file:
                    (by_path, start), version, file = read(None if is_line else rules[i].as_py()), None if is_line else of_rules[i], own
                if not is_line:
                    continue
                lines.append(i)
                versions.append(version)
                row: dict[str, dict] = {k: dict(v) for k, v in start.items()}
                bad = {}
                for path, value in flatten(parse(text)).items():
                    name, to = by_path.get(path, (path, kind(value)))
                    done = cast(value, to)
                    if done is None:
                        bad[path] = json.dumps(value)
                    else:
                        row[_SLOT[to]][name] = done
                for k, v in row.items():
                    cells[k].append(list(v.items()))
                cells["uncast"].append(sorted(bad))
                cells["uncast_json"].append(sorted(bad.items()))
            kept = batch.drop_columns(["attrs", "rules", "version", "is_line", "salt"]).take(pa.array(lines, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(versions, pa.int32()), *(pa.array(v, _CELLS[k]) for k, v in cells.items())], names=[*kept.schema.names, "schema_version", *cells])

    return route


#: A file with more lines is routed in parts of about so many. At most one file of so many lines is, so the list of them fits every task.
FILE_LINES = 1_000_000
#: Parts of the lines that have no file.
STRAY_SALTS = 64


def consistent(
    lines: DataFrame, files: DataFrame, locked: DataFrame, defaults: dict[str, object] | None = None, absent: dict[str, object] | None = None, others: tuple[str, ...] = ()
) -> DataFrame:
    """Every line as one row of the consistent table: ``raw_id, feed_id, file_id, line_no, event_id, schema_version`` and the canonical
    attributes in ``nums``, ``strs``, ``bools`` and ``vecs`` by type, an attribute always in the same one within its feed; ``uncast`` lists
    the paths of stray values and ``uncast_json`` maps each to its value. ``locked``: feed_id, attr_name, attr_type. ``defaults``: values of canonical attributes that a line lacks; without
    one a missing attribute is missing. ``absent``: if given, lines get the attributes of their feed that their version lacks, with the declared
    value, else an explicit null. ``others``: further columns of ``lines`` to keep as they are."""
    prints = fingerprints(lines, files)
    log = changes(lines, files, prints)
    none = F.lit(None).cast("string")
    no_map = F.lit(None).cast("map<string,string>")
    book = (
        prints.filter("begins").select("feed_id", "file_id", "seq", F.lit("file").alias("what"), none.alias("change_kind"), none.alias("attr_path"), none.alias("old_path"), none.alias("old_type"), "fields", "version")
        .unionByName(log.select("feed_id", "file_id", "seq", F.lit("step").alias("what"), "change_kind", "attr_path", "old_path", "old_type", no_map.alias("fields"), F.lit(0).alias("version")))
        .unionByName(locked.select("feed_id", F.lit(0).cast("bigint").alias("file_id"), F.lit(0).alias("seq"), F.lit("lock").alias("what"), none.alias("change_kind"), F.col("attr_name").alias("attr_path"), none.alias("old_path"), F.col("attr_type").alias("old_type"), no_map.alias("fields"), F.lit(0).alias("version")))
    )
    rule = "array<struct<path:string,name:string,kind:string,value:string>>"
    by_version = book.filter("feed_id is not null").groupBy("feed_id").applyInPandas(_rules_of_feed(absent), f"feed_id bigint, version int, rules {rule}")
    # each file's rules go once before its lines, or before each part of a very long file
    parts = F.ceil(F.col("n_lines") / F.lit(FILE_LINES)).cast("int")
    of_file = prints.select("feed_id", "file_id", "version", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt")).join(by_version, ["feed_id", "version"])
    long = F.broadcast(prints.filter(F.col("n_lines") > FILE_LINES).select("feed_id", "file_id", parts.alias("_parts")))
    stray = F.when(F.col("feed_id").isNull() | F.col("file_id").isNull(), F.lit(STRAY_SALTS)).otherwise(F.coalesce("_parts", F.lit(1)))
    kept = lines.select("feed_id", "file_id", "raw_id", "line_no", "event_id", *others, "attrs").join(long, ["feed_id", "file_id"], "left").withColumns({"salt": F.pmod(F.xxhash64("raw_id"), stray).cast("int"), "is_line": F.lit(True)}).drop("_parts")
    both = kept.unionByName(of_file.withColumn("is_line", F.lit(False)), allowMissingColumns=True)
    routed = both.repartition("feed_id", "file_id", "salt").sortWithinPartitions("feed_id", "file_id", "salt", "is_line")
    extra = "".join(f"`{c}` {lines.schema[c].dataType.simpleString()}, " for c in others)
    return routed.mapInArrow(
        _router(defaults or {}),
        f"feed_id bigint, file_id bigint, raw_id bigint, line_no int, event_id string, {extra}schema_version int, nums map<string,double>, strs map<string,string>, bools map<string,boolean>, vecs map<string,array<string>>, uncast array<string>, uncast_json map<string,string>",
    )
