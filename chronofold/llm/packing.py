"""Filling containers of fixed capacity with documents, by best-two-fit.

A container is filled greedily with the largest item that fits; then its smallest item gives way to two unpacked items that
fit the widened gap more tightly, as long as such exist. Sizes are whole numbers up to the capacity, so the packing is
worked out on the count of items by size, a table of at most ``capacity`` entries whatever the number of documents:
containers with equal contents are made at once, as often as the counts allow. Items are then numbered within their size in
parallel and look up their container.

Defined cases: a document larger than the capacity is split into full pieces and a rest; null and empty documents have
size 0, are spread over the containers evenly and take no room; equal sizes go by document id and piece; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.common import settled

CAPACITY = 2048
#: The items of a size are numbered in parts of about so many.
SALT_ROWS = 100_000


@dataclass(frozen=True)
class Pattern:
    """``times`` containers, from number ``first`` on, each with ``items`` (size -> how many)."""

    first: int
    times: int
    items: dict[int, int]


def _largest(count: np.ndarray, most: int) -> int:
    found = np.flatnonzero(count[1 : most + 1])
    return int(found[-1]) + 1 if len(found) else 0


def _two(count: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """The two unpacked sizes with the largest sum up to ``room``, if it is above ``more_than``."""
    sizes = np.flatnonzero(count[: room + 1])
    if not len(sizes):
        return None
    at = np.searchsorted(sizes, room - sizes, side="right") - 1
    ok = at >= 0
    twin = ok & (sizes[at] == sizes) & (count[sizes] < 2)
    at = np.where(twin, at - 1, at)
    ok &= at >= 0
    total = np.where(ok, sizes + sizes[np.maximum(at, 0)], 0)
    best = int(total.argmax())
    return (int(sizes[best]), int(sizes[at[best]])) if total[best] > more_than else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Containers for ``counts`` (size -> number of items, sizes from 1 to ``capacity``). The number of patterns depends on the
    sizes that occur, not on how often."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    out, made = [], 0
    while (size := _largest(left, capacity)) > 0:
        count, items, gap = left.copy(), {}, capacity
        while size:
            n = min(int(count[size]), gap // size)
            items[size] = items.get(size, 0) + n
            count[size] -= n
            gap -= n * size
            size = _largest(count, gap)
        while gap:
            small = min(items)
            two = _two(count, gap + small, small)
            if two is None:
                break
            items[small] -= 1
            count[small] += 1
            if not items[small]:
                del items[small]
            for x in two:
                items[x] = items.get(x, 0) + 1
                count[x] -= 1
            gap += small - sum(two)
        times = min(int(left[s]) // n for s, n in items.items())
        for s, n in items.items():
            left[s] -= n * times
        out.append(Pattern(made, times, items))
        made += times
    return out


def _slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By size: first rank, first container and containers of each run of items."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    for p in patterns:
        for size, n in p.items.items():
            runs.setdefault(size, []).append((taken.get(size, 0), p.first, p.times))
            taken[size] = taken.get(size, 0) + n * p.times
    return {size: tuple(np.array(x, np.int64) for x in zip(*r)) for size, r in runs.items()}


def pack(sizes: DataFrame, capacity: int = CAPACITY, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``sizes``: ``id, n_tokens``. Returns ``doc_id, piece_no, first_token, n_tokens, container_id``, a row per piece; a document that fits is one piece.

    The sizes are written once (see ``settled``), since they are counted before they are assigned. Only the counts by size, at most ``capacity + 1`` rows, come to the driver.
    """
    sizes = settled(sizes.select("id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")))
    last = F.greatest(F.floor((F.col("n_tokens") - 1) / F.lit(capacity)), F.lit(0))
    start = F.col("piece_no") * capacity
    items = sizes.select("id", "n_tokens", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece_no")).select(
        "id", "piece_no", start.cast("bigint").alias("first_token"), F.least(F.col("n_tokens") - start, F.lit(capacity)).cast("int").alias("size")
    )
    counts = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}
    # sizes with more items have more parts
    many = {size: -(-n // salt_rows) for size, n in counts.items() if n > salt_rows}
    salts = F.coalesce(F.create_map(*(F.lit(x) for pair in many.items() for x in pair))[F.col("size")], F.lit(1)) if many else F.lit(1)
    items = items.withColumn("salt", F.pmod(F.xxhash64("id", "piece_no"), salts))
    by_salt = items.groupBy("size", "salt").count()
    counts.pop(0, None)
    patterns = plan(counts, capacity)
    slots, containers = _slots(patterns), sum(p.times for p in patterns)
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_salt.select("size", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("size", "salt").orderBy("id", "piece_no"))
    ranked = items.withColumn("own", own).join(starts, ["size", "salt"]).select("id", "piece_no", "first_token", "size", (F.col("own") + F.col("start") - 1).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("size", "rank"))
            to = rank % max(containers, 1)
            for s in np.unique(size[size > 0]):
                first_rank, first, times = slots[int(s)]
                mine = size == s
                run = np.searchsorted(first_rank, rank[mine], side="right") - 1
                to[mine] = first[run] + (rank[mine] - first_rank[run]) % times[run]
            columns = [*(batch.column(c) for c in ("id", "piece_no", "first_token", "size")), pa.array(to, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece_no", "first_token", "n_tokens", "container_id"])

    return ranked.mapInArrow(assign, "doc_id bigint, piece_no int, first_token bigint, n_tokens int, container_id bigint")
