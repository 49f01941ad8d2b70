"""Exact percentiles of very large numeric columns by radix selection.

Values are mapped to whole numbers of the same order; a histogram of the leading digit is made per group, each target rank
follows the one digit that contains it, and only values under that digit go into the next histogram, until the target is the digit's lowest or
highest value. Only values that a filter of fixed size lets through, which knows the open digits by hash, move, once, by group and salt, and stay
there for all further digits. Histograms of separate days or files add up to those of the whole: ``summary`` gives them to a chosen number of
digits, ``combine`` adds them, ``percentiles_of`` reads percentiles off them with a bounded relative error.

Defined cases: nulls and NaN are no values; a group without values has no row; a null group key is a group of its own; -0 is
0; the percentile is the smallest value whose share of values at or below it is at least the asked one; ties are one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.common import settled

BITS = 64
#: Bits decided by each pass. The leading digit has the sign, the exponent and four bits of the fraction.
WIDTHS = (16, 16, 16, 16)
#: Parts of a group's values.
SALTS = 64
#: Words of 64 bits of the filter, 1 MB whatever the data.
FILTER_WORDS = 1 << 17
_FRACTION = 1 << 52


def with_key(rows: DataFrame, x: Column, name: str = "key") -> DataFrame:
    """Adds a bigint with the order of the double ``x``: its exponent and fraction, negative for negative values, 0 for a null. Step by step, so that each logarithm
    and power is computed once."""
    least = 2.0**-1022
    rows = rows.withColumns({"_a": F.abs(x), "_neg": x < 0})
    rows = rows.withColumn("_guess", F.least(F.greatest(F.floor(F.log2("_a")), F.lit(-1022)), F.lit(1023)))
    rows = rows.withColumn("_two", F.pow(F.lit(2.0), F.col("_guess")))
    # the logarithm may be off by one next to a power of two
    over, under = F.col("_two") > F.col("_a"), F.col("_two") * 2 <= F.col("_a")
    rows = rows.withColumns(
        {
            "_power": F.greatest(F.when(over, F.col("_guess") - 1).when(under, F.col("_guess") + 1).otherwise(F.col("_guess")), F.lit(-1022)),
            "_unit": F.greatest(F.when(over, F.col("_two") / 2).when(under, F.col("_two") * 2).otherwise(F.col("_two")), F.lit(least)),
        }
    )
    normal = (F.col("_power") + 1022) * F.lit(_FRACTION) + (F.col("_a") / F.col("_unit") * F.lit(float(_FRACTION))).cast("bigint")
    rows = rows.withColumn("_bits", F.when(F.col("_a") == 0, F.lit(0)).when(F.col("_a") == float("inf"), F.lit(2047 * _FRACTION)).otherwise(normal).cast("bigint"))
    return rows.withColumn(name, F.coalesce(F.when(F.col("_neg"), -F.col("_bits")).otherwise(F.col("_bits")), F.lit(0).cast("bigint"))).drop("_a", "_neg", "_guess", "_two", "_power", "_unit", "_bits")


def value_of(key: Column) -> Column:
    """The double that ``with_key`` mapped to ``key``."""
    a = F.abs(key)
    power = F.greatest(F.shiftright(a, 52), F.lit(1))
    x = (a - (power - 1) * F.lit(_FRACTION)).cast("double") / F.lit(float(_FRACTION)) * F.pow(F.lit(2.0), (power - 1023).cast("double"))
    x = F.when(a == 2047 * _FRACTION, F.lit(float("inf"))).otherwise(x)
    return F.when(key < 0, -x).otherwise(x)


def usable(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def _rank(permille: int, total: Column) -> Column:
    """From 1: the least whole number that is at least the share of the total."""
    return F.greatest(F.floor((F.lit(permille) * total + 999) / 1000).cast("bigint"), F.lit(1))


def _histogram(rows: DataFrame, keys: list[str], shift: int) -> DataFrame:
    return rows.groupBy(*keys, F.shiftright("key", shift).alias("digit")).agg(F.count(F.lit(1)).alias("here"), F.min("key").alias("low"), F.max("key").alias("high"))


def _same(a: str, b: str, columns: list[str]) -> Column:
    return F.expr(" and ".join(f"{a}.`{c}` <=> {b}.`{c}`" for c in columns))


def _bit(columns: list[Column]) -> tuple[Column, Column]:
    """The word and the bit of a key in the filter."""
    at = F.pmod(F.xxhash64(*columns), F.lit(FILTER_WORDS * 64))
    return F.shiftright(at, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))


def _filter(keys: DataFrame, columns: list[str]) -> Column:
    """The words of a filter with the bits of all keys, as a subquery. It lets some others through, all of them at worst."""
    word, bit = _bit([F.col(c) for c in columns])
    none = keys.sparkSession.range(FILTER_WORDS).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = keys.select(word.alias("word"), bit.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).unionByName(none)
    whole = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return whole.select(F.transform("words", lambda w: w["bits"])).scalar()


def grouped(rows: DataFrame, groupings: dict[str, list[str]], *values: str) -> DataFrame:
    """Every row once for each grouping: ``grouping``, all group columns, with nulls for those that the grouping doesn't have, and the values."""
    columns = list(dict.fromkeys(c for own in groupings.values() for c in own))
    types = {c: rows.schema[c].dataType for c in columns}
    each = [F.struct(F.lit(name).alias("grouping"), *((F.col(c) if c in own else F.lit(None).cast(types[c])).alias(c) for c in columns)) for name, own in groupings.items()]
    return rows.select(F.explode(F.array(*each)).alias("g"), *values).select("g.*", *values)


def radix_select(rows: DataFrame, groupings: dict[str, list[str]], permilles: tuple[int, ...], widths: tuple[int, ...] = WIDTHS, salts: int = SALTS) -> DataFrame:
    """``rows``: the group columns and ``key`` (see ``with_key``). Returns ``grouping``, the group columns, null where a grouping doesn't have them, ``n`` (values
    in the group), ``permille`` and ``key``.

    The first pass shuffles histograms, of at most 2^width entries a group; the values then go to their group and salt, where each pass keeps those
    under open digits. The open targets of the first pass, at most three values' worth a group, are written once (see ``settled``), as all that follows reads them.
    """
    shift = BITS - widths[0]
    rows = grouped(rows, groupings, "key")
    groups = [c for c in rows.columns if c != "key"]
    hist = _histogram(rows, groups, shift)
    w = Window.partitionBy(*groups).orderBy("digit")
    whole = Window.partitionBy(*groups)
    below = F.sum("here").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")
    hist = hist.withColumn("below", below).withColumn("n", F.sum("here").over(whole))  # in this order one sort does for both
    asked = F.array(*[F.struct(F.lit(p).alias("permille"), _rank(p, F.col("n")).alias("rank")) for p in permilles])
    inside = lambda t: (t["rank"] > F.col("below")) & (t["rank"] <= F.col("below") + F.col("here"))
    targets = hist.withColumn("t", F.explode(F.filter(asked, inside))).select(*groups, "n", "t.permille", (F.col("t.rank") - F.col("below")).alias("rest"), "digit", "here", "low", "high")
    found = []
    for width in (*widths[1:], 0):
        value = F.when(F.col("rest") == 1, F.col("low")).when(F.col("rest") == F.col("here"), F.col("high")).when(F.col("low") == F.col("high"), F.col("low"))
        found.append(targets.withColumn("key", value).filter("key is not null").select(*groups, "n", "permille", "key"))
        if not width:
            break
        pending = targets.filter("low < high and rest > 1 and rest < here")
        if len(found) == 1:
            pending = settled(pending)
        opened = pending.select(*groups, "digit").distinct()
        if len(found) == 1:
            word, bit = _bit([*(F.col(c) for c in groups), F.shiftright("key", shift)])
            rows = rows.filter(F.get(_filter(opened, [*groups, "digit"]), word).bitwiseAND(bit) != 0)
            rows = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
        follow = opened.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        # the digit is no join key, so that values stay where their group and salt are; never by broadcast, as the sizes that Spark goes by leave out the salts
        here = F.expr(f"shiftright(r.key, {shift}) - f.digit = 0")
        rows = rows.alias("r").join(follow.hint("merge").alias("f"), _same("r", "f", groups) & F.expr("r.salt = f.salt") & here, "left_semi")
        marked = rows.withColumn("under", F.shiftright("key", shift))
        shift -= width
        hist = _histogram(marked, [*groups, "under"], shift)
        inner = Window.partitionBy(*groups, "under").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("below", F.sum("here").over(inner) - F.col("here"))
        o = pending.withColumnRenamed("digit", "under").drop("low", "high", "here")
        both = o.alias("o").join(hist.alias("h"), _same("o", "h", [*groups, "under"]))
        targets = both.filter("o.rest > h.below and o.rest <= h.below + h.here").select(*(F.col(f"o.{c}") for c in (*groups, "n", "permille")), (F.col("o.rest") - F.col("h.below")).alias("rest"), "h.digit", "h.here", "h.low", "h.high")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def summary(rows: DataFrame, groups: list[str], bits: int = 24) -> DataFrame:
    """Mergeable histograms: ``digit`` of the leading ``bits`` bits and ``here``, by group. A digit's values differ by a factor of at most
    1 + 2^(12 - bits)."""
    return rows.groupBy(*groups, F.shiftright("key", BITS - bits).alias("digit")).agg(F.count(F.lit(1)).alias("here"))


def combine(parts: DataFrame, groups: list[str]) -> DataFrame:
    """Adds up summaries, of separate days or files or of finer groups, to those of ``groups``."""
    return parts.groupBy(*groups, "digit").agg(F.sum("here").alias("here"))


def percentiles_of(parts: DataFrame, groups: list[str], permilles: tuple[int, ...], bits: int = 24) -> DataFrame:
    """Group columns, ``n``, ``permille`` and ``value``, the end of the digit's range that is nearer to 0, off by a share of 2^(12 - bits) at most
    (values below 2^-1022 aside). A group has at most 2^bits digits."""
    w = Window.partitionBy(*groups).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    hist = parts.withColumns({"n": F.sum("here").over(Window.partitionBy(*groups)), "below": F.sum("here").over(w) - F.col("here")})
    asked = F.array(*[F.struct(F.lit(p).alias("permille"), _rank(p, F.col("n")).alias("rank")) for p in permilles])
    low = F.shiftleft("digit", BITS - bits)
    near = F.when(F.col("digit") < 0, low + F.lit((1 << (BITS - bits)) - 1)).otherwise(low)
    return hist.withColumn("t", F.explode(asked)).filter("t.rank > below and t.rank <= below + here").select(*groups, "n", "t.permille", value_of(near).alias("value"))
