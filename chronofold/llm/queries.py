"""Queries of the language-model operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.common import table, use_utc
from chronofold.llm import bpe, packing, percentiles, textstats

PERMILLES = (500, 900, 990)
#: Groupings of p5: name -> group columns.
GROUPINGS = {"event_type": ["event_type"], "user": ["user_id"], "day": ["on_day"], "event_type_user_day": ["event_type", "user_id", "on_day"], "all": []}


def _latencies(spark: SparkSession, d: str) -> DataFrame:
    use_utc(spark)
    rows = table(spark, d, "app_event").select("event_type", F.col("entities")["user"].alias("user_id"), F.to_date("event_time").alias("on_day"), F.col("attrs.latency_ms").alias("x"))
    return percentiles.with_key(rows.filter(percentiles.usable(F.col("x"))), F.col("x")).drop("x")


_COLUMNS = ("event_type", "user_id", "on_day")
_SHOWN = ("grouping", "event_type", "user_id", "cast(on_day as string) as on_day", "n", "permille")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the latency by event type, by user, by day, by all three together and over all."""
    found = percentiles.radix_select(_latencies(spark, d), GROUPINGS, PERMILLES)
    return found.withColumn("value", percentiles.value_of(F.col("key"))).selectExpr(*_SHOWN, "value")


def p5_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same percentiles to a relative error of 2^-12, from the added-up summaries of separate event types, users and days."""
    parts = percentiles.summary(_latencies(spark, d), list(_COLUMNS))
    groups = ["grouping", *_COLUMNS]
    return percentiles.percentiles_of(percentiles.combine(percentiles.grouped(parts, GROUPINGS, "digit", "here"), groups), groups, PERMILLES).selectExpr(*_SHOWN, "value")


def p5_error(spark: SparkSession, d: str) -> DataFrame:
    """Is each merged percentile as near to the exact one as stated?"""
    groups = ["grouping", *_COLUMNS]
    exact = p5_percentiles(spark, d).withColumnRenamed("value", "exact").alias("x")
    same = F.expr(" and ".join(f"m.`{c}` <=> x.`{c}`" for c in (*groups, "n", "permille")))
    both = p5_merged(spark, d).alias("m").join(exact, same, "full_outer")
    near = F.coalesce(F.abs(F.col("value") - F.col("exact")) <= F.abs("exact") * 2.0**-12, F.lit(False))
    return both.select(*(F.coalesce(f"m.{c}", f"x.{c}").alias(c) for c in (*groups, "n", "permille")), near.alias("near"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(bpe.count_tokens(table(spark, d, "documents")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_statistics(spark, d).filter("doc_kind is not null").select("doc_id", "doc_kind")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return textstats.text_statistics(table(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p5_percentiles, p5_merged, p5_error, p8_ids, p9_containers, p10_found, p10_statistics)}


_RANKED = """select '{name}' as "grouping", {cols}, count(*) over (partition by {part}) as n,
  row_number() over (partition by {part} order by x) as place, x from v"""


def oracle_sql() -> dict[str, str]:
    parts = []
    for name, groups in GROUPINGS.items():
        cols = ", ".join(c if c in groups else f"cast(null as varchar) as {c}" for c in ("event_type", "user_id", "on_day"))
        parts.append(_RANKED.format(name=name, cols=cols, part=", ".join(groups) or "1"))
    asked = ", ".join(f"({p})" for p in PERMILLES)
    exact = f"""with v as (select event_type, entities['user'] as user_id, strftime(event_time, '%Y-%m-%d') as on_day, attrs.latency_ms as x
  from app_event where attrs.latency_ms is not null and not isnan(attrs.latency_ms)),
ranked as ({" union all ".join(parts)})
select "grouping", event_type, user_id, on_day, n, cast(permille as integer) as permille, x as value
from ranked join (values {asked}) as asked(permille) on place = greatest(1, (permille * n + 999) // 1000)"""
    return {"p5_percentiles": exact, "p5_error": f"""select "grouping", event_type, user_id, on_day, n, permille, true as near from ({exact})"""}
