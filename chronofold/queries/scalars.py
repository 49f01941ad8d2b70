"""Queries of the scalar functions, one per function, over each event's own attributes, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.common import table, use_utc
from chronofold.plans import observations as O
from chronofold.plans.engine import Engine
from chronofold.queries.features import events_store, rounded
from chronofold.sources import EventStore

#: y is a number of either sign, p one in (0, 1), as query text and as SQL.
_Y, _YS = "((value - 50) / 7)", "((value - 50) / 7)"
_P, _PS = "(value / (value + 30))", "(value / (value + 30))"
_MATH = {
    "arith": (f"2 + {_Y} * 3 - value / 4 ^ 2 ^ 0.5", f"2 + {_YS} * 3 - value / pow(4, pow(2, 0.5))"),
    "arith_div_zero": ("if(value > 50, 1, -1) / 0", "case when value > 50 then cast('inf' as double) else cast('-inf' as double) end"),
    "compare": ("if(value <= 20 or value >= 80, if(value != 85, 1, 2), 0)", "case when value <= 20 or value >= 80 then case when value <> 85 then 1 else 2 end else 0 end"),
    "fn_not": ("if(not value > 50, 1, 0)", "case when not value > 50 then 1 else 0 end"),
    "in_floats": ("if(props.k in (1, 2, 3), 1, 0)", "case when k in (1, 2, 3) then 1 else 0 end"),
    "fn_floor": (f"floor({_Y})", f"floor({_YS})"),
    "fn_ceil": (f"ceil({_Y})", f"ceil({_YS})"),
    "fn_round": (f"round({_Y})", f"round({_YS})"),
    "fn_trunc": (f"trunc({_Y})", f"trunc({_YS})"),
    "fn_fract": (f"fract({_Y})", f"{_YS} - trunc({_YS})"),
    "fn_abs": (f"abs({_Y})", f"abs({_YS})"),
    "fn_signum": (f"signum({_Y})", f"case when {_YS} >= 0 then 1.0 else -1.0 end"),
    "fn_div_euclid": (f"div_euclid(round({_Y} * 10), -3)", f"-floor(round({_YS} * 10) / 3)"),
    "fn_rem_euclid": (f"rem_euclid(round({_Y} * 10), -3)", f"round({_YS} * 10) - 3 * floor(round({_YS} * 10) / 3)"),
    "fn_powf": (f"powf({_Y} + 0.5, 3) + 1", f"pow({_YS} + 0.5, 3) + 1"),
    "fn_sqrt": (f"sqrt({_P})", f"sqrt({_PS})"),
    "fn_exp": (f"exp({_P})", f"exp({_PS})"),
    "fn_exp2": (f"exp2({_P})", f"pow(2, {_PS})"),
    "fn_ln": ("ln(value + 1)", "ln(value + 1)"),
    "fn_log": ("log(value + 1, 5)", "ln(value + 1) / ln(5)"),
    "fn_log2": ("log2(value + 1)", "log2(value + 1)"),
    "fn_log10": ("log_10(value + 1)", "log10(value + 1)"),
    "fn_ln_edge": ("ln(if(value > 50, 0, -1))", "case when value > 50 then cast('-inf' as double) else cast('nan' as double) end"),
    "fn_sin": (f"sin({_Y})", f"sin({_YS})"),
    "fn_cos": (f"cos({_Y})", f"cos({_YS})"),
    "fn_tan": (f"tan({_P})", f"tan({_PS})"),
    "fn_asin": (f"asin({_P})", f"asin({_PS})"),
    "fn_acos": (f"acos({_P})", f"acos({_PS})"),
    "fn_atan": (f"atan({_Y})", f"atan({_YS})"),
    "fn_expm1": (f"expm1({_P})", f"exp({_PS}) - 1"),
    "fn_ln1p": ("ln_1p(value)", "ln(1 + value)"),
    "fn_sinh": (f"sinh({_P})", f"sinh({_PS})"),
    "fn_cosh": (f"cosh({_P})", f"cosh({_PS})"),
    "fn_asinh": (f"asinh({_Y})", f"asinh({_YS})"),
    "fn_acosh": ("acosh(value + 1)", "acosh(value + 1)"),
    "fn_atanh": (f"atanh({_P} / 2)", f"atanh({_PS} / 2)"),
    "fn_clamp": ("clamp(value, 20, 60)", "least(greatest(value, 20), 60)"),
    "fn_clamp_null": ("clamp(if(value > 50, value, null), 20, 60)", "case when value > 50 then least(value, 60) end"),
    "fn_null_arith": ("if(value > 50, value, null) * 2 + abs(if(value < 90, value, null))", "case when value > 50 and value < 90 then value * 3 end"),
    "fn_if": ("if(event_type = 'view', value, -1)", "case when event_type = 'view' then value else -1 end"),
    "fn_coalesce": ("coalesce(if(value > 50, value, null), 0)", "case when value > 50 then value else 0 end"),
    "fn_hour": ("hour(event_time)", "hour(ts)"),
    "fn_minute": ("minute(event_time)", "minute(ts)"),
    "fn_second": ("second(event_time)", "second(ts)"),
    "fn_microsecond": ("microsecond(event_time)", "epoch_us(ts) % 1000000"),
}
#: Dates shifted by the value, so that all months and the ends of months and years occur.
_DATE = "date_add(date(event_time), floor(value * 9))"
_DATE_SQL = "(cast(ts as date) + cast(floor(value * 9) as integer))"
_DATES = {
    "fn_date": ("date(event_time)", "cast(ts as date)"),
    "fn_date_text": ("date(if(value > 50, '2024-02-29', '2024-13-01'))", "case when value > 50 then date '2024-02-29' end"),
    "fn_date_add": (_DATE, _DATE_SQL),
    "fn_date_sub": ("date_sub(date(event_time), 31)", "cast(ts as date) - 31"),
    "fn_date_diff": (f"date_diff({_DATE}, '2024-03-01')", f"{_DATE_SQL} - date '2024-03-01'"),
    "fn_year": (f"year({_DATE})", f"year({_DATE_SQL})"),
    "fn_month": (f"month({_DATE})", f"month({_DATE_SQL})"),
    "fn_day": (f"day({_DATE})", f"day({_DATE_SQL})"),
    "fn_week": (f"week({_DATE})", f"weekofyear({_DATE_SQL})"),
    "fn_weekday": (f"weekday({_DATE})", f"isodow({_DATE_SQL})"),
    "fn_day_of_year": (f"day_of_year({_DATE})", f"dayofyear({_DATE_SQL})"),
    "fn_quarter": (f"quarter({_DATE})", f"quarter({_DATE_SQL})"),
    "fn_is_start_of_month": (f"is_start_of_month({_DATE})", f"day({_DATE_SQL}) = 1"),
    "fn_is_end_of_month": (f"is_end_of_month({_DATE})", f"last_day({_DATE_SQL}) = {_DATE_SQL}"),
    "fn_is_weekend": (f"is_weekend({_DATE})", f"isodow({_DATE_SQL}) >= 6"),
    "fn_date_part": (f"date_part('month', {_DATE})", f"month({_DATE_SQL})"),
    "fn_extract": (f"extract('year', {_DATE})", f"year({_DATE_SQL})"),
    "fn_format_date": (f"format_date('%Y/%m/%d', {_DATE})", f"strftime({_DATE_SQL}, '%Y/%m/%d')"),
}
#: Characters that are white space in Unicode, as SQL.
_SPACES = " || ".join(f"chr({c})" for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_TEXTS = {
    "fn_len": ("len(text)", "strlen(text)"),
    "fn_trim": ("trim(concat('  ', concat(text, ' ')))", f"trim(text, {_SPACES})"),
    "fn_lower": ("lower(text)", "lower(text)"),
    "fn_upper": ("upper(source)", "upper(source)"),
    "fn_concat": ("concat(lang, source)", "case when lang is not null and source is not null then lang || source end"),
    "fn_contains": ("contains(text, 'a')", "contains(text, 'a')"),
    "fn_starts_with": ("starts_with(lang, 'e')", "starts_with(lang, 'e')"),
    "fn_ends_with": ("endsWith(source, 'import')", "ends_with(source, 'import')"),
    "fn_substr": ("substr(text, 1, 3)", "case when length(text) >= 4 then substr(text, 2, 3) end"),
    "fn_replace": ("replace(text, 'e', '--')", "replace(text, 'e', '--')"),
    "fn_regex_match": ("regex_match(text, '^[A-M].*e')", "regexp_matches(text, '^[A-M].*e')"),
    "fn_regex_extract": ("regex_extract(text, '[aeiou][a-z]+')", "nullif(regexp_extract(text, '[aeiou][a-z]+'), '')"),
    "fn_regex_replace": ("regex_replace(text, '([aeiou])[a-z]', '<$1>')", "regexp_replace(text, '([aeiou])[a-z]', '<\\1>', 'g')"),
    "fn_regex_split": ("regex_split(text, '[aeiou]')", "array_to_string(regexp_split_to_array(text, '[aeiou]'), '|')"),
    "fn_regex_count": ("regex_count(text, '[a-f]')", "len(regexp_extract_all(text, '[a-f]'))"),
}


def _own_events(spark: SparkSession, d: str, text: str) -> DataFrame:
    store = events_store(spark, d)
    return rounded(Engine(store).query(O.all_events(store), ["event_id as event_id", f"{text} as x"]))


def documents_store(spark: SparkSession, d: str) -> EventStore:
    """Revisions as events of their page."""
    use_utc(spark)
    docs = table(spark, d, "documents")
    return EventStore(
        docs.select(
            F.col("doc_id").cast("string").alias("event_id"), F.lit("revision").alias("event_type"), F.col("rev_time").alias("event_time"),
            F.create_map(F.lit("page"), F.col("page_id").cast("string")).alias("entities"), F.struct("title", "lang", "source", "text").alias("attrs"),
        )
    )


def _own_texts(spark: SparkSession, d: str, text: str) -> DataFrame:
    store = documents_store(spark, d)
    out = Engine(store).query(O.all_events(store), ["event_id as event_id", f"{text} as x"])
    return out.withColumn("x", F.array_join("x", "|")) if "array" in dict(out.dtypes)["x"] else out


def clock(spark: SparkSession, d: str) -> DataFrame:
    """The present: its date is that of its time, whatever they are."""
    store = events_store(spark, d)
    return Engine(store).query(O.fixed(store, ["user"], ["2024-01-05 00:00:00"]), ["@entities.user as user", "date(now()) = current_date() as same_day", "len(current_time()) as n"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: partial(_own_events, text=t) for k, (t, _) in (_MATH | _DATES).items()}
    return out | {k: partial(_own_texts, text=t) for k, (t, _) in _TEXTS.items()} | {"fn_now": clock}


def oracle_sql() -> dict[str, str]:
    ev = "with ev as (select *, cast(json_extract(props, '$.k') as double) as k from events)"
    integer = {"fn_hour", "fn_minute", "fn_second", "fn_microsecond"}
    out = {k: f"{ev} select cast(event_id as varchar) as event_id, " + (f"cast({s} as bigint)" if k in integer else f"round(cast({s} as double) + 1e-8, 6)") + " as x from ev" for k, (_, s) in _MATH.items()}
    for k in ("compare", "fn_not", "in_floats"):
        out[k] = f"{ev} select cast(event_id as varchar) as event_id, cast({_MATH[k][1]} as bigint) as x from ev"
    whole = {"fn_date_diff", "fn_year", "fn_month", "fn_day", "fn_week", "fn_weekday", "fn_day_of_year", "fn_quarter", "fn_date_part", "fn_extract"}
    out |= {k: f"{ev} select cast(event_id as varchar) as event_id, " + (f"cast({s} as bigint)" if k in whole else f"{s}") + " as x from ev" for k, (_, s) in _DATES.items()}
    counts = {"fn_len", "fn_regex_count"}
    # of several revisions of a page at one time the one with the highest id
    revisions = "(select *, row_number() over (partition by page_id, rev_time order by cast(doc_id as varchar) desc) as place from documents where rev_time is not null)"
    out |= {k: "select cast(doc_id as varchar) as event_id, " + (f"cast({s} as bigint)" if k in counts else s) + f" as x from {revisions} where place = 1" for k, (_, s) in _TEXTS.items()}
    out["fn_now"] = """select distinct cast(user_id as varchar) as "user", true as same_day, cast(8 as bigint) as n from events"""
    return out
