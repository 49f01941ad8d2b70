"""Columns that know their kind, so that queries are checked when they are bound."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.fql.lexer import QueryError

NUM, INT, BOOL, STR, DATE, TIME, NULL, MAP, LIST, STRUCT = "num", "int", "bool", "str", "date", "time", "null", "map", "list", "struct"
NUMBERS = (NUM, INT)


@dataclass(frozen=True)
class Typed:
    col: Column
    kind: str
    #: The Spark type of maps, arrays and structs.
    type: T.DataType | None = None

    def num(self, what: str = "value") -> Column:
        """As double; booleans count as 1 and 0."""
        if self.kind in NUMBERS or self.kind == NULL:
            return self.col.cast("double")
        if self.kind == BOOL:
            return self.col.cast("double")
        raise QueryError(f"{what} must be a number, not {self.kind}")

    def need(self, what: str, *kinds: str) -> Column:
        if self.kind not in (*kinds, NULL):
            raise QueryError(f"{what} must be {' or '.join(kinds)}, not {self.kind}")
        return self.col.cast("string") if self.kind == NULL and kinds == (STR,) else self.col


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(t, T.NumericType):
        return NUM
    for cls, kind in ((T.BooleanType, BOOL), (T.StringType, STR), (T.DateType, DATE), (T.TimestampNTZType, TIME), (T.TimestampType, TIME), (T.MapType, MAP), (T.ArrayType, LIST), (T.StructType, STRUCT), (T.NullType, NULL)):
        if isinstance(t, cls):
            return kind
    return STR


def of_type(col: Column, t: T.DataType) -> Typed:
    k = kind_of(t)
    if k == TIME and isinstance(t, T.TimestampType):
        col = col.cast("timestamp_ntz")
    return Typed(col, k, t if k in (MAP, LIST, STRUCT) else None)


def literal(value: object) -> Typed:
    if value is None:
        return Typed(F.lit(None), NULL)
    if isinstance(value, bool):
        return Typed(F.lit(value), BOOL)
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint"), INT)
    return Typed(F.lit(value), NUM if isinstance(value, float) else STR)
