"""Typed re-read of exported CSV (S7): types inferred from all rows.

Each value has the set of types that can hold it, as bits. A column's set is the
intersection (``bit_and``) over its rows, so the sets merge associatively: one
aggregate with a partial result per task reads them off every row, and the same
rows give the same types however they are split. The narrowest type left is the
column's:

* boolean (``true`` / ``false``), bigint (up to 18 digits), decimal as wide as
  the longest integer part and scale, double (exponents, ``NaN``, over 38 digits);
* date, timestamp_ntz (no zone), timestamp (with a zone); impossible days are text;
* string, which holds everything. A quoted empty field is a text.

NULLs fit every type; a column of NULLs only is a string, as is every column of a
file without rows. Leading zeros do not make a number a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources import csv_io

BOOLEAN, BIGINT, DECIMAL, DOUBLE, DATE, LOCAL, ZONED, STRING = (1 << i for i in range(8))
NAMES = {BOOLEAN: "boolean", BIGINT: "bigint", DOUBLE: "double", DATE: "date",
         LOCAL: "timestamp_ntz", ZONED: "timestamp", STRING: "string"}
MAX_DIGITS = 38

_PLAIN = r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)"
_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_TIME = r"[ T][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?"
_ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})"


def _holders(v: Column) -> Column:
    """The types that can hold a text, as bits; NULL for NULL."""
    def like(pattern: str) -> Column:
        return v.rlike(f"^({pattern})$")

    def real(kind: str) -> Column:
        return v.try_cast(kind).isNotNull()

    return (F.when(v.isNull(), None)
            .when(like("[+-]?[0-9]{1,18}"), BIGINT | DECIMAL | DOUBLE | STRING)
            .when(like(_PLAIN), DECIMAL | DOUBLE | STRING)
            .when(like(_PLAIN + "[eE][+-]?[0-9]{1,3}|NaN|[+-]?Infinity"), DOUBLE | STRING)
            .when(like("(?i)true|false"), BOOLEAN | STRING)
            .when(like(_DAY) & real("date"), DATE | LOCAL | STRING)
            .when(like(_DAY + _TIME) & real("timestamp_ntz"), LOCAL | STRING)
            .when(like(_DAY + _TIME + _ZONE) & real("timestamp"), ZONED | STRING)
            .otherwise(STRING))


def column_types(texts: DataFrame) -> list[str]:
    """The narrowest type of each (string) column, over all rows."""
    aggs = []
    for i, c in enumerate(texts.columns):
        v = F.col(c)
        whole = F.char_length(F.regexp_replace(F.substring_index(v, ".", 1), "^[+-]", ""))
        scale = F.char_length(v) - F.char_length(F.substring_index(v, ".", 1)) - 1
        # Text lengths only matter where every value turns out to be a number.
        aggs += [F.bit_and(_holders(v)).alias(f"bits_{i}"), F.max(whole).alias(f"whole_{i}"),
                 F.max(F.greatest(scale, F.lit(0))).alias(f"scale_{i}")]
    row = texts.agg(*aggs).first()
    return [_narrowest(row[f"bits_{i}"], row[f"whole_{i}"], row[f"scale_{i}"])
            for i in range(len(texts.columns))]


def _narrowest(bits: int | None, whole: int, scale: int) -> str:
    if bits is None:
        return NAMES[STRING]
    kind = bits & -bits
    if kind != DECIMAL:
        return NAMES[kind]
    digits = max(whole + scale, 1)
    return f"decimal({digits},{scale})" if digits <= MAX_DIGITS else NAMES[DOUBLE]


def typed(df: DataFrame) -> DataFrame:
    """``df`` (string columns) with each column cast to its inferred type."""
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{i}").cast(kind).alias(name) for i, (name, kind) in enumerate(
        zip(df.columns, column_types(flat), strict=True))])


def read_typed_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header CSV (a file or an exported folder) with inferred types."""
    return typed(csv_io.read_csv(spark, path, None, multi_line))
