"""Types by their SQL spelling, and casts with the dialect's rounding."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: SQL spellings and the Spark types that hold them.
TYPES = {
    "INT": "int", "INTEGER": "int", "SMALLINT": "smallint", "BIGINT": "bigint", "REAL": "float", "FLOAT": "double", "BOOL": "boolean", "BOOLEAN": "boolean",
    "CHAR": "string", "BPCHAR": "string", "VARCHAR": "string", "VARCHAR2": "string", "CHAR VARYING": "string", "TEXT": "string",
    "TIMESTAMP": "timestamp_ntz", "TIMESTAMP WITHOUT TIME ZONE": "timestamp_ntz", "TIME": "time", "DATE": "date", "BLOB": "binary", "CLOB": "string",
}
INTEGRAL = ("smallint", "int", "bigint")


def allow_time(spark: SparkSession) -> None:
    """Spark has TIME only where it is switched on; whatever casts to it must ask first."""
    spark.conf.set("spark.sql.timeType.enabled", "true")


def spark_type(name: str, *arguments: int) -> str:
    """The Spark type of a SQL type; an exact numeric of scale 0 is the smallest integer that holds it, others are doubles."""
    upper = re.sub(r"\s+", " ", name.strip().upper())
    if upper in ("DECIMAL", "NUMERIC"):
        precision, scale = (*arguments, 0)[:2] if arguments else (38, 1)
        if scale:
            return "double"
        return "smallint" if precision <= 5 else "int" if precision <= 10 else "bigint"
    if upper not in TYPES:
        raise ValueError(f"unknown type {name}")
    return TYPES[upper]


def cast(column: Column, kind: str, source: str | None = None) -> Column:
    """A cast to a Spark type: numbers round half up to integers, strings give booleans only for TRUE and FALSE, bad input raises."""
    if kind in INTEGRAL and source in ("float", "double", "decimal"):
        return F.round(column.cast("decimal(38,10)"), 0).cast(kind)
    if kind == "boolean" and source == "string":
        upper = F.upper(column)
        return F.when(upper == "TRUE", F.lit(True)).when(upper == "FALSE", F.lit(False)).when(column.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), column)).cast("boolean"))
    if kind == "date" and source in (*INTEGRAL, "double", "float"):
        return F.timestamp_millis(column.cast("bigint")).cast("date")
    if kind in ("double", "float") and source == "string":
        upper = F.upper(F.trim(column))
        return F.when(upper.isin("INFINITY", "+INFINITY"), F.lit(float("inf"))).when(upper == "-INFINITY", F.lit(float("-inf"))).when(upper == "NAN", F.lit(float("nan"))).otherwise(column.cast(kind))
    return column.cast(kind)


def relaxed(kind: str) -> str:
    """The type that plot statistics compute in: any number as double, text as string, dates and times as timestamps."""
    if kind in (*INTEGRAL, "float", "double") or kind.startswith("decimal"):
        return "double"
    return "timestamp_ntz" if kind in ("date", "timestamp", "timestamp_ntz") or kind.startswith("time") else kind
