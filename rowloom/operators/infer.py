"""TYPEINFER: the types that text columns could have, from one aggregate over a look-ahead, then casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import casts

#: Shapes that a value can have; a value that has the shape is cast once to see that it fits.
_WHOLE = r"^\s*[+-]?\d{1,19}\s*$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[dDfF]?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"
_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$"
_TIMESTAMP = r"^\s*\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*$"
_TIME = r"^\s*\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*$"
INT, BIGINT, DOUBLE, DATE, STAMP, TIME, TEXT = (1 << i for i in range(7))


def _kind(c: Column) -> Column:
    """One bit for what a value is; each test is tried only if those before it failed."""
    return (
        F.when(c.isNull(), F.lit(0))
        .when(c.rlike(_WHOLE), F.when(F.length(F.trim(c)) <= 9, INT).when(c.try_cast("int").isNotNull(), INT).when(c.try_cast("bigint").isNotNull(), BIGINT).otherwise(DOUBLE))
        .when(c.rlike(_NUMBER) & c.try_cast("double").isNotNull(), DOUBLE)
        .when(c.rlike(_DATE), DATE)
        .when(c.rlike(_TIMESTAMP), STAMP)
        .when(c.rlike(_TIME) & c.try_cast("time").isNotNull(), TIME)
        .otherwise(TEXT)
    )


def _type(kinds: int) -> str:
    """The narrowest type of values of these kinds; a column of nulls alone stays text."""
    if kinds & TEXT or not kinds:
        return "string"
    if not kinds & ~(INT | BIGINT | DOUBLE):
        return "double" if kinds & DOUBLE else "bigint" if kinds & BIGINT else "int"
    if not kinds & ~(DATE | STAMP):
        return "date" if kinds & DATE else "timestamp_ntz"
    return "time" if kinds == TIME else "string"


def infer_types(df: DataFrame, columns: list[str] | None = None, nulls: list[str] = (), limit: int | None = None) -> DataFrame:
    """Casts text columns to the narrowest type of their values; listed null strings become null.

    The look-ahead (all rows, or `limit` of them) is read when this is called: one scan that classifies each value once. Dates together with
    timestamps give dates. After a limited look-ahead a value that doesn't fit raises.
    """
    kinds = dict(df.dtypes)
    texts = [c for c in (columns or df.columns) if kinds[c] == "string"]
    if not texts:
        return df
    casts.allow_time(df.sparkSession)
    known = df.select([F.when(~F.col(c).isin(*nulls), F.col(c)).alias(c) if nulls and c in texts else F.col(c) for c in df.columns])
    sample = known.select(texts) if limit is None else known.select(texts).limit(limit)
    facts = sample.agg(*[F.coalesce(F.bit_or(_kind(F.col(c))), F.lit(0)).alias(str(i)) for i, c in enumerate(texts)]).first()
    chosen = {c: _type(facts[i]) for i, c in enumerate(texts)}
    return known.select([F.col(c).cast(chosen[c]).alias(c) if chosen.get(c, "string") != "string" else F.col(c) for c in df.columns])
