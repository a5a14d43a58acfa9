"""Relational operators that Spark's DataFrame API lacks or treats differently."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of either side of a join without equal keys, so many bytes of its inputs (as the optimizer estimates) meet in one task; and the most pairs of blocks.
BLOCK_BYTES, MOST_BLOCKS = 256 << 10, 10_000


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; Spark keeps one row a key before it shuffles (window group limit)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("a natural join needs a common column")
    return left.join(right, common, how)


def _bytes(df: DataFrame) -> int:
    """About how large a relation's inputs are; its rows are counted where Spark doesn't know. It decides numbers of tasks only, never results."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return found if found < 1 << 60 else df.count() * 16


def theta_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """An inner join without equal keys, by blocks.

    Spark compares all pairs in as many tasks as one side has partitions. Here rows of both sides are dealt into blocks at random, and each pair of
    blocks meets in one task, so that the number of tasks follows the number of pairs. Sides of one block are left to Spark.
    """
    a, b = (max(1, math.ceil(_bytes(df) / BLOCK_BYTES)) for df in (left, right))
    if a * b == 1:
        return left.join(right, on)
    if a * b > MOST_BLOCKS:
        part = math.sqrt(MOST_BLOCKS / (a * b))
        a, b = (min(MOST_BLOCKS, max(1, int(n * part))) for n in (a, b))
    tasks = max(a * b, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def dealt(df: DataFrame, own: int, other: int, key: str, place: Column) -> DataFrame:
        found = df.withColumn("_own", F.floor(F.rand(7) * own).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        return found.withColumn(key, place).drop("_own", "_other").repartition(tasks, key)

    lefts = dealt(left, a, b, "_left_block", F.col("_own") * b + F.col("_other"))
    rights = dealt(right, b, a, "_right_block", F.col("_other") * b + F.col("_own"))
    return lefts.join(rights.hint("shuffle_hash"), (F.col("_left_block") == F.col("_right_block")) & on).drop("_left_block", "_right_block")


def top(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sort with limit and offset in one operator."""
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def compound(kind: str, left: DataFrame, right: DataFrame, keep_all: bool = False) -> DataFrame:
    """UNION, INTERSECT or EXCEPT by position, names from the left."""
    if len(left.columns) != len(right.columns):
        raise ValueError(f"{kind} of {len(left.columns)} and {len(right.columns)} columns")
    named = right.toDF(*left.columns)
    if kind == "UNION":
        return left.union(named) if keep_all else left.union(named).distinct()
    if kind == "INTERSECT":
        return left.intersectAll(named) if keep_all else left.intersect(named)
    return left.exceptAll(named) if keep_all else left.subtract(named)


def compare_all(df: DataFrame, x: str, op: str, values: DataFrame, every: bool = True) -> DataFrame:
    """Rows for which x op ALL (or ANY) of a one-column relation holds: one aggregate of the relation instead of a nested loop."""
    column = values.columns[0]
    if op == "=" and not every or op in ("<>", "!=") and every:
        return _compare_equal(df, x, values.toDF("_value"), every)
    facts = values.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count(F.lit(1)).alias("_n"), F.count(column).alias("_known"), F.count_distinct(column).alias("_kinds"))
    lo, hi, n, known, kinds = (F.col(c) for c in ("_lo", "_hi", "_n", "_known", "_kinds"))
    v = F.col(x)
    if every:
        test = {">": v > hi, ">=": v >= hi, "<": v < lo, "<=": v <= lo, "=": (kinds <= 1) & (v == lo)}[op]
        holds = (n == 0) | ((known == n) & test)
    else:
        holds = (known > 0) & {">": v > lo, ">=": v >= lo, "<": v < hi, "<=": v <= hi, "<>": (kinds > 1) | (v != lo), "!=": (kinds > 1) | (v != lo)}[op]
    # The aggregate is a single row.
    return df.join(F.broadcast(facts), F.lit(True)).where(holds).select(*df.columns)


def _compare_equal(df: DataFrame, x: str, values: DataFrame, every: bool) -> DataFrame:
    """x = ANY, or x <> ALL: a semi or anti join; with a null among the values no row is known to differ from all."""
    if not every:
        return df.join(values, F.col(x) == F.col("_value"), "left_semi")
    facts = values.agg(F.count(F.lit(1)).alias("_n"), F.count("_value").alias("_known"))
    holds = (F.col("_n") == 0) | (F.col("_known") == F.col("_n")) & F.col(x).isNotNull()
    open_ = df.join(F.broadcast(facts), F.lit(True)).where(holds).select(*df.columns)  # a single row
    return open_.join(values, F.col(x) == F.col("_value"), "left_anti")


def approximate_distinct(df: DataFrame, keys: list[str], column: str, error: float = 0.02) -> DataFrame:
    return df.groupBy(*keys).agg(F.approx_count_distinct(column, error).alias("n"))
