"""Operators on ordered relations: running aggregates, row references, rows at an optimum, pivot, unpivot, disjoint intervals.

All are window functions, grouped aggregates or joins; only the exponential average runs Python, a partition at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.rel import Rel


def running(rel: Rel, **columns: Column) -> DataFrame:
    """Adds each aggregate over the rows from the partition's first to the current one: T.f(x)."""
    return rel.df.withColumns({name: c.over(rel.running()) for name, c in columns.items()})


def at(rel: Rel, column: str, index: int) -> Column:
    """T[i].c: the i-th row from the partition's first if i >= 0, else the row -i before the current one."""
    return F.nth_value(column, index + 1).over(rel.running()) if index >= 0 else F.lag(column, -index).over(rel.window())


def lag(rel: Rel, column: Column, k: int, default=None) -> Column:
    return F.lag(column, k, default).over(rel.window())


def nth_value(rel: Rel, column: str, n: int, default: Column | None = None) -> Column:
    """The n-th value of the rows so far (from 1), or the default while there are fewer."""
    value = F.nth_value(column, n).over(rel.running())
    return value if default is None else F.when(F.count(F.lit(1)).over(rel.running()) >= n, value).otherwise(default)


def ranked(rel: Rel, *keys: Column) -> tuple[Column, Column]:
    """(RANK, DENSE_RANK) by the arguments, which are what the relation is ordered by."""
    by = Window.partitionBy(*rel.partition).orderBy(*keys)
    return F.rank().over(by), F.dense_rank().over(by)


def _last_known(rel: Rel, df: DataFrame, column: str, n: int) -> tuple[DataFrame, object]:
    """A frame of the last n non-null values: ranges over the running count of them."""
    counted = df.withColumn("_c", F.count(column).over(rel.running()))
    return counted, Window.partitionBy(*rel.partition).orderBy("_c").rangeBetween(-(n - 1), 0)


def movavg(rel: Rel, column: str, n: int, name: str) -> DataFrame:
    """Mean of the last n non-null values."""
    df, frame = _last_known(rel, rel.df, column, n)
    return df.withColumn(name, F.when(F.col("_c") > 0, F.avg(column).over(frame))).drop("_c")


def movstddev(rel: Rel, column: str, n: int, name: str) -> DataFrame:
    """Sample deviation of the last n non-null values."""
    df, frame = _last_known(rel, rel.df, column, n)
    return df.withColumn(name, F.when(F.col("_c") > 0, F.stddev_samp(column).over(frame))).drop("_c")


def expmovavg(rel: Rel, column: str, decay: float, name: str) -> DataFrame:
    """s = (1 - d) s + d x over the non-null values, from the first of them; null before it.

    The recurrence goes on over sorted rows of a partition as they stream by, one batch of rows at a time.
    """
    keys = list(rel.partition)
    df = rel.df.select("*", F.row_number().over(rel.window()).alias("_row"))
    schema = T.StructType([*rel.df.schema.fields, T.StructField(name, T.DoubleType())])

    def walk(batches):
        key, state = None, None
        for pdf in batches:
            out = []
            ids = list(zip(*(pdf[k] for k in keys), strict=True)) if keys else [()] * len(pdf)
            for own, x in zip(ids, pdf[column], strict=True):
                if own != key:
                    key, state = own, None
                if not pd.isna(x):
                    state = float(x) if state is None else (1 - decay) * state + decay * float(x)
                out.append(state)
            yield pdf.drop(columns="_row").assign(**{name: pd.Series(out, index=pdf.index, dtype="float64")})

    parted = df.repartition(*keys).sortWithinPartitions(*keys, "_row") if keys else df.coalesce(1).sortWithinPartitions("_row")
    return parted.mapInPandas(walk, schema)


def arg(rel: Rel, *specs: tuple[str, Column]) -> DataFrame:
    """Rows at which each optimum ("MIN" or "MAX", expression) is reached, all ties, nulls aside; several specs are concatenated.

    Of a partition, each task keeps the best rows it has before they are shuffled (window group limit). Without a partition the optimum is an aggregate.
    """
    found = []
    for kind, x in specs:
        df = rel.df.withColumn("_x", x).where("_x IS NOT NULL")
        if rel.partition:
            order = F.col("_x").asc() if kind.upper() == "MIN" else F.col("_x").desc()
            best = df.withColumn("_k", F.rank().over(Window.partitionBy(*rel.partition).orderBy(order))).where("_k = 1").drop("_k")
        else:
            optimum = df.agg((F.min if kind.upper() == "MIN" else F.max)("_x").alias("_best"))
            best = df.join(F.broadcast(optimum), F.col("_x") == F.col("_best")).drop("_best")  # a single row
        found.append(best.drop("_x"))
    return reduce(DataFrame.unionAll, found)


def pivot(rel: Rel, aggregate: Callable[[Column], Column], value: Column, by: str, targets: list[tuple[list[str], str | None]]) -> DataFrame:
    """One row a partition; a target aggregates the rows whose upper-cased `by` is among its labels."""
    columns = []
    for labels, name in targets:
        upper = [x.upper() for x in labels]
        columns.append(aggregate(F.when(F.upper(F.col(by).cast("string")).isin(upper), value)).alias(name or "_".join(upper)))
    return rel.df.groupBy(*rel.partition).agg(*columns)


def unpivot(df: DataFrame, value: str, key: str, columns: list[tuple[str, str | None]]) -> DataFrame:
    """value, key and the other columns, one row for each listed column; nulls stay."""
    names = [c for c, _ in columns]
    kind = df.schema[names[0]].dataType
    pairs = F.array(*[F.struct(F.col(c).cast(kind).alias("v"), F.lit(label or c.upper()).alias("k")) for c, label in columns])
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.explode(pairs).alias("_p")).select(F.col("_p.v").alias(value), F.col("_p.k").alias(key), *others)


def split(rel: Rel, lo: str, hi: str, out_lo: str, out_hi: str) -> DataFrame:
    """Elementary intervals, each once for every row that covers it; a row with lo >= hi raises.

    A boundary opens and closes intervals. Boundaries of a partition are listed once each, with the next one; rows meet them by
    partition and range.
    """
    keys = list(rel.partition)
    bounds = rel.df.select(*keys, F.explode(F.array(lo, hi)).alias("_at")).distinct()
    pieces = bounds.withColumn("_to", F.lead("_at").over(Window.partitionBy(*keys).orderBy("_at"))).where("_to IS NOT NULL")
    pieces = pieces.toDF(*[f"_k{i}" for i in range(len(keys))], "_at", "_to")
    checked = rel.df.withColumn("_ok", F.when(F.col(lo) >= F.col(hi), F.raise_error(F.lit(f"{lo} is not below {hi}")).cast("boolean")).otherwise(F.lit(True))).where("_ok")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_at") >= F.col(lo), F.col("_to") <= F.col(hi)]
    joined = checked.join(pieces, reduce(lambda a, b: a & b, on))
    return joined.select(F.col("_at").alias(out_lo), F.col("_to").alias(out_hi), *rel.df.columns)


def labelled(label_column: Column, labels: list[str], aggregate: Callable[[Column], Column], value: Column) -> Column:
    """LABEL(A, B).f(x): the aggregate over rows that carry one of the labels."""
    return aggregate(F.when(F.upper(label_column).isin([x.upper() for x in labels]), value))


def path(rel: Rel, label: str, separator: str, name: str) -> DataFrame:
    """The labels of a partition's rows, joined in order."""
    df = rel.df.withColumn("_n", F.row_number().over(rel.window()))
    held = F.array_sort(F.collect_list(F.struct("_n", F.col(label).alias("x"))))
    return df.groupBy(*rel.partition).agg(F.array_join(F.transform(held, lambda e: e["x"]), separator).alias(name))
