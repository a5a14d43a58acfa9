"""Transforms of a plot's data, and transforms of whole partitions that users bring."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.rel import Rel


def bins(df: DataFrame, x: str, width: float, keys: tuple[str, ...] = (), least: float | None = None) -> DataFrame:
    """xmin, xmax, freq of each bin that has rows, a group of keys at a time; bins start at the group's least value unless told."""
    known = df.where(F.col(x).isNotNull()).withColumn("_x", F.col(x).cast("double"))
    if least is None:
        known = known.join(known.groupBy(*keys).agg(F.min("_x").alias("_least")), list(keys)) if keys else known.join(F.broadcast(known.agg(F.min("_x").alias("_least"))), F.lit(True))
    else:
        known = known.withColumn("_least", F.lit(float(least)))
    number = F.floor((F.col("_x") - F.col("_least")) / width)
    counted = known.groupBy(*keys, "_least", number.alias("_bin")).agg(F.count(F.lit(1)).alias("freq"))
    begin = F.col("_least") + F.col("_bin") * width
    return counted.select(*keys, begin.alias("xmin"), (begin + width).alias("xmax"), "freq")


def bins2d(
    df: DataFrame, x: str, y: str, width: tuple[float, float], keys: tuple[str, ...] = (), least: tuple[float | None, float | None] = (0.0, 0.0)
) -> DataFrame:
    """Counts in rectangles, and as a share of the fullest rectangle of the group; where `least` is None, rectangles start at the group's least value."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    values = [F.col(c).cast("double") for c in (x, y)]
    unknown = [F.min(v).alias(f"_least{i}") for i, v in enumerate(values) if least[i] is None]
    if unknown:
        lowest = known.groupBy(*keys).agg(*unknown)
        known = known.join(lowest, list(keys)) if keys else known.join(F.broadcast(lowest), F.lit(True))
    begins = [F.col(f"_least{i}") if o is None else F.lit(float(o)) for i, o in enumerate(least)]
    place = [F.floor((v - o) / w) for v, o, w in zip(values, begins, width, strict=True)]
    edges = [f"_edge{i}" for i in range(2)]
    counted = known.groupBy(*keys, *[o.alias(e) for o, e in zip(begins, edges, strict=True)], place[0].alias("_i"), place[1].alias("_j")).agg(F.count(F.lit(1)).alias("freq"))
    if keys:
        counted = counted.withColumn("nfreq", F.col("freq") / F.max("freq").over(Window.partitionBy(*keys)))
    else:
        fullest = F.broadcast(counted.agg(F.max("freq").alias("_most")))
        counted = counted.join(fullest, F.lit(True)).withColumn("nfreq", F.col("freq") / F.col("_most"))
    xmin, ymin = (F.col(e) + F.col(n) * w for e, n, w in zip(edges, ("_i", "_j"), width, strict=True))
    return counted.select(*keys, xmin.alias("xmin"), (xmin + width[0]).alias("xmax"), ymin.alias("ymin"), (ymin + width[1]).alias("ymax"), "freq", "nfreq")


def dodge(rel: Rel, pad: float = 0.2) -> DataFrame:
    """Places rows of a partition side by side: (i + pad + 0.5) / (n + 2 pad)."""
    i, n = F.row_number().over(rel.window()) - 1, F.count(F.lit(1)).over(Window.partitionBy(*rel.partition))
    return rel.df.withColumn("dodge", (i + pad + 0.5) / (n + 2 * pad)).withColumn("barwidth", 1 / (n + 2 * pad))


def stack(rel: Rel, y: str) -> DataFrame:
    """Adds the sum of the rows below and the number of the row, from 0."""
    below = F.sum(y).over(rel.window().rowsBetween(Window.unboundedPreceding, -1))
    return rel.df.withColumn("below", F.coalesce(below, F.lit(0.0))).withColumn("stackindex", F.row_number().over(rel.window()) - 1)


def dodge_bar(rel: Rel, padding: float = 0.0, outer_padding: float = 0.2) -> DataFrame:
    """Left edges and widths of bars side by side; `padding` is the share of a bar's place that stays free."""
    i, n = F.row_number().over(rel.window()) - 1, F.count(F.lit(1)).over(Window.partitionBy(*rel.partition))
    place = 1 / (n + 2 * outer_padding - padding)
    return rel.df.withColumn("dodge", place * (i + outer_padding)).withColumn("barwidth", place * (1 - padding))


def stack_bar(rel: Rel, y: str, padding: float = 0.1) -> DataFrame:
    """Bars on top of each other: the sum of the bars below, one left edge and one width for all."""
    return stack(rel, y).drop("stackindex").withColumn("left", F.lit(padding / 2)).withColumn("barwidth", F.lit(1 - padding))


def jitter(df: DataFrame, column: str, width: float = 0.4, seed: int | None = None) -> DataFrame:
    noise = F.rand(seed) if seed is not None else F.rand()
    return df.withColumn(column, F.col(column) + (2 * noise - 1) * width)


def loess_fit(x: np.ndarray, y: np.ndarray, bandwidth: float = 0.3, iterations: int = 2, accuracy: float = 1e-12, weight: np.ndarray | None = None) -> np.ndarray:
    """Local linear regression with tricube weights and `iterations` robustness passes, at each x (sorted)."""
    n = len(x)
    given = np.ones(n) if weight is None else np.asarray(weight, float)
    if n <= 2:
        return np.asarray(y, float).copy()
    span = max(2, int(bandwidth * n))
    robust, fit, left = np.ones(n), np.zeros(n), 0
    for again in range(iterations + 1):
        left = 0
        for i in range(n):
            while left + span < n and x[left + span] - x[i] < x[i] - x[left]:
                left += 1
            part = slice(left, left + span)
            reach = max(x[i] - x[left], x[left + span - 1] - x[i])
            u = np.minimum(1, np.abs(x[part] - x[i]) / (reach * 1.001 if reach > 0 else 1.0))
            w = (1 - u**3) ** 3 * robust[part] * given[part]
            total = w.sum()
            if total == 0:
                fit[i] = y[i]
                continue
            mx, my = (w * x[part]).sum() / total, (w * y[part]).sum() / total
            sxx = (w * (x[part] - mx) ** 2).sum() / total
            slope = 0.0 if np.sqrt(sxx) < accuracy else ((w * (x[part] - mx) * (y[part] - my)).sum() / total) / sxx
            fit[i] = my + slope * (x[i] - mx)
        if again < iterations:
            off = np.abs(y - fit)
            median = np.median(off)
            if median < accuracy:
                break
            robust = np.clip(1 - (off / (6 * median)) ** 2, 0, None) ** 2
    return fit


def loess(
    df: DataFrame, x: str, y: str, keys: tuple[str, ...], bandwidth: float = 0.3, iterations: int = 2, accuracy: float = 1e-12, weight: str | None = None
) -> DataFrame:
    """keys, x, y smoothed along x, by the column of weights if one is named; a group is held by one task, narrowed to these columns.

    Rows without x, y or weight are left out.
    """
    schema = ", ".join([*(f"`{k}` {dict(df.dtypes)[k]}" for k in keys), f"`{x}` double, `{y}` double"])

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x, kind="stable")
        weights = None if weight is None else pdf["_weight"].to_numpy()
        return pdf.assign(**{y: loess_fit(pdf[x].to_numpy(), pdf[y].to_numpy(), bandwidth, iterations, accuracy, weights)})[[*keys, x, y]]

    weights = [] if weight is None else [F.col(weight).cast("double").alias("_weight")]
    known = df.select(*keys, F.col(x).cast("double"), F.col(y).cast("double"), *weights)
    return known.dropna(subset=[x, y, *(["_weight"] if weight else [])]).groupBy(*keys).applyInPandas(smooth, schema)


def stat(kind: str, df: DataFrame, x: str, y: str | None = None, keys: tuple[str, ...] = (), **parameters) -> DataFrame:
    """BIN, BIN2D or SMOOTH (or HIST, HIST2D, LOESS) by name, with parameters named as in a plot, in any case."""
    given = {name.upper(): value for name, value in parameters.items()}

    def width(*names: str) -> float:
        found = next((given[n] for n in names if given.get(n) is not None), None)
        if found is None:
            raise ValueError(f"{kind}: parameter {names[-1]} is missing")
        if found <= 0:
            raise ValueError(f"{kind}: {names[0]} must be above zero")
        return float(found)

    match kind.upper():
        case "BIN" | "HIST":
            return bins(df, x, width("BINWIDTH"), keys, given.get("MIN"))
        case "BIN2D" | "HIST2D":
            return bins2d(df, x, y, (width("XBINWIDTH", "BINWIDTH"), width("YBINWIDTH", "BINWIDTH")), keys, (given.get("XMIN"), given.get("YMIN")))
        case "SMOOTH" | "LOESS":
            names = {"BANDWIDTH": "bandwidth", "ITERS": "iterations", "ACCURACY": "accuracy", "WEIGHT": "weight"}
            return loess(df, x, y, keys, **{names[n]: v for n, v in given.items() if v is not None})
    raise ValueError(f"unknown stat {kind}")


def join_transform(rel: Rel, inputs: list[str], run: Callable[[pd.DataFrame], Iterable[tuple]], outputs: dict[str, str]) -> DataFrame:
    """Rows of a partition beside the rows that `run` makes of it, in order, the shorter side filled with nulls."""
    kinds, keys = dict(rel.df.dtypes), list(rel.partition)
    numbered = rel.df.withColumn("_row", F.row_number().over(rel.window()))
    schema = ", ".join(f"`{c}` {k}" for c, k in [*kinds.items(), *outputs.items()])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row").drop(columns="_row").reset_index(drop=True)
        made = pd.DataFrame(list(run(pdf[inputs])), columns=list(outputs), dtype=object)
        both = pd.concat([pdf.astype(object), made], axis=1)
        for k in keys:
            both[k] = pdf[k].iloc[0]
        return both.astype(object).where(both.notna(), None)

    return numbered.groupBy(*rel.partition).applyInPandas(walk, schema)


def union_transform(rel: Rel, inputs: list[str], run: Callable[[pd.DataFrame], Iterable[tuple]], outputs: dict[str, str]) -> DataFrame:
    """The input rows, then the rows that `run` makes of each partition with the partition's columns filled in."""
    kinds, keys = dict(rel.df.dtypes), list(rel.partition)
    numbered = rel.df.withColumn("_row", F.row_number().over(rel.window()))
    schema = ", ".join(f"`{c}` {k}" for c, k in [*((k, kinds[k]) for k in rel.partition), *outputs.items()])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame(list(run(pdf.sort_values("_row")[inputs].reset_index(drop=True))), columns=list(outputs), dtype=object)
        for k in reversed(keys):
            made.insert(0, k, pdf[k].iloc[0])
        return made

    return rel.df.unionByName(numbered.groupBy(*rel.partition).applyInPandas(walk, schema), allowMissingColumns=True)


def position(kind: str, rel: Rel, y: str | None = None, **options) -> DataFrame:
    """DODGE, DODGE_BAR, STACK, STACK_BAR, JITTER or OFFSET (columns as they are) by name."""
    match kind.upper():
        case "DODGE":
            return dodge(rel, **options)
        case "DODGE_BAR":
            return dodge_bar(rel, **options)
        case "STACK":
            return stack(rel, y)
        case "STACK_BAR":
            return stack_bar(rel, y, **options)
        case "JITTER":
            return jitter(rel.df, y, **options)
        case "OFFSET":
            return rel.df
    raise ValueError(f"unknown position {kind}")
