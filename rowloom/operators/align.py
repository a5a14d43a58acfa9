"""Alignment of two sequences: row by row, or by dynamic time warping."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.rel import Rel


def zip_rows(left: Rel, right: Rel) -> DataFrame:
    """Row k of the left beside row k of the right, cut to the shorter side."""
    a = left.df.withColumn("_k", F.row_number().over(left.window()))
    b = right.df.withColumn("_k", F.row_number().over(right.window()))
    keys = list(left.partition)
    return a.join(b, [*keys, "_k"]).drop("_k")


def warp(distance: np.ndarray | Callable[[int, int], float], n: int, m: int, margin: int | None = None) -> list[tuple[int, int]]:
    """Pairs of the cheapest warping path of sequences of n and m rows.

    Only the last min(n, m) rows of each take part. Costs are accumulated from the end, so that the path reads forward; of equal
    costs the diagonal wins on the main diagonal, and off it the step along the row, then the diagonal. What is held is one
    byte for each cell of the band.
    """
    size = min(n, m)
    if size == 0:
        return []
    cost = distance if callable(distance) else lambda i, j: distance[i, j]
    band = max(1, min(abs(margin) if margin is not None else size - 1, size - 1))
    # Cell (i, j) of the reversed order is reached from (i-1, j-1), (i-1, j) or (i, j-1); it lies in column j - i + band of the band.
    step = np.zeros((size, 2 * band + 1), np.int8)
    before = [np.inf] * (2 * band + 2)
    for i in range(size):
        row = [np.inf] * (2 * band + 2)
        for j in range(max(0, i - band), min(size, i + band + 1)):
            k = j - i + band
            d = cost(n - 1 - i, m - 1 - j)
            d = 0.0 if d is None or np.isnan(d) else float(d)
            if i == j == 0:
                row[k] = d
                continue
            diagonal, up, across = (before[k], 0), (before[k + 1], 1), (row[k - 1] if k else np.inf, 2)
            order = (diagonal, up, across) if i == j else (across, diagonal, up) if j > i else (up, diagonal, across)
            best = min(order, key=lambda c: c[0])
            row[k], step[i, k] = d + best[0], best[1]
        before = row
    i = j = size - 1
    path = [(n - 1 - i, m - 1 - j)]
    while i or j:
        s = step[i, j - i + band]
        i, j = i - (s != 2), j - (s != 1)
        path.append((n - 1 - i, m - 1 - j))
    return path


def align(left: Rel, right: Rel, on: tuple[str, str], margin: int | None = None, distance: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Left columns beside right columns along the cheapest path, partition by partition.

    `on` names the numbers that are compared, by absolute difference unless a distance of Columns is given (its value for band pairs is computed
    by Spark). Each partition's two sequences meet in one task, narrowed to keys, positions and the compared numbers.
    """
    if margin == 0:
        return zip_rows(left, right)
    keys = list(left.partition)
    if not keys:
        raise ValueError("ALIGN by distance needs PARTITION BY: a warping path is found in one task")
    a = left.df.withColumn("_i", F.row_number().over(left.window()))
    b = right.df.withColumn("_j", F.row_number().over(right.window()))
    x, y = a.select(*keys, F.col("_i").alias("_p"), F.col(on[0]).cast("double").alias("_v"), F.lit(0).alias("_side")), b.select(*keys, F.col("_j").alias("_p"), F.col(on[1]).cast("double").alias("_v"), F.lit(1).alias("_side"))
    schema = ", ".join([f"`{k}` {dict(left.df.dtypes)[k]}" for k in keys] + ["_i int", "_j int", "_step int"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = (pdf[pdf["_side"] == s].sort_values("_p")["_v"].to_numpy() for s in (0, 1))
        path = warp(lambda i, j: abs(p[i] - q[j]), len(p), len(q), margin)
        out = pd.DataFrame({"_i": [i + 1 for i, _ in path], "_j": [j + 1 for _, j in path], "_step": range(len(path))}).astype("int32")
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    def walk_given(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m = int(pdf["_n"].iloc[0]), int(pdf["_m"].iloc[0])
        reach = min(n, m) - 1 if not margin else min(abs(margin), min(n, m) - 1)
        table = np.full((n, 2 * reach + 1), np.nan)  # of row i, the places around the one that faces it from the end
        i, j = pdf["_i"].to_numpy() - 1, pdf["_j"].to_numpy() - 1
        k = j - i + (n - m) + reach
        inside = (k >= 0) & (k <= 2 * reach)
        table[i[inside], k[inside]] = pdf["_d"].to_numpy()[inside]
        distances = lambda i, j: table[i, k] if 0 <= (k := j - i + (n - m) + reach) <= 2 * reach else np.nan
        path = warp(distances, n, m, margin)
        out = pd.DataFrame({"_i": [i + 1 for i, _ in path], "_j": [j + 1 for _, j in path], "_step": range(len(path))}).astype("int32")
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    if distance is None:
        paths = x.unionByName(y).groupBy(*keys).applyInPandas(walk, schema)
    else:
        sizes = a.groupBy(*keys).agg(F.max("_i").alias("_n")).join(b.groupBy(*keys).agg(F.max("_j").alias("_m")), keys)
        # Pairs outside the band are never made: each left row names the places that it may face.
        facing, reach = F.col("_m") - (F.col("_n") - F.col("_i")), F.lit(abs(margin)) if margin else F.greatest("_n", "_m")
        first, last = F.greatest(F.lit(1), facing - reach), F.least(F.col("_m"), facing + reach)
        places = F.when(first <= last, F.sequence(first, last))
        reached = a.select(*keys, "_i", a[on[0]].alias("_x")).join(sizes, keys).withColumn("_j", F.explode(places))
        facts = [*keys, "_i", "_j", "_n", "_m"]
        given = reached.join(b.select(*keys, "_j", b[on[1]].alias("_y")), [*keys, "_j"]).select(*facts, distance(F.col("_x"), F.col("_y")).cast("double").alias("_d"))
        paths = given.groupBy(*keys).applyInPandas(walk_given, schema)
    return a.join(paths, [*keys, "_i"]).join(b, [*keys, "_j"]).drop("_i", "_j")
