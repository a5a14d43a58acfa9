"""Aggregates of the dialect: name -> function of Columns that gives an aggregate Column. All merge partial results map-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Aggregate = Callable[..., Column]


def _pair(y: Column, w: Column) -> Column:
    return y.isNotNull() & w.isNotNull()


def weighted_moment(y: Column, w: Column, k: int) -> Column:
    return F.sum(F.when(_pair(y, w), w * F.pow(y, F.lit(k)))) / F.nullif(F.sum(F.when(_pair(y, w), w)), F.lit(0.0))


def weighted_central(y: Column, w: Column) -> tuple[Column, Column, Column, Column]:
    """Weighted mean and the second to fourth population central moments, from raw moments."""
    m1, m2, m3, m4 = (weighted_moment(y, w, k) for k in (1, 2, 3, 4))
    return m1, m2 - m1 * m1, m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1, m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1


def weighted_variance(y: Column, w: Column) -> Column:
    return weighted_central(y, w)[1]


def weighted_skew(y: Column, w: Column) -> Column:
    _, v, m3, _ = weighted_central(y, w)
    return F.when(v > 0, m3 / F.pow(v, F.lit(1.5)))


def weighted_kurtosis(y: Column, w: Column) -> Column:
    _, v, _, m4 = weighted_central(y, w)
    return F.when(v > 0, m4 / (v * v) - 3)


def skew_pop(x: Column) -> Column:
    return F.when(F.var_pop(x) > 0, F.skewness(x))


def skew_samp(x: Column) -> Column:
    n = F.count(x)
    return F.when((n > 2) & (F.var_pop(x) > 0), F.skewness(x) * F.sqrt((n * (n - 1)).cast("double")) / F.nullif(n - 2, F.lit(0)))


def kurtosis_pop(x: Column) -> Column:
    return F.when(F.var_pop(x) > 0, F.kurtosis(x))


def kurtosis_samp(x: Column) -> Column:
    n = F.count(x)
    return F.when((n > 3) & (F.var_pop(x) > 0), (F.kurtosis(x) * (n + 1) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)))


def corr(y: Column, x: Column) -> Column:
    """Null if either side is constant."""
    both = _pair(y, x)
    spread = lambda c: F.stddev_pop(F.when(both, c))
    return F.when((spread(y) > 0) & (spread(x) > 0), F.try_divide(F.covar_pop(y, x), spread(y) * spread(x)))


def total(x: Column, integral: bool = False) -> Column:
    return F.sum(x.cast("bigint" if integral else "double"))


AGGREGATES: dict[str, Aggregate] = {
    "COUNT": lambda x=None: F.count(F.lit(1) if x is None else x),
    "SUM": F.sum,
    "AVG": lambda y, w=None: F.avg(y) if w is None else weighted_moment(y, w, 1),
    "MIN": F.min,
    "MAX": F.max,
    "BOOL_AND": F.bool_and,
    "EVERY": F.bool_and,
    "BOOL_OR": F.bool_or,
    "EXISTS": lambda: F.count(F.lit(1)) > 0,
    "VAR_POP": F.var_pop,
    "VARIANCE": lambda y, w=None: F.var_samp(y) if w is None else weighted_variance(y, w),
    "STDDEV_POP": F.stddev_pop,
    "STDDEV": lambda y, w=None: F.stddev_samp(y) if w is None else F.sqrt(weighted_variance(y, w)),
    "SKEW_POP": skew_pop,
    "SKEW": lambda y, w=None: skew_samp(y) if w is None else weighted_skew(y, w),
    "KURTOSIS_POP": kurtosis_pop,
    "KURTOSIS": lambda y, w=None: kurtosis_samp(y) if w is None else weighted_kurtosis(y, w),
    "CORR": corr,
    "COVAR_POP": F.covar_pop,
    "COVAR_SAMP": F.covar_samp,
    "REGR_COUNT": F.regr_count,
    "REGR_AVGX": F.regr_avgx,
    "REGR_AVGY": F.regr_avgy,
    "REGR_SLOPE": F.regr_slope,
    "REGR_INTERCEPT": F.regr_intercept,
    "REGR_R2": F.regr_r2,
    "REGR_SXX": F.regr_sxx,
    "REGR_SYY": F.regr_syy,
    "REGR_SXY": F.regr_sxy,
}
for alias, name in {"VAR": "VARIANCE", "VAR_SAMP": "VARIANCE", "STDDEV_SAMP": "STDDEV", "SKEW_SAMP": "SKEW", "KURTOSIS_SAMP": "KURTOSIS"}.items():
    AGGREGATES[alias] = AGGREGATES[name]


def string_agg(x: Column, order: list[Column], separator: str = ", ", brackets: bool = False) -> Column:
    """Strings joined in the given order; with `brackets` nulls are printed and the result is bracketed."""
    held = F.coalesce(x.cast("string"), F.lit("null")) if brackets else x.cast("string")
    keyed = F.array_sort(F.collect_list(F.when(held.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], held.alias("x")))))
    joined = F.array_join(F.transform(keyed, lambda e: e["x"]), separator)
    return F.concat(F.lit("["), joined, F.lit("]")) if brackets else F.nullif(joined, F.lit(""))


def aggregate(name: str, *arguments: Column, distinct: bool = False) -> Column:
    upper = name.upper()
    if upper not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name}")
    if distinct:
        if upper == "COUNT":
            return F.count_distinct(*arguments)
        if upper == "SUM":
            return F.sum_distinct(*arguments)
        if upper == "AVG":
            return F.sum_distinct(*arguments) / F.nullif(F.count_distinct(*arguments), F.lit(0))
        if upper not in ("MIN", "MAX", "BOOL_AND", "EVERY", "BOOL_OR"):
            raise ValueError(f"{name} has no DISTINCT form here")
    return AGGREGATES[upper](*arguments)
