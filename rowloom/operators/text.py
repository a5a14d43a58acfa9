"""TEXT operators: a regular expression's groups as columns, and a registry for other annotators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Annotator = Callable[[DataFrame, str, list[str]], DataFrame]
_ANNOTATORS: dict[str, Annotator] = {}


def parse(df: DataFrame, pattern: str, column: str, names: list[str]) -> DataFrame:
    """Group i of the first match as the i-th new column, ahead of the others; null where nothing matches."""
    text = F.col(column)
    hit = F.regexp_like(text, F.lit(pattern))
    return df.select(*[F.when(hit, F.regexp_extract(text, pattern, i + 1)).alias(n) for i, n in enumerate(names)], *df.columns)


def register(task: str, annotator: Annotator) -> None:
    _ANNOTATORS[task.upper()] = annotator


def annotate(df: DataFrame, task: str, column: str, names: list[str]) -> DataFrame:
    if task.upper() not in _ANNOTATORS:
        raise ValueError(f"text task {task} is not installed")
    return _ANNOTATORS[task.upper()](df, column, names)
