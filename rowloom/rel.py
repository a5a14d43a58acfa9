"""A relation with its order: Spark promises none, so operators on sequences are told it explicitly."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ascending(column: Column | str) -> Column:
    """The dialect's default order: nulls last going up."""
    return (F.col(column) if isinstance(column, str) else column).asc_nulls_last()


def descending(column: Column | str) -> Column:
    """Nulls first going down."""
    return (F.col(column) if isinstance(column, str) else column).desc_nulls_first()


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    order: tuple[Column, ...] = ()
    partition: tuple[str, ...] = ()

    def ordered_by(self, *columns: Column | str) -> Rel:
        """Declares the order of rows; nothing is sorted before an operator needs it."""
        return replace(self, order=tuple(ascending(c) if isinstance(c, str) else c for c in columns))

    def partition_by(self, *columns: str) -> Rel:
        return replace(self, partition=columns)

    def having(self, df: DataFrame) -> Rel:
        return replace(self, df=df)

    def window(self) -> WindowSpec:
        if not self.order:
            raise ValueError("this operator depends on the order of rows: use ordered_by first")
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    def running(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
