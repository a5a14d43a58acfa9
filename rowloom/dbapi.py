"""A DB-API 2.0 connection to an engine. Rows come a partition at a time, so a result of any size can be paged through."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Iterator, Sequence
from itertools import islice

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from rowloom.plans.parser import split_statements
from rowloom.session import Engine

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"


class Error(Exception):
    pass


class ProgrammingError(Error):
    pass


def literal(value) -> str:
    """A value as the dialect writes it."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | decimal.Decimal):
        return f"({value:f})" if isinstance(value, decimal.Decimal) else f"({value})"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS FLOAT)"
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "''") + "'"
    raise ProgrammingError(f"no literal for {type(value).__name__}")


def bound(text: str, values: Sequence) -> str:
    """The text with its question marks, but for those in quotes and comments, replaced by literals."""
    parts = split_statements(text, "?")
    if len(parts) != len(values) + 1:
        raise ProgrammingError(f"{len(parts) - 1} parameters, {len(values)} values")
    return "".join(part + (literal(values[i]) if i < len(values) else "") for i, part in enumerate(parts))


class Cursor:
    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection = connection
        self.description: list[tuple] | None = None
        self.rowcount = -1
        self._rows: Iterator = iter(())

    def execute(self, text: str, values: Sequence = ()) -> Cursor:
        try:
            results = self.connection.engine.execute(bound(text, values))
        except (PySparkException, ValueError, KeyError) as error:
            raise ProgrammingError(str(error)) from error
        df: DataFrame | None = results[-1] if results else None
        self.description = None if df is None else [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in df.schema.fields]
        self._rows = iter(()) if df is None else (tuple(row) for row in df.toLocalIterator())
        return self

    def executemany(self, text: str, many: Sequence[Sequence]) -> Cursor:
        for values in many:
            self.execute(text, values)
        return self

    def fetchone(self) -> tuple | None:
        return next(self._rows, None)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return list(islice(self._rows, self.arraysize if size is None else size))

    def fetchall(self) -> list[tuple]:
        return list(self._rows)

    def __iter__(self) -> Iterator[tuple]:
        return self._rows

    def close(self) -> None:
        self._rows = iter(())

    def setinputsizes(self, sizes) -> None: ...

    def setoutputsize(self, size, column=None) -> None: ...


class Connection:
    """Statements take effect at once: commit does nothing, and there is no rollback."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def cursor(self) -> Cursor:
        return Cursor(self)

    def commit(self) -> None: ...

    def close(self) -> None: ...

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def connect(spark: SparkSession) -> Connection:
    return Connection(Engine(spark))
