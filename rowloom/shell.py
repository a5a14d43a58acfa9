"""A shell for the dialect: statements end in semicolons; SOURCE, FORMAT, ECHO, TIME and RESET are the shell's own commands.

Results are printed a partition at a time. `python -m rowloom.shell [script...]` runs scripts, then reads from the terminal.
"""

from __future__ import annotations

import csv
import re
import sys
import time
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from rowloom.plans.parser import split_statements
from rowloom.session import Engine

#: What each CSV format sets apart from the others.
CSV_FORMATS = {
    "DEFAULT": {"lineterminator": "\r\n"},
    "RFC4180": {"lineterminator": "\r\n"},
    "EXCEL": {"lineterminator": "\r\n"},
    "MYSQL": {"delimiter": "\t", "lineterminator": "\n", "quoting": csv.QUOTE_NONE, "escapechar": "\\"},
    "TDF": {"delimiter": "\t", "lineterminator": "\r\n"},
}


class Shell:
    def __init__(self, engine: Engine, out: TextIO = sys.stdout):
        self.make: Callable[[], Engine] = lambda: Engine(engine.spark)
        self.engine, self.out = engine, out
        self.format: str | None = None
        self.echo = False

    def run(self, text: str) -> None:
        for statement in split_statements(text, ";"):
            if statement.strip():
                self.one(statement.strip())

    def one(self, statement: str) -> None:
        word, _, rest = statement.partition(" ")
        rest = rest.strip()
        match word.upper():
            case "TIME":
                begin = time.perf_counter()
                self.one(rest)
                print(f"Time: {time.perf_counter() - begin:.3f} s", file=self.out)
            case "SOURCE":
                with open(rest.strip("'"), encoding="utf-8") as script:
                    self.run(script.read())
            case "FORMAT":
                kind, name = [*rest.upper().split(), "DEFAULT"][:2]
                if kind not in ("TABLE", "CSV") or name not in CSV_FORMATS:
                    raise ValueError(f"unknown format {rest}")
                self.format = name if kind == "CSV" else None
            case "ECHO":
                if rest.upper() not in ("ON", "OFF"):
                    raise ValueError("ECHO ON or ECHO OFF")
                self.echo = rest.upper() == "ON"
            case "RESET":
                self.engine = self.make()
            case _:
                if self.echo:
                    print(statement + ";", file=self.out)
                for df in self.engine.execute(statement):
                    if df is not None:
                        self.show(df)

    def show(self, df: DataFrame, page: int = 1000) -> None:
        """A table whose columns are as wide as the first page needs, or CSV; always all rows."""
        if self.format:
            writer = csv.writer(self.out, **CSV_FORMATS[self.format])
            if self.format != "MYSQL":
                writer.writerow(df.columns)
            for row in df.toLocalIterator():
                writer.writerow(["\\N" if v is None and self.format == "MYSQL" else v for v in row])
            return
        widths, held, n = [len(c) for c in df.columns], [], 0

        def write(rows: list[list[str]]) -> None:
            for row in rows:
                print(" | ".join(v.ljust(w) for v, w in zip(row, widths, strict=True)).rstrip(), file=self.out)

        for row in df.toLocalIterator():
            held.append(["" if v is None else str(v) for v in row])
            n += 1
            if n == page:
                widths = [max(w, *map(len, c)) for w, c in zip(widths, zip(*held, strict=True), strict=True)]
                write([df.columns])
            if n >= page:
                write(held)
                held = []
        if n < page:
            widths = [max([w, *map(len, c)]) for w, c in zip(widths, zip(*held, strict=True) if held else [()] * len(widths), strict=True)]
            write([df.columns])
            write(held)
        print(f"({n} rows)", file=self.out)


def main(scripts: list[str]) -> None:
    shell = Shell(Engine(SparkSession.builder.appName("rowloom").getOrCreate()))
    for script in scripts:
        shell.one(f"SOURCE '{script}'")
    typed = ""
    for line in sys.stdin:
        typed += line
        *whole, typed = split_statements(typed, ";")
        for statement in whole:
            try:
                shell.run(statement)
            except Exception as error:  # noqa: BLE001  a mistyped statement must not end the session
                print(re.split(r"\n\n|JVM stacktrace", str(error))[0], file=sys.stderr)
    if typed.strip():
        shell.run(typed)


if __name__ == "__main__":
    main(sys.argv[1:])
