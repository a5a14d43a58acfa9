"""Regular expressions over labelled rows.

Grammar: ^ $ | ( ) * + ?, concatenation by juxtaposition or a dot, symbols are words, numbers or quoted strings. The expression
becomes a position automaton; partitions are walked in order as they stream by.

Which matches are given, a policy of our own: with ^ and no $ every row at which a run from the partition's first row accepts; with
^ and $ the whole partition at most; without ^ the leftmost, longest matches that don't overlap ($ asks that a match ends
at the partition's end).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.rel import Rel

_TOKEN = re.compile(r"""\s*(?:(?P<symbol>\w+|"[^"]*"|'[^']*')|(?P<mark>[\^$|().*+?]))""")


@dataclass
class Automaton:
    """Positions are symbols of the expression in order; a run is a walk from a first to a last position."""

    symbols: list[str]
    first: set[int]
    last: set[int]
    follow: dict[int, set[int]]
    empty: bool
    from_start: bool = False
    to_end: bool = False

    def step(self, states: set[int] | None, labels: set[str]) -> set[int]:
        ahead = self.first if states is None else set().union(*(self.follow.get(s, set()) for s in states))
        return {s for s in ahead if self.symbols[s] in labels}

    def accepts(self, states: set[int]) -> bool:
        return bool(states & self.last)


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"bad row expression at {at}: {text}")
            self.tokens.append(("symbol", m["symbol"].strip("'\"").upper()) if m["symbol"] else ("mark", m["mark"]))
            at = m.end()
        self.at, self.symbols, self.follow = 0, [], {}

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, mark: str) -> bool:
        if self.peek() == ("mark", mark):
            self.at += 1
            return True
        return False

    def parse(self) -> Automaton:
        start = self.take("^")
        first, last, empty = self.either()
        end = self.take("$")
        if self.peek()[0] != "end":
            raise ValueError(f"unexpected {self.peek()[1]} in a row expression")
        return Automaton(self.symbols, first, last, self.follow, empty, start, end)

    def either(self):
        first, last, empty = self.row()
        while self.take("|"):
            f, s, e = self.row()
            first, last, empty = first | f, last | s, empty or e
        return first, last, empty

    def row(self):
        first, last, empty = self.repeated()
        while True:
            dotted = self.take(".")
            if not dotted and self.peek()[0] != "symbol" and self.peek() != ("mark", "("):
                return first, last, empty
            f, s, e = self.repeated()
            self.link(last, f)
            first, last, empty = first | f if empty else first, last | s if e else s, empty and e

    def link(self, last: set[int], first: set[int]) -> None:
        for x in last:
            self.follow.setdefault(x, set()).update(first)

    def repeated(self):
        first, last, empty = self.one()
        while self.peek()[1] in ("*", "+", "?") and self.peek()[0] == "mark":
            mark = self.tokens[self.at][1]
            self.at += 1
            if mark in "*+":
                self.link(last, first)
            empty = empty or mark in "*?"
        return first, last, empty

    def one(self):
        if self.take("("):
            inside = self.either()
            if not self.take(")"):
                raise ValueError("a parenthesis of a row expression is not closed")
            return inside
        kind, value = self.peek()
        if kind != "symbol":
            raise ValueError(f"a row expression needs a symbol at {value or 'its end'}")
        self.at += 1
        self.symbols.append(value)
        return {len(self.symbols) - 1}, {len(self.symbols) - 1}, False


def parse(expression: str) -> Automaton:
    return _Parser(expression).parse()


def spans(automaton: Automaton, labels: list[set[str]]) -> list[tuple[int, int]]:
    """(first row, last row) of the matches, as the policy says."""
    found, n = [], len(labels)
    begin = 0
    while begin < n:
        states, best = None, None
        for i in range(begin, n):
            states = automaton.step(states, labels[i])
            if not states:
                break
            if automaton.accepts(states) and (not automaton.to_end or i == n - 1):
                best = i
                if automaton.from_start and not automaton.to_end:
                    found.append((0, i))
        if automaton.from_start:
            return found if not automaton.to_end else [(0, best)] if best is not None else []
        if best is not None:
            found.append((begin, best))
        begin = begin + 1 if best is None else best + 1
    return found


def label_column(rel: Rel, when: list[tuple[str, Column]]) -> DataFrame:
    """Adds _labels: every label whose predicate is true."""
    labels = F.array_compact(F.array(*[F.when(test, F.lit(name.upper())) for name, test in when]))
    return rel.df.withColumn("_labels", labels)


def match_rows(rel: Rel, expression: str, labels: Column) -> DataFrame:
    """The rows of matches, with match_id (from 1 in a partition) and match_pos (from 1 in a match); `labels` is a string or an array of strings.

    A partition is held by one task; it is read as one pandas frame of keys, labels and positions only.
    """
    automaton = parse(expression)
    keys = list(rel.partition)
    if not keys:
        raise ValueError("MATCH needs PARTITION BY")
    kind = rel.df.select(labels).dtypes[0][1]
    listed = labels if kind.startswith("array") else F.array_compact(F.array(labels.cast("string")))
    numbered = rel.df.withColumn("_mlabels", F.array_join(F.transform(listed, F.upper), "\u0001")).withColumn("_row", F.row_number().over(rel.window()))
    narrow = numbered.select(*keys, "_row", "_mlabels")
    schema = ", ".join([f"`{k}` {dict(rel.df.dtypes)[k]}" for k in keys] + ["_row int", "match_id int", "match_pos int"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        sets = [set(x.split("\u0001")) if x else set() for x in pdf["_mlabels"]]
        out = [(a + j, m + 1, j + 1) for m, (a, b) in enumerate(spans(automaton, sets)) for j in range(b - a + 1)]
        rows = pdf.iloc[[i for i, _, _ in out]][[*keys, "_row"]].reset_index(drop=True)
        return rows.assign(match_id=pd.Series([m for _, m, _ in out], dtype="int32"), match_pos=pd.Series([p for _, _, p in out], dtype="int32"))

    found = narrow.groupBy(*keys).applyInPandas(walk, schema)
    return numbered.drop("_mlabels").join(found, [*keys, "_row"]).select(*rel.df.columns, "match_id", "match_pos")


def match_summary(rel: Rel, expression: str, labels: Column, **aggregates: Callable[[], Column]) -> DataFrame:
    """One row a match, with the given aggregates of its rows."""
    found = match_rows(rel, expression, labels)
    return found.groupBy(*rel.partition, "match_id").agg(*[make().alias(name) for name, make in aggregates.items()])


def match_text(rel: Rel, pattern: str, letters: Column) -> DataFrame:
    """A second lowering, without Python: labels are single letters, a partition is one string, `pattern` a Java regular expression.

    Gives partition keys and the matched strings. For rows with one label each and matches that don't overlap.
    """
    df = rel.df.withColumn("_n", F.row_number().over(rel.window())).withColumn("_x", letters)
    held = F.array_sort(F.collect_list(F.struct("_n", "_x")))
    text = F.array_join(F.transform(held, lambda e: e["_x"]), "")
    joined = df.groupBy(*rel.partition).agg(text.alias("_text"))
    return joined.select(*rel.partition, F.explode(F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).alias("matched"))
