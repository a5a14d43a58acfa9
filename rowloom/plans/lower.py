"""Lowers parsed queries to DataFrames; Catalyst does the rest.

A lowered relation is a Rel, so that order and partition reach the operators that depend on them, with the names by which a
query may refer to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.functions import aggregate as A
from rowloom.functions import casts
from rowloom.functions import scalar as S
from rowloom.operators import align, infer, match, ml, relational, sequence, text
from rowloom.plans.parser import Node
from rowloom.rel import Rel, ascending
from rowloom.sources.pgcatalog import catalog_table
from rowloom.sources.registry import Registry

COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
#: Functions that leave integers as they are, or divide them exactly.
WHOLE = {"FLOOR", "CEIL", "CEILING", "TRUNC", "TRUNCATE", "DIV"}


@dataclass
class Scope:
    rel: Rel
    names: dict[str, Rel] = field(default_factory=dict)  # alias in upper case -> relation
    labels: Column | None = None  # of matched rows


class Lowering:
    def __init__(self, spark: SparkSession, registry: Registry, learners: dict[str, ml.Trained]):
        self.spark, self.registry, self.learners = spark, registry, learners
        self.outer: list[Scope] = []  # of the queries around the one that is lowered
        self.lazy: dict[int, tuple[DataFrame, list[str]]] = {}
        self.prepared: dict[int, Column] = {}  # moving averages whose columns were added to the relation, by their node

    # Relations

    def rel(self, node: Node) -> Rel:
        return self.scope(node).rel

    def columns(self, df: DataFrame) -> list[str]:
        return self.lazy[id(df)][1] if id(df) in self.lazy else df.columns

    def scope(self, node: Node) -> Scope:
        return getattr(self, "_" + node[0])(*node[1:])

    def _table(self, location: str | None, name: str) -> Scope:
        if name.upper().startswith("PG_") and (location or "PG_CATALOG").upper() == "PG_CATALOG":
            df = catalog_table(self.spark, name)
        else:
            df = self.spark.table(f"{location}.{name}" if location else name)
        rel = Rel(df.alias(name))
        return Scope(rel, {name.upper(): rel})

    def _values(self, rows: list[list[Node]]) -> Scope:
        if len({len(row) for row in rows}) != 1:
            raise ValueError("the rows of VALUES differ in length")
        one = self.spark.range(1)
        parts = [one.select(*[self.expression(e, None).alias(f"V{i + 1}") for i, e in enumerate(row)]) for row in rows]
        return Scope(Rel(reduce(DataFrame.unionAll, parts)))

    def _external(self, name: str, arguments: list) -> Scope:
        return Scope(Rel(self.registry.source(name, *arguments)))

    def _alias(self, node: Node, name: str, columns: list[str] | None) -> Scope:
        inner = self.scope(node).rel
        df = inner.df.toDF(*columns) if columns else inner.df
        if columns and inner.order:
            raise ValueError("name the columns before ordering a relation")
        rel = replace(inner, df=df.alias(name))
        return Scope(rel, {name.upper(): rel})

    def _partition(self, node: Node, columns: list[str]) -> Scope:
        return self._tagged(node, lambda rel: rel.partition_by(*columns))

    def _ordering(self, node: Node, sorts: list) -> Scope:
        inner = self.scope(node)
        order = tuple(self.sort(s, inner) for s in sorts)
        return self._changed(inner, lambda rel: replace(rel, order=order))

    def _tagged(self, node: Node, change) -> Scope:
        return self._changed(self.scope(node), change)

    def _changed(self, inner: Scope, change) -> Scope:
        return Scope(change(inner.rel), {n: change(r) for n, r in inner.names.items()}, inner.labels)

    def _join(self, how: str, left: Node, right: Node, on: tuple | None) -> Scope:
        a, b = self.scope(left), self.scope(right)
        names = a.names | b.names
        if how == "cross" or on is None:
            return Scope(Rel(a.rel.df.crossJoin(b.rel.df)), names)
        if on[0] == "natural":
            return Scope(Rel(relational.natural_join(a.rel.df, b.rel.df, how)), names)
        if on[0] == "using":
            return Scope(Rel(a.rel.df.join(b.rel.df, on[1], how)), names)
        condition = self.expression(on[1], Scope(a.rel, names))
        if how == "inner" and not self.outer and not _may_have_keys(on[1]):
            return Scope(Rel(relational.theta_join(a.rel.df, b.rel.df, condition)), names)
        return Scope(Rel(a.rel.df.join(b.rel.df, condition, how)), names)

    def _align(self, left: Node, right: Node, distance: Node | None, margin: int | None) -> Scope:
        a, b = self.scope(left), self.scope(right)
        names = a.names | b.names
        if distance is None or distance[0] == "literal" or margin == 0:
            return Scope(Rel(align.zip_rows(a.rel, b.rel)), names)
        columns = [n for n in _columns(distance)]
        if len(columns) != 2:
            raise ValueError("a distance compares one column of each side")
        left_name, right_name = columns[0][2], columns[1][2]
        by = lambda x, y: self.expression(_replaced(distance, {columns[0]: x, columns[1]: y}), None)
        return Scope(Rel(align.align(a.rel, b.rel, (left_name, right_name), margin, by)), names)

    def _compound(self, kind: str, keep_all: bool, left: Node, right: Node) -> Scope:
        return Scope(Rel(relational.compound(kind, self.rel(left).df, self.rel(right).df, keep_all)))

    def _ordered(self, node: Node, sorts: list | None, limit: int | None, offset: int) -> Scope:
        if node[0] == "select":
            return self._select(*node[1:], order=sorts, limit=limit, offset=offset)
        inner = self.scope(node)
        order = [self.sort(self._ordinal(s, inner.rel.df.columns), inner) for s in sorts or []]
        df = inner.rel.df.orderBy(*order) if order else inner.rel.df
        return self._cut(Scope(Rel(df, tuple(order), inner.rel.partition), {n: replace(r, order=tuple(order)) for n, r in inner.names.items()}), limit, offset)

    def _cut(self, scope: Scope, limit: int | None, offset: int) -> Scope:
        df = scope.rel.df
        df = df.offset(offset) if offset else df
        df = df if limit is None else df.limit(limit)
        return Scope(replace(scope.rel, df=df), scope.names)

    @staticmethod
    def _ordinal(sort: tuple, names: list[str]) -> tuple:
        e, up, first = sort
        if e[0] == "literal" and isinstance(e[1], int):
            return ("column", None, names[e[1] - 1]), up, first
        return sort

    def sort(self, sort: tuple, scope: Scope) -> Column:
        e, up, first = sort
        column = self.expression(e, scope)
        first = (not up) if first is None else first
        if up:
            return column.asc_nulls_first() if first else column.asc_nulls_last()
        return column.desc_nulls_first() if first else column.desc_nulls_last()

    def _select(self, targets, source, where, group, having, distinct, on, order=None, limit=None, offset=0) -> Scope:
        scope = self.scope(source) if source else Scope(Rel(self.spark.range(1)))
        if where is not None:
            kept = scope.rel.df.where(self.expression(where, scope))
            if self.outer:  # a subquery that names outer columns can't be asked for its own before it is part of the whole
                self.lazy[id(kept)] = kept, self.columns(scope.rel.df)
            scope = Scope(scope.rel.having(kept), scope.names, scope.labels)
        scope = self._with_moving(scope, [t for t, _ in targets])
        sequential = scope.labels is not None
        if group is None and not sequential and not any(_has_aggregate(t[0]) for t in targets) and having is None:
            return self._projected(scope, targets, distinct, on, order, limit, offset)
        named = {(name or "").upper(): e for e, name in targets if name}
        chosen = [self._group_item(g, targets, named) for g in group or []]
        keys = [self.expression(g, scope) for g in chosen]
        if scope.rel.order and not sequential and any(_calls(t, "STRING_AGG") for t, _ in targets):
            place = F.row_number().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy(*scope.rel.order))
            scope = replace(scope, rel=scope.rel.having(scope.rel.df.withColumn("_place", place)))
        if sequential and not chosen:  # a matched relation gives a row a match
            keys = [F.col(c) for c in (*scope.rel.partition, "match_id")]
        columns = [self.expression(e, scope).alias(name or self.title(e)) for e, name in targets]
        hidden = [self.expression(having, scope).alias("_having")] if having is not None else []
        sorts = []
        for i, (e, up, first) in enumerate(self._ordinal(s, [name or self.title(t) for t, name in targets]) for s in order or []):
            if e[0] == "column" and e[1] is None and e[2].upper() in {(name or self.title(t)).upper() for t, name in targets}:
                sorts.append((e, up, first))
            else:
                hidden.append(self.expression(e, scope).alias(f"_sort{i}"))
                sorts.append((("column", None, f"_sort{i}"), up, first))
        if keys:
            grouped = scope.rel.df.groupBy(*[k.alias(f"_key{i}") for i, k in enumerate(keys)]).agg(*columns, *hidden)
            df = grouped.select(*[c for c in grouped.columns if not c.startswith("_key")])
        elif chosen or not all(_has_aggregate(e) for e, _ in targets):
            df = scope.rel.df.groupBy().agg(*columns, *hidden)
        else:  # a subquery may name columns of the query around it in a select, not in a groupBy
            df = scope.rel.df.select(*columns, *hidden)
        if having is not None:
            df = df.where("_having").drop("_having")
        lowered = tuple(self.sort(s, Scope(Rel(df))) for s in sorts)
        df = df.orderBy(*lowered) if lowered else df
        extra = [e[2] for e, _, _ in sorts if e[2].startswith("_sort")]
        return self._cut(Scope(Rel(df.drop(*extra) if extra else df, lowered)), limit, offset)

    def _with_moving(self, scope: Scope, targets: list) -> Scope:
        """Adds the columns that T.movavg, T.movstddev and T.expmovavg of columns need, so that no row collects its predecessors.

        The first two range over the running count of known values; the third walks each partition once. Only a relation by itself is changed.
        """
        if len(scope.names) != 1 or scope.labels is not None:
            return scope
        (alias, rel), df = next(iter(scope.names.items())), scope.rel.df
        for k, node in enumerate(c for t in targets for c in _moving(t)):
            _, qualifier, name, arguments, _ = node
            if qualifier[0].upper() != alias or arguments[0][0] != "column" or len(arguments) != 2:
                continue
            column, n = arguments[0][2], arguments[1][1]
            own = next((c for c in df.columns if c.upper() == column.upper()), None)
            if own is None:
                continue
            if name == "EXPMOVAVG":
                df = sequence.expmovavg(replace(rel, df=df), own, float(n), f"_moving{k}").alias(alias)
                self.prepared[id(node)] = F.col(f"_moving{k}")
            else:
                df = df.withColumn(f"_moving{k}", F.count(f"`{own}`").over(rel.running()))
                frame = Window.partitionBy(*rel.partition).orderBy(f"_moving{k}").rangeBetween(1 - n, 0)
                value = (F.avg if name == "MOVAVG" else F.stddev_samp)(f"`{own}`").over(frame)
                self.prepared[id(node)] = F.when(F.col(f"_moving{k}") > 0, value)
        return Scope(scope.rel.having(df), {alias: replace(rel, df=df)})

    def _group_item(self, e: Node, targets: list, named: dict[str, Node]) -> Node:
        if e[0] == "literal" and isinstance(e[1], int):
            return targets[e[1] - 1][0]
        if e[0] == "column" and e[1] is None and e[2].upper() in named:
            return named[e[2].upper()]
        return e

    def _projected(self, scope: Scope, targets, distinct, on, order, limit, offset) -> Scope:
        df = scope.rel.df
        columns: list[Column] = []
        outputs: list[str] = []
        for e, name in targets:
            if e[0] == "star":
                own = self._star(e, scope)
                columns += own
                outputs += df.select(*own).columns
            else:
                columns.append(self.expression(e, scope).alias(name or self.title(e)))
                outputs.append(name or self.title(e))
        sorts = [self._ordinal(s, outputs) for s in order or []]
        if on is not None:
            keyed = df.withColumns({f"_on{i}": self.expression(e, scope) for i, e in enumerate(on)})
            df = relational.distinct_on(keyed, [f"_on{i}" for i in range(len(on))], [self.sort(s, scope) for s in sorts] or [ascending("_on0")])
        out = df.select(*columns)
        out = out.distinct() if distinct else out
        lowered: tuple[Column, ...] = ()
        if sorts:
            own = {c.upper() for c in outputs}
            if all(e[0] == "column" and e[1] is None and e[2].upper() in own for e, _, _ in sorts):
                lowered = tuple(self.sort(s, Scope(Rel(out))) for s in sorts)
                out = out.orderBy(*lowered)
            else:
                named = {name.upper(): e for e, name in targets if name}
                lowered = tuple(self.sort((named.get(e[2].upper(), e) if e[0] == "column" and e[1] is None else e, up, first), scope) for e, up, first in sorts)
                out = df.orderBy(*lowered).select(*columns)
        else:
            lowered = scope.rel.order
        return self._cut(Scope(Rel(out, lowered, scope.rel.partition), {}), limit, offset)

    def _star(self, e: Node, scope: Scope) -> list[Column]:
        _, table, index, excepted = e
        hidden = {x.upper() for x in excepted}
        rel = scope.rel if table is None else scope.names[table.upper()]
        names = [c for c in self.columns(rel.df) if c.upper() not in hidden and not c.startswith("_")]
        if index is not None:
            return [sequence.at(rel, c, index).alias(c) for c in names]
        return [F.col(f"`{table}`.`{c}`" if table else f"`{c}`") for c in names]

    @staticmethod
    def title(e: Node) -> str:
        return {"column": lambda: e[2], "index": lambda: e[3], "call": lambda: e[2].lower(), "cast": lambda: Lowering.title(e[1])}.get(e[0], lambda: "column")()

    def _match(self, node: Node, expression: str, labeler: Node | None) -> Scope:
        inner = self.scope(node)
        automaton = match.parse(expression)
        if labeler is None:
            if len(set(automaton.symbols)) != 1:
                raise ValueError("a row expression of several symbols needs labels")
            rel = inner.rel.having(inner.rel.df.withColumn("_labels", F.array(F.lit(automaton.symbols[0]))))
        else:
            rel = inner.rel.having(self._labelled(inner, labeler))
        if not rel.partition:
            rel = replace(rel, df=rel.df.withColumn("_all", F.lit(1)), partition=("_all",))
        found = replace(rel, df=match.match_rows(rel, expression, F.col("_labels")), order=(F.col("match_id").asc(), F.col("match_pos").asc()))
        symbols = {s: found for s in automaton.symbols}
        return Scope(found, inner.names | symbols, F.col("_labels"))

    def _labelled(self, scope: Scope, labeler: Node) -> DataFrame:
        if labeler[0] == "when":
            return match.label_column(scope.rel, [(name, self.expression(test, scope)) for name, test in labeler[1]])
        _, column, cases, other, every = labeler
        value = F.col(column)
        named = F.upper(value.cast("string"))
        for v, label in cases:
            named = F.when(value.cast("string") == str(v), F.lit(label.upper())).otherwise(F.lit(None) if named is None else named)
        if cases:
            named = reduce(lambda rest, c: F.when(value.cast("string") == str(c[0]), F.lit(c[1].upper())).otherwise(rest), reversed(cases), F.when(value.isNotNull(), F.lit(other.upper() if other else None)))
        return scope.rel.df.withColumn("_labels", F.array_compact(F.array(named, F.lit(every.upper() if every else None))))

    def _arg(self, node: Node, specs: list, over: tuple | None) -> Scope:
        inner = self.scope(node)
        if over is None:
            return Scope(inner.rel.having(sequence.arg(inner.rel, *[(kind, self.expression(x, inner)) for _, kind, x in specs])), inner.names)
        matched = self._match(node, *over)
        rel = replace(matched.rel, partition=(*matched.rel.partition, "match_id"))
        found = sequence.arg(rel, *[(kind, self.expression(x, matched) if label is None else F.when(F.array_contains("_labels", label.upper()), self.expression(x, matched))) for label, kind, x in specs])
        return Scope(inner.rel.having(found.select(*inner.rel.df.columns)))

    def _pivot(self, node: Node, call: Node, by: str, targets: list) -> Scope:
        inner = self.scope(node)
        value = self.expression(call[3][0], inner) if call[3] else F.lit(1)
        return Scope(Rel(sequence.pivot(inner.rel, lambda x: A.aggregate(call[2], x), value, by, targets)))

    def _unpivot(self, node: Node, value: str, key: str, columns: list) -> Scope:
        return Scope(Rel(sequence.unpivot(self.rel(node).df, value, key, columns)))

    def _split(self, node: Node, ends: list[str], into: list[str]) -> Scope:
        rel = self.rel(node)
        return Scope(Rel(sequence.split(rel, *ends, *into), tuple(ascending(c) for c in (*rel.partition, *into)), rel.partition))

    def _infer(self, node: Node, columns, excepted, nulls, limit) -> Scope:
        inner = self.scope(node)
        hidden = {x.upper() for x in excepted}
        chosen = columns or [c for c in inner.rel.df.columns if c.upper() not in hidden]
        return Scope(inner.rel.having(infer.infer_types(inner.rel.df, chosen, nulls, limit)), inner.names)

    def _predict(self, kind: str, node: Node, name: str, output: str) -> Scope:
        inner = self.scope(node)
        run = ml.classify if kind == "CLASSIFIED" else ml.cluster
        return Scope(inner.rel.having(run(inner.rel.df, self.learner(name), output)))

    def learner(self, name: str) -> ml.Trained:
        if name.upper() not in self.learners:
            raise ValueError(f"no classifier or clusterer {name}")
        return self.learners[name.upper()]

    def _impute(self, node: Node, specs: list) -> Scope:
        rel = self.rel(node)
        df = reduce(lambda d, s: ml.impute(d, s[1], self.learner(s[0]), s[2]), specs, rel.df)
        return Scope(rel.having(df))

    def _text(self, node: Node, task: str, arguments: list, column: str, names: list[str], _language) -> Scope:
        rel = self.rel(node)
        df = text.parse(rel.df, arguments[0], column, names) if task.upper() == "PARSE" else text.annotate(rel.df, task, column, names)
        return Scope(rel.having(df))

    # Expressions

    def expression(self, e: Node, scope: Scope | None) -> Column:
        if isinstance(e, Column):
            return e
        return self.e_call(scope, e) if e[0] == "call" else getattr(self, "e_" + e[0])(scope, *e[1:])

    def e_literal(self, _, value) -> Column:
        return F.lit(value)

    def e_column(self, scope: Scope | None, table: str | None, name: str) -> Column:
        if scope is not None and scope.labels is not None and table is not None and table.upper() in scope.names:
            return F.max_by(F.when(F.array_contains("_labels", table.upper()), F.col(f"`{name}`")), F.when(F.array_contains("_labels", table.upper()), F.col("match_pos")))
        column = F.col(f"`{table}`.`{name}`" if table else f"`{name}`")
        return column.outer() if self.outer and scope is not None and not self.knows(scope, table, name) and self.knows(self.outer[-1], table, name) else column

    def knows(self, scope: Scope, table: str | None, name: str) -> bool:
        """Whether a query's relations have this column."""
        rel = scope.rel if table is None else scope.names.get(table.upper())
        return rel is not None and name.upper() in {c.upper() for c in self.columns(rel.df)}

    def within(self, scope: Scope | None, query: Node) -> DataFrame:
        """The rows of a subquery, which may name columns of the query around it."""
        self.outer.append(scope or Scope(Rel(self.spark.range(1))))
        try:
            return self.rel(query).df
        finally:
            self.outer.pop()

    def e_index(self, scope: Scope, table: str, index: int, name: str) -> Column:
        if scope.labels is not None:
            held = F.array_sort(F.collect_list(F.when(F.array_contains("_labels", table.upper()), F.struct("match_pos", F.col(name).alias("x")))))
            return F.get(held, F.lit(index) if index >= 0 else F.size(held) - 1 + index)["x"]
        return sequence.at(scope.names[table.upper()], name, index)

    def e_call(self, scope: Scope | None, node: Node) -> Column:
        _, qualifier, name, arguments, distinct = node
        if name == "PATH" and scope is not None and scope.labels is not None:
            return _path(qualifier, str(arguments[0][1]) if arguments else ",")
        if qualifier is not None and scope is not None and scope.labels is not None:
            found = reduce(lambda a, b: a | b, [F.array_contains("_labels", q.upper()) for q in qualifier])
            if name == "EXISTS":
                return F.count_if(found) > 0
            values = [self.expression(a, replace(scope, labels=None)) for a in arguments] or [F.lit(1)]
            return A.aggregate(name, *[F.when(found, v) for v in values], distinct=distinct)
        if (ready := self.prepared.pop(id(node), None)) is not None:
            return ready
        if qualifier is not None and qualifier[0].upper() == "PG_CATALOG" and (scope is None or "PG_CATALOG" not in scope.names):
            qualifier = None
        if qualifier is not None:
            return self.running(scope.names[qualifier[0].upper()], name, arguments, scope)
        values = [self.expression(a, scope if scope is None else replace(scope, labels=None)) for a in arguments]
        if name == "STRING_AGG":
            separator = arguments[1][1] if len(arguments) > 1 else ", "
            order = F.col("match_pos") if scope.labels is not None else F.col("_place") if scope.rel.order else values[0]
            held = A.string_agg(values[0], [order], separator)
            return F.array_join(F.array_sort(F.collect_set(values[0].cast("string"))), separator) if distinct else held
        if name in A.AGGREGATES and name != "EXISTS":
            return A.aggregate(name, *values, distinct=distinct)
        if name in ("DATE_PART", "DATE_PARTSTR"):
            literal = [a[1] for a in arguments[:-1]]
            return S.date_part(literal[0], values[-1]) if name == "DATE_PART" else S.date_partstr(literal[-1], values[-1], literal[0] if len(literal) > 1 else "LONG")
        if name == "SUBSTRING" and len(values) == 2 and arguments[1][0] == "literal" and isinstance(arguments[1][1], str):
            return S.scalar("SUBSTRING_REGEX", *values)
        if name in ("TODATE", "TOTIME", "TOTIMESTAMP") and len(values) > 2:
            return S.scalar(f"{name}_PARTS", *values)
        if name == "TOUTC" and len(values) == 1:
            return S.scalar("TOUTC", F.current_timezone(), values[0])
        if name in WHOLE and (kinds := self.kinds(scope, *values)) and all(k in casts.INTEGRAL for k in kinds):
            return values[0] if len(values) == 1 else S.divide(*values)
        if name in ("TIME_ADD", "TIME_DIFF", "TIMESTAMP_ADD") and (self.kinds(scope, values[0]) or [""])[0].startswith("time("):
            return S.scalar("CLOCK_DIFF" if name == "TIME_DIFF" else "CLOCK_ADD", *values)
        return S.scalar(name, *values) if name in S.FUNCTIONS else F.call_function(name, *values)

    def running(self, rel: Rel, name: str, arguments: list[Node], scope: Scope) -> Column:
        """T.f(x): over the rows from the partition's first to the current one. Moving averages that `_with_moving` prepared don't come here."""
        values = [self.expression(a, scope) for a in arguments]
        constant = lambda i: -arguments[i][1][1] if arguments[i][0] == "negative" else arguments[i][1]
        if name == "ROW_NUMBER":
            return F.row_number().over(rel.window())
        if name in ("RANK", "DENSE_RANK"):
            return sequence.ranked(rel, *[ascending(v) for v in values])[name == "DENSE_RANK"]
        if name == "LAG":
            return sequence.lag(rel, values[0], constant(1) if len(values) > 1 else 1, constant(2) if len(values) > 2 else None)
        if name == "NTH_VALUE":
            value = F.nth_value(values[0], constant(1)).over(rel.running())
            return value if len(values) < 3 else F.when(F.count(F.lit(1)).over(rel.running()) >= constant(1), value).otherwise(values[2])
        if name in ("MOVAVG", "MOVSTDDEV"):
            held = F.filter(F.collect_list(values[0]).over(rel.running()), lambda x: x.isNotNull())
            last = F.slice(held, F.greatest(F.lit(1), F.size(held) - constant(1) + 1), F.lit(constant(1)))
            n = F.size(last)
            mean = F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
            if name == "MOVAVG":
                return mean
            return F.when(n > 1, F.sqrt(F.aggregate(last, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.nullif(n - 1, F.lit(0))))
        if name == "EXPMOVAVG":
            held = F.collect_list(values[0]).over(rel.running())
            decay = float(constant(1))
            return F.aggregate(held, F.lit(None).cast("double"), lambda s, x: F.coalesce(s * (1 - decay) + x * decay, x.cast("double"), s))
        return A.aggregate(name, *values).over(rel.running())

    def e_and(self, s, a, b) -> Column:
        return self.expression(a, s) & self.expression(b, s)

    def e_or(self, s, a, b) -> Column:
        return self.expression(a, s) | self.expression(b, s)

    def e_not(self, s, a) -> Column:
        return ~self.expression(a, s)

    def e_isnull(self, s, a) -> Column:
        return self.expression(a, s).isNull()

    def e_negative(self, s, a) -> Column:
        return -self.expression(a, s)

    def e_distinct(self, s, a, b) -> Column:
        return S.distinct_from(self.expression(a, s), self.expression(b, s))

    def e_compare(self, s, op, a, b) -> Column:
        return COMPARE[op](self.expression(a, s), self.expression(b, s))

    def e_between(self, s, x, lo, hi, symmetric) -> Column:
        x, lo, hi = (self.expression(e, s) for e in (x, lo, hi))
        return S.between_symmetric(x, lo, hi) if symmetric else x.between(lo, hi)

    def e_like(self, s, x, pattern, escape) -> Column:
        return F.like(self.expression(x, s), self.expression(pattern, s), F.lit(escape) if escape else None)

    def e_ilike(self, s, x, pattern, escape) -> Column:
        return F.ilike(self.expression(x, s), self.expression(pattern, s), F.lit(escape) if escape else None)

    def e_similar(self, s, x, pattern) -> Column:
        return F.rlike(self.expression(x, s), F.concat(F.lit("^(?:"), self.expression(pattern, s), F.lit(")$")))

    def e_arith(self, s, op, a, b) -> Column:
        left, right = self.expression(a, s), self.expression(b, s)
        if op == "^":
            return F.pow(left, right)
        kinds = self.kinds(s, left, right)
        whole = all(k in casts.INTEGRAL for k in kinds)
        if kinds and kinds[0] in ("date", "timestamp", "timestamp_ntz") and op in "+-":
            if op == "-" and kinds[1] in ("date", "timestamp", "timestamp_ntz"):
                return S.scalar("DATE_DIFF" if kinds == ["date", "date"] else "TIMESTAMP_DIFF", left, right)
            return S.shift(left, kinds[0], right if op == "+" else -right)
        if op == "/":
            return S.divide(left, right) if kinds and whole else left / right
        return {"+": left + right, "-": left - right, "*": left * right, "%": left % right}[op]

    def kinds(self, scope: Scope | None, *columns: Column) -> list[str]:
        """The types of expressions over the scope's rows; none if they aren't known before aggregation."""
        df = scope.rel.df if scope else self.spark.range(1)
        try:
            return [k for _, k in df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).dtypes]
        except Exception:  # noqa: BLE001  mixed aggregate and plain columns
            return []

    def e_cast(self, s, e, kind) -> Column:
        column = self.expression(e, s)
        source = (self.kinds(s, column) or ["string"])[0]
        return casts.cast(column, casts.spark_type(*kind), "decimal" if source.startswith("decimal") else source)

    def e_case(self, s, argument, whens, other) -> Column:
        tests = [(self.expression(t, s) if argument is None else self.expression(argument, s) == self.expression(t, s), self.expression(v, s)) for t, v in whens]
        return reduce(lambda rest, w: F.when(w[0], w[1]).otherwise(rest), reversed(tests), self.expression(other, s))

    def e_exists(self, s, q) -> Column:
        return self.within(s, q).exists()

    def e_scalar(self, s, q) -> Column:
        df = self.within(s, q)
        one = q[0] == "select" and q[4] is None and any(_has_aggregate(t[0]) for t in q[1])  # an aggregate of everything is one row
        return (df if one else df.limit(1)).scalar()

    def e_in(self, s, x, kind, members) -> Column:
        value = self.expression(x, s)
        return value.isin(self.within(s, members)) if kind == "query" else value.isin(*[self.expression(m, s) for m in members])

    def e_quantified(self, s, op, x, every, kind, members) -> Column:
        value = self.expression(x, s)
        if kind == "list":
            return S.quantified(value, COMPARE[op], [self.expression(m, s) for m in members], every)
        df = self.within(s, members)
        c = df.columns[0]
        if every and op in ("<>", "!="):
            return ~value.isin(df)
        if not every and op == "=":
            return value.isin(df)
        facts = df.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(F.lit(1)).alias("n"), F.count(c).alias("known"), F.count_distinct(c).alias("kinds"))).scalar()
        lo, hi, n, known, kinds = (facts[f] for f in ("lo", "hi", "n", "known", "kinds"))
        if every:
            test = {">": value > hi, ">=": value >= hi, "<": value < lo, "<=": value <= lo, "=": (kinds <= 1) & (value == lo)}[op]
            return F.when(n == 0, True).when(~test, False).when(known < n, None).otherwise(test)
        test = {">": value > lo, ">=": value >= lo, "<": value < hi, "<=": value <= hi, "<>": (kinds > 1) | (value != lo), "!=": (kinds > 1) | (value != lo)}[op]
        return F.when(n == 0, False).when(test, True).when(known < n, None).otherwise(test)

    def e_star(self, *_) -> Column:
        raise ValueError("a star stands for columns in a SELECT list only")


def _moving(e) -> list[Node]:
    """The calls T.movavg, T.movstddev and T.expmovavg within an expression."""
    if not isinstance(e, tuple | list):
        return []
    own = [e] if isinstance(e, tuple) and e and e[0] == "call" and e[1] is not None and len(e[1]) == 1 and e[2] in ("MOVAVG", "MOVSTDDEV", "EXPMOVAVG") else []
    return own + [c for x in e for c in _moving(x)]


def _calls(e, name: str) -> bool:
    return isinstance(e, tuple | list) and (isinstance(e, tuple) and len(e) > 2 and e[0] == "call" and e[2] == name or any(_calls(x, name) for x in e))


def _path(labels: list[str] | None, separator: str) -> Column:
    """The labels of a match's rows in order; of these labels alone, if some are named."""
    own = F.filter("_labels", lambda x: x.isin(*[label.upper() for label in labels])) if labels else F.col("_labels")
    held = F.array_sort(F.collect_list(F.when(F.size(own) > 0, F.struct("match_pos", F.get(own, F.lit(0)).alias("x")))))
    return F.array_join(F.transform(held, lambda e: e["x"]), separator)


def _has_aggregate(e) -> bool:
    if not isinstance(e, tuple | list):
        return False
    if isinstance(e, tuple) and e and e[0] in ("scalar", "exists"):
        return False
    if isinstance(e, tuple) and e and e[0] == "call" and e[1] is None and (e[2] in A.AGGREGATES or e[2] in ("STRING_AGG", "PATH")):
        return True
    return any(_has_aggregate(x) for x in e)


def _may_have_keys(e: Node) -> bool:
    """Whether one of the conditions that must all hold compares columns for equality, so that Spark can join by keys."""
    if e[0] == "and":
        return _may_have_keys(e[1]) or _may_have_keys(e[2])
    equal = e[2:] if e[:2] == ("compare", "=") else e[1][1:] if e[0] == "not" and e[1][0] == "distinct" else None
    return equal is not None and all(_columns(x) for x in equal)


def _columns(e) -> list[Node]:
    if not isinstance(e, tuple | list):
        return []
    if isinstance(e, tuple) and e and e[0] == "column":
        return [e]
    return [c for x in e for c in _columns(x)]


def _replaced(e, new: dict):
    if isinstance(e, tuple) and e in new:
        return new[e]
    if isinstance(e, tuple | list):
        return type(e)(_replaced(x, new) for x in e)
    return e
