"""The engine: runs statements of the dialect on a Spark session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.functions import casts
from rowloom.operators import ml
from rowloom.plans.lower import Lowering, Scope
from rowloom.plans.parser import Node, parse
from rowloom.plans.plot import Planner, Plot
from rowloom.rel import Rel
from rowloom.sources import pgcatalog
from rowloom.sources.registry import Registry


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        casts.allow_time(spark)
        self.registry = Registry(spark)
        pgcatalog.register_functions(spark)
        self.learners: dict[str, ml.Trained] = {}
        self.locations: dict[str, tuple[str, list[str]]] = {}
        self.chosen: dict[str, str] = {}  # the DEFAULT and the CACHE location
        self.explaining = False
        self.lowering = Lowering(spark, self.registry, self.learners)

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def sql(self, text: str) -> DataFrame:
        """The rows of one query."""
        statements = parse(text)
        if len(statements) != 1 or statements[0][0] != "query":
            raise ValueError("sql() runs one query; use execute() for other statements")
        return self.relation(statements[0][1]).df

    def plot(self, text: str) -> Plot:
        """The specification and the layers of a query with PLOT."""
        return Planner(self.lowering).plot(text)

    def relation(self, query: Node) -> Rel:
        rel = self.lowering.rel(query)
        return rel.having(rel.df.drop("_labels", "_all"))

    def execute(self, text: str) -> list[DataFrame | None]:
        """Runs statements one after the other; queries give their rows, others None."""
        return [self.run(s) for s in parse(text)]

    def run(self, statement: Node) -> DataFrame | None:
        if self.explaining and statement[0] == "query":
            return self.do_explain(statement[1])
        return getattr(self, "do_" + statement[0])(*statement[1:])

    def do_explain_script(self, on: bool) -> None:
        """From now on queries give their plans, until it is switched off."""
        self.explaining = on

    def do_schema(self, create: bool) -> None:
        """The catalog of locations, tables and learners: Spark keeps the tables, so making it anew forgets what was added."""
        for held in (self.locations, self.chosen, self.learners):
            held.clear()

    def do_set_location(self, kind: str, name: str) -> None:
        if name.upper() not in self.locations:
            raise ValueError(f"no location {name}")
        self.chosen[kind] = name.upper()
        if kind == "DEFAULT":
            self.spark.sql(f"USE {name}")

    def do_query(self, query: Node) -> DataFrame:
        return self.relation(query).df

    def do_explain(self, query: Node) -> DataFrame:
        df = self.relation(query).df
        plan = df._jdf.queryExecution().toString()
        return self.spark.createDataFrame([(line,) for line in plan.splitlines()], "plan string")

    def do_create_view(self, name: str, columns: list | None, query: Node) -> None:
        df = self.relation(query).df
        if columns:
            df = df.toDF(*[c for c, _ in columns])
            kinds = dict(df.dtypes)
            df = df.select(*[casts.cast(df[c], casts.spark_type(*t), kinds[c]).alias(c) for c, t in columns])
        df.createOrReplaceTempView(name)

    def do_create_table(self, name: str, columns: list | None, query: Node | None, temporary: bool) -> None:
        schema = ", ".join(f"`{c}` {casts.spark_type(*t)}" for c, t in columns or [])
        if query is None:
            df = self.spark.createDataFrame([], schema)
        else:
            df = self.relation(query).df
            if columns:
                df = df.toDF(*[c for c, _ in columns]).selectExpr(*[f"cast(`{c}` as {casts.spark_type(*t)}) as `{c}`" for c, t in columns])
        if temporary:
            df.createOrReplaceTempView(name)
        else:
            df.write.saveAsTable(name)

    def do_insert(self, name: str, columns: list[str] | None, query: Node) -> None:
        target = self.spark.table(name)
        df = self.relation(query).df
        given = dict(zip([c.upper() for c in columns or target.columns], df.columns, strict=True))
        df = df.selectExpr(*[f"cast(`{given[f.name.upper()]}` as {f.dataType.simpleString()}) as `{f.name}`" if f.name.upper() in given else f"cast(null as {f.dataType.simpleString()}) as `{f.name}`" for f in target.schema.fields])
        df.write.insertInto(name)

    def do_update(self, name: str, sets: list, where: Node | None) -> None:
        from pyspark.sql import functions as F

        df = self.spark.table(name)
        scope = Scope(Rel(df))
        hit = F.lit(True) if where is None else F.coalesce(self.lowering.expression(where, scope), F.lit(False))
        new = {c.upper(): self.lowering.expression(e, scope) for c, e in sets}
        self._replace(name, df.select(*[F.when(hit, new[f.name.upper()].cast(f.dataType)).otherwise(df[f.name]).alias(f.name) if f.name.upper() in new else df[f.name] for f in df.schema.fields]))

    def do_delete(self, name: str, where: Node | None) -> None:
        from pyspark.sql import functions as F

        df = self.spark.table(name)
        self._replace(name, df.limit(0) if where is None else df.where(~F.coalesce(self.lowering.expression(where, Scope(Rel(df))), F.lit(False))))

    def _replace(self, name: str, df: DataFrame) -> None:
        """Writes the new rows beside the table, then puts them in its place."""
        df.write.mode("overwrite").saveAsTable(f"{name}__new")
        self.spark.sql(f"DROP TABLE {name}")
        self.spark.sql(f"ALTER TABLE {name}__new RENAME TO {name}")

    def do_drop(self, kind: str, name: str) -> None:
        if kind in ("CLASSIFIER", "CLUSTERER"):
            del self.learners[name.upper()]
        elif not self.spark.catalog.dropTempView(name):
            self.spark.sql(f"DROP {kind} {name}")

    def do_create_learner(self, kind: str, library: str | None, options: list, name: str, target: str | None, query: Node) -> None:
        df = self.relation(query).df
        if kind == "CLASSIFIER":
            self.learners[name.upper()] = ml.train_classifier(df, next(c for c in df.columns if c.upper() == target.upper()), *(str(o) for o in options[:1]))
        else:
            self.learners[name.upper()] = ml.train_clusterer(df, int(options[1]) if len(options) > 1 else 3, *(str(o) for o in options[:1]))

    def save_learner(self, name: str, path: str) -> None:
        self.learners[name.upper()].save(path)

    def load_learner(self, name: str, path: str) -> None:
        """Makes a saved classifier or clusterer known by a name."""
        self.learners[name.upper()] = ml.load(self.spark, path)

    def do_external_target(self, name: str, arguments: list, query: Node) -> None:
        self.registry.write(name, self.relation(query).df, *arguments)

    def do_native(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def do_location(self, name: str, kind: str, arguments: list[str]) -> None:
        self.locations[name.upper()] = (kind, arguments)
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")

    def do_add_table(self, location: str | None, name: str) -> None:
        self.spark.table(f"{location}.{name}" if location else name).createOrReplaceTempView(name)

    def do_remove(self, kind: str, name: str) -> None:
        self.locations.pop(name.upper(), None) if kind == "LOCATION" else self.spark.catalog.dropTempView(name)

    def do_list(self, words: list[str]) -> DataFrame:
        """LIST, SHOW and DESCRIBE: locations, options, learners, tables, what a table's columns are, or tables of locations that weren't added."""
        verb, what, *names = words[0].upper(), words[1].upper() if len(words) > 1 else "TABLES", *words[2:]
        if what.startswith("LOCATION"):
            marks = {n: " ".join(sorted(k for k, chosen in self.chosen.items() if chosen == n)) for n in self.locations}
            return self.spark.createDataFrame([(n, k, ", ".join(a), marks[n]) for n, (k, a) in sorted(self.locations.items())], "location string, type string, params string, chosen string")
        if what.startswith("CLASSIFIER") or what.startswith("CLUSTERER"):
            learners = [(n, t.target) for n, t in sorted(self.learners.items()) if (t.target is not None) == what.startswith("CLASSIFIER")]
            return self.spark.createDataFrame(learners, "name string, target string")
        if what in ("OPTIONS", "CONFIG"):
            return self.spark.sql("SET").select("key", "value")
        if what == "REMAINING":
            return self._remaining([n for n in names if n.upper() != "TABLES"])
        if verb == "DESCRIBE" and what in ("TABLE", "VIEW") and names:
            fields = self.spark.table(".".join(names)).schema.fields
            return self.spark.createDataFrame([(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields)], "position int, name string, type string, nullable boolean")
        found = sorted((t.name, t.tableType, t.isTemporary) for t in self.spark.catalog.listTables())
        return self.spark.createDataFrame(found, "name string, type string, temporary boolean")

    def _remaining(self, names: list[str]) -> DataFrame:
        added = {t.name.upper() for t in self.spark.catalog.listTables() if t.isTemporary}
        rows = [(place, t.name) for place in names or sorted(self.locations) for t in self.spark.catalog.listTables(place) if not t.isTemporary and t.name.upper() not in added]
        return self.spark.createDataFrame(sorted(rows), "location string, name string")
