"""Named sources, targets and functions; built-in ones read and write what Spark can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Source = Callable[..., DataFrame]
Target = Callable[..., None]


class Registry:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sources: dict[str, Source] = {"SEQUENCE": lambda n: spark.range(int(n)).withColumnRenamed("id", "n")}
        self.targets: dict[str, Target] = {}
        for name in ("parquet", "orc", "json"):
            self.sources[name.upper()] = lambda path, kind=name: spark.read.format(kind).load(path)
            self.targets[name.upper()] = lambda df, path, mode="error", kind=name: df.write.format(kind).mode(mode).save(path)
        self.sources["CSV"] = lambda path, header="true", sep=",": spark.read.csv(path, header=header.lower() == "true", sep=sep)
        self.targets["CSV"] = lambda df, path, mode="error": df.write.mode(mode).csv(path, header=True)
        self.sources["TEXT"] = lambda path: spark.read.text(path)
        self.sources["BINARY"] = lambda path: spark.read.format("binaryFile").load(path)
        self.sources["JDBC"] = lambda url, query, **options: spark.read.format("jdbc").options(url=url, query=query, **options).load()

    def source(self, name: str, *arguments) -> DataFrame:
        if name.upper() not in self.sources:
            raise ValueError(f'component "{name}" is not installed')
        return self.sources[name.upper()](*arguments)

    def write(self, name: str, df: DataFrame, *arguments) -> None:
        if name.upper() not in self.targets:
            raise ValueError(f'component "{name}" is not installed')
        self.targets[name.upper()](df, *arguments)

    def function(self, name: str, run: Callable, returns: str = "string") -> None:
        """Registers a scalar function for SQL; a vectorised pandas UDF is registered as it is."""
        if getattr(run, "evalType", None) is not None:
            self.spark.udf.register(name, run)
        else:
            self.spark.udf.register(name, run, returns)
