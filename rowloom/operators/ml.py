"""Classifiers, clusterers and imputation as named objects, on Spark's own learners."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

CLASSIFIERS = {"J48": DecisionTreeClassifier, "TREE": DecisionTreeClassifier, "FOREST": RandomForestClassifier, "LOGISTIC": LogisticRegression, "BAYES": NaiveBayes}
CLUSTERERS = {"KMEANS": KMeans, "BISECTING": BisectingKMeans, "MIXTURE": GaussianMixture}
#: Spark's clusterers hold their points in memory, about 170 bytes each, and read them in every pass: so many distinct ones are in a partition.
POINTS_IN_A_TASK = 500_000


@dataclass
class Trained:
    model: PipelineModel
    features: list[str]
    target: str | None = None
    kind: str = "string"

    def save(self, path: str) -> None:
        """The model and what it takes and gives, in two folders of the path, which may be on any file system Spark reads."""
        self.model.write().overwrite().save(f"{path}/model")
        about = json.dumps({"features": self.features, "target": self.target, "kind": self.kind})
        SparkSession.active().createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> Trained:
    """What `Trained.save` wrote."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return Trained(PipelineModel.load(f"{path}/model"), about["features"], about["target"], about["kind"])


def _features(df: DataFrame, columns: list[str]) -> tuple[list, DataFrame]:
    stages, inputs = [], []
    kinds = dict(df.dtypes)
    for c in columns:
        if kinds[c] in ("string", "boolean"):
            stages += [StringIndexer(inputCol=f"_s_{c}", outputCol=f"_i_{c}", handleInvalid="keep"), OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_f_{c}")]
            inputs.append(f"_f_{c}")
        else:
            inputs.append(f"_n_{c}")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="keep")], _prepared(df, columns)


def _prepared(df: DataFrame, columns: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({(f"_s_{c}" if kinds[c] in ("string", "boolean") else f"_n_{c}"): F.coalesce(F.col(c).cast("string"), F.lit("")) if kinds[c] in ("string", "boolean") else F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def train_classifier(df: DataFrame, target: str, algorithm: str = "TREE", **options) -> Trained:
    """All other columns are features; rows without a target are left out."""
    columns = [c for c in df.columns if c != target]
    stages, ready = _features(df.where(F.col(target).isNotNull()), columns)
    ready = ready.withColumn("_target", F.col(target).cast("string"))
    label = StringIndexer(inputCol="_target", outputCol="_label").fit(ready)
    learner = CLASSIFIERS[algorithm.upper()](featuresCol="_features", labelCol="_label", predictionCol="_prediction", **options)
    back = IndexToString(inputCol="_prediction", outputCol="_class", labels=label.labels)
    return Trained(Pipeline(stages=[*stages, learner, back]).fit(label.transform(ready)), columns, target, dict(df.dtypes)[target])


def train_clusterer(df: DataFrame, k: int = 3, algorithm: str = "KMEANS", seed: int = 1, **options) -> Trained:
    """Every row counts: equal rows are one point that weighs as much as they do, and the order of points doesn't depend on the partitions of the rows."""
    stages, ready = _features(df, df.columns)
    ready = ready.select([c for c in ready.columns if c not in df.columns])
    prepared = Pipeline(stages=stages).fit(ready)
    points = ready.groupBy(*ready.columns).agg(F.count(F.lit(1)).cast("double").alias("_weight")).persist(StorageLevel.DISK_ONLY)
    try:
        parts = math.ceil(max(points.count(), 1) / POINTS_IN_A_TASK)
        dealt = points.coalesce(1) if parts == 1 else points.repartitionByRange(parts, *ready.columns)
        learner = CLUSTERERS[algorithm.upper()](featuresCol="_features", predictionCol="_cluster", weightCol="_weight", k=k, seed=seed, **options)
        learnt = learner.fit(prepared.transform(dealt.sortWithinPartitions(*ready.columns)))
    finally:
        points.unpersist()
    return Trained(PipelineModel([*prepared.stages, learnt]), df.columns)


def _predicted(df: DataFrame, trained: Trained, output: str) -> DataFrame:
    found = trained.model.transform(_prepared(df, trained.features))
    return found.withColumn(output, F.col("_class").cast(trained.kind))


def classify(df: DataFrame, trained: Trained, output: str) -> DataFrame:
    """The prediction as a new first column."""
    if output in df.columns:
        raise ValueError(f"column {output} exists")
    return _predicted(df, trained, output).select(output, *df.columns)


def cluster(df: DataFrame, trained: Trained, output: str) -> DataFrame:
    if output in df.columns:
        raise ValueError(f"column {output} exists")
    return trained.model.transform(_prepared(df, trained.features)).withColumn(output, F.col("_cluster").cast("int")).select(output, *df.columns)


def impute(df: DataFrame, column: str, trained: Trained, flag: str | None = None) -> DataFrame:
    """Nulls of the column replaced by predictions; the flag, right after the column, says where."""
    filled = _predicted(df, trained, "_filled")
    out = []
    for c in df.columns:
        out.append(F.coalesce(c, "_filled").alias(c) if c == column else F.col(c))
        if c == column and flag:
            out.append(F.col(c).isNull().alias(flag))
    return filled.select(*out)
