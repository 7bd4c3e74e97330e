"""The methods by name, as MLlib stages over named feature columns.

The support vector methods have no MLlib counterpart for regression. They are
approximated by a robust (Huber) linear fit on scaled features, on their cubic
expansion, or on random Fourier features, and do not equal a kernel solver's numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import ElementwiseProduct, PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.models.forest import Forest
from rackpulse.models.fourier import RandomFourierFeatures
from rackpulse.operators import neighbours
from rackpulse.operators.features import TrainingFacts, training_facts
from rackpulse.session import materialise

CLASSIFIERS = ("lor", "nbc", "dt", "rf", "knn")
REGRESSORS = ("lir", "rir", "knnr", "svr_lin", "svr_poly", "svr_rbf")

# Parameters of the methods.
SEED, TREES, NEIGHBOURS_CLASS, NEIGHBOURS_REG, RIDGE_ALPHA, LOGISTIC_C = 30, 100, 5, 11, 0.1, 1.0
# Limits of the trees, the same for one tree and for a forest: deepest node (MLlib allows no more), split points
# of a numeric feature, and memory for node statistics of one pass of MLlib's tree.
MAX_TREE_DEPTH, TREE_BINS, TREE_MEMORY_MB = 30, 256, 1024


def check_method(ctype: str, method: str) -> None:
    allowed = REGRESSORS if ctype == "reg" else CLASSIFIERS
    if method not in allowed:
        raise ValueError(f"method {method} does not fit task {ctype}; choose one of {allowed}")


def _scaled(n_features: int, n_rows: int) -> list:
    """Zero mean and unit population deviation (MLlib's scaler uses the sample deviation)."""
    factor = math.sqrt(n_rows / (n_rows - 1)) if n_rows > 1 else 1.0
    return [
        StandardScaler(inputCol="features", outputCol="_standard", withMean=True, withStd=True),
        ElementwiseProduct(
            inputCol="_standard", outputCol="_scaled", scalingVec=Vectors.dense([factor] * n_features)
        ),
    ]


def _stages(ctype: str, method: str, n_features: int, label: str, n_rows: int, label_sd: float) -> list:
    huber = lambda col: LinearRegression(
        featuresCol=col, labelCol=label, loss="huber", regParam=1.0 / max(n_rows, 1), maxIter=200
    )
    if method == "lor":
        logistic = LogisticRegression(
            labelCol=label, regParam=1.0 / (LOGISTIC_C * max(n_rows, 1)), standardization=False
        )
        return [logistic if ctype == "binary" else OneVsRest(classifier=logistic, labelCol=label, parallelism=4)]
    if method == "nbc":
        return [NaiveBayes(labelCol=label, modelType="gaussian")]
    tree = {"labelCol": label, "seed": SEED, "maxDepth": MAX_TREE_DEPTH, "maxBins": TREE_BINS}
    if method == "dt":
        # More memory for node statistics means fewer passes per tree level.
        return [DecisionTreeClassifier(**tree, maxMemoryInMB=TREE_MEMORY_MB)]
    if method == "rf":
        return [Forest(numTrees=TREES, **tree)]
    if method == "lir":
        return [LinearRegression(labelCol=label, solver="normal")]
    if method == "rir":
        # MLlib scales the penalty by the label's deviation and averages the loss.
        return [LinearRegression(
            labelCol=label, solver="normal", regParam=RIDGE_ALPHA / max(n_rows, 1) * label_sd,
            elasticNetParam=0.0, standardization=False,
        )]
    scaled = _scaled(n_features, n_rows)
    if method == "svr_lin":
        return [*scaled, huber("_scaled")]
    if method == "svr_poly":
        return [*scaled, PolynomialExpansion(inputCol="_scaled", outputCol="_cubic", degree=3), huber("_cubic")]
    return [
        *scaled,
        RandomFourierFeatures(inputCol="_scaled", outputCol="_fourier", dim=n_features, gamma=1.0 / n_features),
        huber("_fourier"),
    ]


@dataclass
class FittedModel:
    """A fitted MLlib pipeline with its features; adds ``prediction`` to a frame."""

    pipeline: PipelineModel
    features: list[str]
    label: str

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.pipeline.transform(df)
        return scored.select(*df.columns, "prediction")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    def importances(self) -> dict[str, float] | None:
        last = self.pipeline.stages[-1]
        values = getattr(last, "featureImportances", None)
        return dict(zip(self.features, map(float, values.toArray()))) if values is not None else None

    def coefficients(self, spark) -> DataFrame:
        """One row per class of a logistic model, one column per feature."""
        last = self.pipeline.stages[-1]
        if hasattr(last, "models"):
            rows = [m.coefficients.toArray() for m in last.models]
        else:
            rows = [last.coefficients.toArray()]
        schema = ", ".join(f"`{f}` double" for f in self.features)
        return spark.createDataFrame([tuple(map(float, r)) for r in rows], schema)


@dataclass
class NeighbourModel:
    """Nearest-neighbour model: its training table, with an integer ``id`` per row."""

    train: DataFrame
    features: list[str]
    label: str
    k: int
    regression: bool

    def transform(self, df: DataFrame) -> DataFrame:
        # Rows are numbered and written once, so each gets its own answer back.
        queries = materialise(_with_vector(df, self.features).withColumn("id", F.monotonically_increasing_id()), "queries")
        found = neighbours.nearest_neighbours(self.train, queries, "id", "id", "_vector", self.label, self.k)
        answer = neighbours.mean_label(found) if self.regression else neighbours.vote(found)
        return queries.join(answer.withColumnRenamed("query_id", "id"), "id").select(*df.columns, "prediction")

    def save(self, path: str) -> None:
        self.train.write.mode("overwrite").parquet(path)


def _with_vector(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumn("_vector", F.array(*[F.col(f"`{f}`").cast("double") for f in features]))


def _with_id(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature vector and an id that is a function of the row, equal rows sharing it; it orders training rows at equal distance."""
    return _with_vector(df, features).withColumn("id", F.xxhash64(*[f"`{c}`" for c in df.columns]))


def fit(
    df: DataFrame, ctype: str, method: str, features: list[str], label: str, facts: TrainingFacts | None = None
):
    """Fit one method on a training frame; ``facts`` saves the pass that finds them."""
    check_method(ctype, method)
    if method in ("knn", "knnr"):
        k = NEIGHBOURS_REG if method == "knnr" else NEIGHBOURS_CLASS
        return NeighbourModel(_with_id(df, features), features, label, k, method == "knnr")
    facts = facts or training_facts(df, features, label)
    stages = _stages(ctype, method, len(features), label, facts.n_rows, facts.label_deviation)
    assembled = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    return FittedModel(Pipeline(stages=[assembled, *stages]).fit(df), features, label)


def load(path: str, features: list[str], label: str) -> FittedModel:
    return FittedModel(PipelineModel.load(path), features, label)


def load_neighbours(spark, path: str, features: list[str], label: str, regression: bool) -> NeighbourModel:
    k = NEIGHBOURS_REG if regression else NEIGHBOURS_CLASS
    return NeighbourModel(spark.read.parquet(path), features, label, k, regression)


def vector_features(df: DataFrame, vector: str, size: int, prefix: str = "f") -> DataFrame:
    """An array or vector column as named feature columns."""
    values = F.col(vector) if dict(df.dtypes)[vector].startswith("array") else vector_to_array(vector)
    return df.select(
        *[c for c in df.columns if c != vector],
        *[values[i].cast("double").alias(f"{prefix}{i}") for i in range(size)],
    )
