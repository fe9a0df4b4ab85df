"""Rerankers on Spark ML: boosted trees with a holdout, two-stage stacking out of fold, isotonic calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Prior:
    """Stands in for a model where the labels have one class: every pair gets the share of positives."""

    def __init__(self, share: float):
        self.share = share

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prob", F.lit(self.share))


def find_saved(spark: SparkSession, roots: list[str], patterns: list[str]) -> str:
    """The path of a saved model: patterns (globs) in order of precedence, for each the roots in order, then by name. Raises if
    there is none."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for pattern in patterns:
        for root in roots:
            path = fs.Path(f"{root.rstrip('/')}/{pattern}/metadata")
            found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
            if found:
                return min(x.getPath().getParent().toString() for x in found)
    raise FileNotFoundError(f"{patterns} below {roots}")


class Reranker:
    def __init__(self, model: PipelineModel):
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        """df with prob."""
        out = self.model.transform(df).withColumn("prob", vector_to_array("probability")[1])
        return out.drop("features", "rawPrediction", "probability", "prediction")

    def importances(self) -> dict[str, float]:
        columns = self.model.stages[0].getInputCols()
        return dict(zip(columns, self.model.stages[-1].featureImportances.toArray().tolist(), strict=True))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Reranker:
        return cls(PipelineModel.load(path))


def fit_reranker(df: DataFrame, columns: list[str], label: str = "label", *, iterations: int = 20, depth: int = 5, rate: float = 0.1, subsample: float = 1.0, features: str = "auto", validation: str | None = None, seed: int = 42, strict: bool = False) -> Reranker | Prior:
    """Boosted trees on the columns. subsample and features: the share of rows of each tree, of columns of each split ("auto":
    all). validation: a boolean column that marks the holdout rows for early stopping.

    With one class: raises if strict, else gives the prior.
    """
    seen = df.agg(F.countDistinct(label).alias("k"), F.avg(label).alias("share")).first()
    if seen["k"] < 2:
        if strict:
            raise ValueError("the labels have one class only")
        return Prior(float(seen["share"] or 0.0))
    gbt = GBTClassifier(labelCol=label, featuresCol="features", maxIter=iterations, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy=features, seed=seed)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    stages = [VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"), gbt]
    return Reranker(Pipeline(stages=stages).fit(df))


def scored_pairs(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], batch: int = 64) -> DataFrame:
    """pairs (query, candidate, left, right) with prob by a plugged scorer of text pairs, such as a cross-encoder.

    A task scores batches of pairs of like length (shortest first), so padding is small. Where the scorer runs out of memory
    the batch is halved; a pair that can't be scored alone gets 0.
    """
    kept = [(f.name, f.dataType.simpleString()) for f in pairs.schema.fields if f.name != "prob"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            left, right = pdf["left"].fillna("").tolist(), pdf["right"].fillna("").tolist()
            order = sorted(range(len(pdf)), key=lambda k: len(left[k]) + len(right[k]))
            prob, at, size = [0.0] * len(pdf), 0, batch
            while at < len(order):
                some = order[at : at + size]
                try:
                    found = scorer([left[k] for k in some], [right[k] for k in some])
                except MemoryError:
                    if size > 1:
                        size //= 2
                        continue
                    found = [0.0]
                for k, x in zip(some, found, strict=True):
                    prob[k] = float(x)
                at += len(some)
            yield pdf.assign(prob=prob)

    return pairs.select(*(n for n, _ in kept)).mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in [*kept, ("prob", "double")]))


def out_of_fold(df: DataFrame, columns: list[str], fold: str, folds: int, **options) -> DataFrame:
    """df with prob by models that have not seen the row's fold: what a second stage may train on."""
    out = None
    for k in range(folds):
        part = fit_reranker(df.where(F.col(fold) != k), columns, **options).transform(df.where(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    return out


def fit_calibration(df: DataFrame, prob: str = "prob", label: str = "label", bins: int = 100_000) -> IsotonicRegressionModel:
    """Scores are rounded to 1 in `bins` and pooled with their weights before the fit, which runs in one task: that task sees
    at most bins + 1 rows."""
    score = F.round(F.col(prob) * bins) / bins
    rows = df.groupBy(score.alias("features")).agg(F.avg(F.col(label).cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    return IsotonicRegression(labelCol="label", featuresCol="features", weightCol="weight", isotonic=True).fit(rows)


def calibrated(model: IsotonicRegressionModel, df: DataFrame, prob: str = "prob") -> DataFrame:
    """df with calibrated, clipped to [0, 1]."""
    model = model.copy({model.featuresCol: prob, model.predictionCol: "calibrated"})
    return model.transform(df).withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "calibrated")))


def save_run(df_holdout: DataFrame, path: str, **facts: float) -> None:
    """One JSON row beside a saved model: the threshold, top k, recall and whatever else describes the run, with the holdout's
    columns."""
    for name, value in facts.items():
        df_holdout = df_holdout.withColumn(name, F.lit(value))
    df_holdout.coalesce(1).write.mode("overwrite").json(path)
