"""Scaling, logistic regression, balanced bagging."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import fold
from colloquy.plans.lineage import saved


def min_max(rows: DataFrame, features: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """M6, B17. Scale features to [0, 1] by the minimum and maximum of `fitted_on` (the rows themselves by default: each set
    scaled independently). A constant feature becomes 0."""
    bounds = (fitted_on if fitted_on is not None else rows).agg(*(f(F.col(c).cast("double")).alias(f"{p}_{c}") for c in features for f, p in ((F.min, "min"), (F.max, "max"))))
    scaled = rows.crossJoin(F.broadcast(bounds))  # one row
    for c in features:
        span = F.col(f"max_{c}") - F.col(f"min_{c}")
        scaled = scaled.withColumn(c, F.coalesce((F.col(c).cast("double") - F.col(f"min_{c}")) / F.nullif(span, F.lit(0.0)), F.lit(0.0)))
    return scaled.select(*rows.columns)


def assemble(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)


def fit_logistic(rows: DataFrame, features: list[str], cost: float = 1.0, label: str = "label") -> LogisticRegressionModel:
    """M7. L2-regularised logistic regression without intercept; cost C weighs losses against half the squared weights."""
    n = max(1, rows.count())
    data = assemble(rows, features).withColumn(label, (F.col(label) > 0).cast("double"))
    return LogisticRegression(labelCol=label, regParam=1.0 / (cost * n), elasticNetParam=0.0, fitIntercept=False, standardization=False).fit(data)


def predict(model: LogisticRegressionModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """M8, S11. Add prob, the probability of the positive label."""
    return model.transform(assemble(rows, features)).withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def label_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    """A19. Positives, negatives and their whole ratio, in one row."""
    counts = rows.agg(F.sum((F.col(label) > 0).cast("bigint")).alias("positives"), F.sum((F.col(label) <= 0).cast("bigint")).alias("negatives"))
    return counts.withColumn("ratio", F.greatest(F.lit(1), F.floor(F.col("negatives") / F.greatest(F.col("positives"), F.lit(1)))))


def bagging_folds(rows: DataFrame, keys: list[str], folds: int, seed: int = 1, label: str = "label") -> DataFrame:
    """M9, F19. Negatives get a fold; positives get null and belong to every fold."""
    return rows.withColumn("fold", F.when(F.col(label) <= 0, fold(folds, seed, *keys)))


def fit_bagged(rows: DataFrame, features: list[str], keys: list[str], seed: int = 1, cost: float = 1.0, label: str = "label") -> list[LogisticRegressionModel]:
    """M9. One model for each fold of negatives, with all positives. The rows are cut and kept once; a few folds are fitted at a time."""
    folds = label_counts(rows).first()["ratio"]
    cut = saved(bagging_folds(rows, keys, folds, seed).select(label, "fold", *features))

    def fit(i: int) -> LogisticRegressionModel:
        return fit_logistic(cut.where(F.col("fold").isNull() | (F.col("fold") == i)), features, cost, label)

    with ThreadPool(min(4, folds)) as pool:
        return pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(folds))


def predict_bagged(models: list[LogisticRegressionModel], rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """A18. The mean probability over the models and the label, 1 at one half or more, else -1; in one pass over the rows, as each
    model is a weight vector."""
    shares = [F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda x, y: x + y, [F.col(f).cast("double") * F.lit(float(w)) for f, w in zip(features, m.coefficients.toArray(), strict=True)]))) for m in models]
    return rows.withColumn("prob", reduce(lambda x, y: x + y, shares) / F.lit(float(len(shares)))).withColumn("predicted", F.when(F.col("prob") >= 0.5, 1).otherwise(-1))


def ensemble_mean(scores: DataFrame, keys: list[str]) -> DataFrame:
    """A18. The same from rows of single scores."""
    return scores.groupBy(*keys).agg(F.avg("prob").alias("prob")).withColumn("predicted", F.when(F.col("prob") >= 0.5, 1).otherwise(-1))
