"""Classifiers and calibration with MLlib, and the interface of pluggable pair scorers."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import augment_name, serialize
from tessera.operators import boosting


class PairScorer(Protocol):
    """Anything that gives pairs (sid, eid, ...) a ``score`` from 0 to 1, such as a cross-encoder behind an Arrow function."""

    def score(self, pairs: DataFrame) -> DataFrame: ...


class FeatureScorer:
    """The scorer that stands in for a cross-encoder: a classifier over pair features."""

    def __init__(self, model, features: tuple[str, ...]):
        self.model, self.features = model, features

    def score(self, pairs: DataFrame) -> DataFrame:
        return score(self.model, pairs, self.features)


def as_probability(raw: np.ndarray) -> np.ndarray:
    """Model outputs as probabilities: the second softmax column of rows of logits; of single outputs a sigmoid if
    any lies outside 0 to 1."""
    raw = np.asarray(raw, np.float64)
    if raw.ndim == 2:
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        return e[:, 1] / e.sum(axis=1)
    return 1 / (1 + np.exp(-raw)) if len(raw) and (raw.min() < 0 or raw.max() > 1) else raw


def scorer_pairs(pairs: DataFrame, s1: DataFrame, pool: DataFrame, augment_percent: int = 30, seed: int = 42) -> DataFrame:
    """``sid, eid, left, right, label``: training pairs as serialised records. Of the positives, ``augment_percent``
    have noise in the pool record's name, chosen by a hash of the pair."""
    line = lambda df, key, tag: df.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{tag}{c}") for c in ("business_name", "business_address", "country")])
    full = pairs.join(line(s1, "sid", "a_"), "sid").join(line(pool, "eid", "b_"), "eid")
    noisy = (F.col("label") == 1) & (F.pmod(F.xxhash64("sid", "eid", F.lit(seed)), F.lit(100)) < augment_percent)
    name = F.when(noisy, augment_name(F.col("b_business_name"), F.concat("sid", "eid"), seed)).otherwise(F.col("b_business_name"))
    return full.select("sid", "eid", serialize(F.col("a_business_name"), F.col("a_business_address"), F.col("a_country")).alias("left"), serialize(name, F.col("b_business_address"), F.col("b_country")).alias("right"), "label")


_KINDS = {"gbt": boosting.BoostedTrees, "lr": LogisticRegressionModel, "isotonic": IsotonicRegressionModel}


def save(model, path: str) -> None:
    if isinstance(model, boosting.BoostedTrees):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load(kind: str, path: str):
    """A saved model of kind ``gbt``, ``lr`` or ``isotonic``."""
    return _KINDS[kind].load(path)


def assemble(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def fit_gbt(df: DataFrame, features: tuple[str, ...], rounds: int = 500, depth: int = 6, rate: float = 0.05, least: int = 20):
    """Boosted trees over all rows; positive rows weigh negatives per positive."""
    return boosting.fit(df, features, rounds, depth, rate, least)


def fit_lr(df: DataFrame, features: tuple[str, ...], c: float = 1.0):
    """L2-penalised logistic regression with inverse strength ``c``."""
    return LogisticRegression(labelCol="label", featuresCol="features", regParam=1 / (c * max(1, df.count())), elasticNetParam=0.0, standardization=False, maxIter=1000).fit(assemble(df, features))


def score(model, df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Adds the probability of a match."""
    if isinstance(model, boosting.BoostedTrees):
        return model.score(df, features)
    return model.transform(assemble(df, features)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_isotonic(scored: DataFrame):
    return IsotonicRegression(isotonic=True, labelCol="label", featuresCol="score").fit(scored)


def calibrate(model, scored: DataFrame) -> DataFrame:
    """Scores on the fitted curve, clipped at its ends."""
    return model.transform(scored.withColumn("raw_score", F.col("score"))).withColumn("score", F.col("prediction")).drop("prediction")


def tabular_demo(df: DataFrame, categories: tuple[str, ...], numbers: tuple[str, ...], label: str, seed: int = 7, rounds: int = 5) -> DataFrame:
    """One-hot encoding, a split into three parts, boosted trees and metrics on the second part."""
    steps = [StringIndexer(inputCols=list(categories), outputCols=[f"{c}_i" for c in categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_v" for c in categories]), VectorAssembler(inputCols=[*numbers, *(f"{c}_v" for c in categories)], outputCol="features"), GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=4, seed=seed)]
    train, check, _ = df.randomSplit([0.67, 0.22, 0.11], seed)
    done = Pipeline(stages=steps).fit(train).transform(check)
    got = {m: MulticlassClassificationEvaluator(labelCol=label, metricName=m).evaluate(done) for m in ("accuracy", "weightedPrecision", "weightedRecall", "f1")}
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in got.items()], "metric string, value double")
