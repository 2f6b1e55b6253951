"""Boosted trees and other classifiers over prepared datasets, with Spark ML."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.functions.scalars import finite_features
from telltale.operators import metrics
from telltale.operators.sampling import draw
from telltale.operators.scaling import fit_robust_scaler, robust_scale
from telltale.operators.stats import class_weight

# Boosting presets, in Spark ML's terms.
PRESETS = {
    "primary": dict(maxIter=500, maxDepth=9, stepSize=0.03, subsamplingRate=0.85, featureSubsetStrategy="0.85", minInstancesPerNode=2, minInfoGain=0.0),
    "secondary": dict(maxIter=500, maxDepth=6, stepSize=0.03, subsamplingRate=0.85, featureSubsetStrategy="0.85", minInstancesPerNode=15),
    "plain": dict(maxIter=400, maxDepth=7, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="sqrt", minInstancesPerNode=5),
    "voting_primary": dict(maxIter=300, maxDepth=8, stepSize=0.05),
    "voting_secondary": dict(maxIter=300, maxDepth=8, stepSize=0.05, minInstancesPerNode=20),
    "voting_plain": dict(maxIter=200, maxDepth=6, stepSize=0.05),
    "stacking_primary": dict(maxIter=200, maxDepth=7, stepSize=0.05),
    "stacking_secondary": dict(maxIter=200, maxDepth=7, stepSize=0.05, minInstancesPerNode=20),
    "stacking_plain": dict(maxIter=150, maxDepth=6, stepSize=0.05),
}
UNWEIGHTED = {"plain", "voting_plain", "stacking_plain"}
PATIENCE = 50
SEED = 42

# Search ranges (low, high, kind) and the stored best parameters.
SPACES = {
    "primary": {"n_estimators": (300, 1000, "int"), "max_depth": (5, 12, "int"), "learning_rate": (0.01, 0.1, "log"),
                "subsample": (0.7, 0.95, "float"), "colsample_bytree": (0.7, 0.95, "float"),
                "colsample_bylevel": (0.7, 0.95, "float"), "min_child_weight": (1, 10, "int"),
                "gamma": (0.0, 0.5, "float"), "reg_alpha": (0.0, 1.0, "float"), "reg_lambda": (0.5, 3.0, "float")},
    "secondary": {"n_estimators": (300, 1000, "int"), "max_depth": (5, 12, "int"), "learning_rate": (0.01, 0.1, "log"),
                  "subsample": (0.7, 0.95, "float"), "colsample_bytree": (0.7, 0.95, "float"),
                  "min_child_samples": (10, 50, "int"), "num_leaves": (31, 127, "int"),
                  "reg_alpha": (0.0, 1.0, "float"), "reg_lambda": (0.5, 3.0, "float")},
}
TUNED = {"n_estimators": 731, "max_depth": 12, "learning_rate": 0.08629969099319279, "subsample": 0.9348323826941092,
         "colsample_bytree": 0.7898511898530559, "colsample_bylevel": 0.7594486947290897, "min_child_weight": 1,
         "gamma": 0.23944557802645997, "reg_alpha": 0.07671627229441166, "reg_lambda": 1.4128544616406837}
BASELINE_AUC = 0.856


def spark_params(tuned: dict) -> dict:
    """Search parameters as Spark ML ones. L1/L2 terms have no counterpart in Spark's trees."""
    leaves = tuned.get("num_leaves")
    depth = tuned["max_depth"] if leaves is None else min(tuned["max_depth"], math.ceil(math.log2(leaves)))
    share = tuned["colsample_bytree"] * tuned.get("colsample_bylevel", 1.0)
    return dict(maxIter=tuned["n_estimators"], maxDepth=depth, stepSize=tuned["learning_rate"],
                subsamplingRate=tuned["subsample"], featureSubsetStrategy=f"{share:.4f}",
                minInstancesPerNode=tuned.get("min_child_samples", tuned.get("min_child_weight", 1)))


def weighted(train: DataFrame) -> DataFrame:
    """Positives weigh negatives/positives, read from one aggregate row."""
    w = float(class_weight(train).first().weight) or 1.0
    return train.withColumn("weight", F.when(F.col("label") == 1, F.lit(w)).otherwise(F.lit(1.0)))


def probability(column: str = "probability") -> Column:
    return vector_to_array(column)[1]


def _pipeline(features: list[str], classifier) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), classifier])


def fit_gbt(train: DataFrame, features: list[str], preset: str = "primary", validation: DataFrame | None = None,
            patience: int = PATIENCE, **overrides) -> PipelineModel:
    """Boosted trees with class weights. Feature order is fixed by the assembler. With ``validation`` rows the
    ensemble is cut to the rounds before the loss there stopped falling."""
    params = {**PRESETS[preset], **overrides}
    gbt = GBTClassifier(featuresCol="features", labelCol="label", seed=SEED, lossType="logistic", cacheNodeIds=True, **params)
    rows = finite_features(train, features)
    if preset not in UNWEIGHTED:
        gbt.setWeightCol("weight")
        rows = weighted(rows)
    model = _pipeline(features, gbt).fit(rows)
    if validation is None:
        return model
    ready = model.stages[0].transform(finite_features(validation, features)).withColumn("weight", F.lit(1.0))
    best = best_round(model.stages[1].evaluateEachIteration(ready), patience)  # one number per round
    return PipelineModel([model.stages[0], first_trees(model.stages[1], best)])


def feature_names(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def score_rows(df: DataFrame, model: PipelineModel, name: str = "score") -> DataFrame:
    """P(anomaly) per row from features in training order, and the predicted class."""
    ready = finite_features(df, feature_names(model)) if len(model.stages) > 1 else df
    out = model.transform(ready)
    return out.select(*df.columns, probability().alias(name), F.col("prediction").cast("int").alias("pred"))


def early_stop(train: DataFrame, validation: DataFrame, features: list[str], preset: str = "primary",
               patience: int = PATIENCE, **overrides) -> tuple[PipelineModel, int]:
    """One fit, cut after the round from which ``patience`` rounds brought no better validation loss, and that round."""
    model = fit_gbt(train, features, preset, validation, patience, **overrides)
    return model, model.stages[-1].getNumTrees


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first ``n`` rounds. Boosting adds trees without changing earlier ones, so it is what a
    fit of ``n`` rounds gives."""
    sc = model._sc if hasattr(model, "_sc") else SparkSession.active().sparkContext
    java = model._java_obj
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    for i, (tree, weight) in enumerate(zip(java.trees()[:n], java.treeWeights()[:n])):
        trees[i], weights[i] = tree, weight
    cut = GBTClassificationModel(sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        java.uid(), trees, weights, java.numFeatures(), java.numClasses()))
    return model._copyValues(cut)


def best_round(losses: list[float], patience: int = PATIENCE) -> int:
    """1-based round with the lowest loss seen before patience runs out."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_mlp(train: DataFrame, features: list[str], hidden=(128, 64, 32), max_iter: int = 300):
    """A 128-64-32 network on robustly scaled rows: (scaler, model)."""
    ready = finite_features(train, features)
    scaler = fit_robust_scaler(ready, features)
    net = MultilayerPerceptronClassifier(layers=[len(features), *hidden, 2], maxIter=max_iter, seed=SEED,
                                         blockSize=256, featuresCol="features", labelCol="label")
    return scaler, _pipeline(features, net).fit(robust_scale(ready, scaler))


def score_mlp(df: DataFrame, fitted, name: str = "score") -> DataFrame:
    scaler, model = fitted
    scaled = robust_scale(finite_features(df, feature_names(model)), scaler)
    out = model.transform(scaled).select("seq", probability().alias(name), F.col("prediction").cast("int").alias("pred"))
    return df.join(out, "seq")


def fit_voting(train: DataFrame, features: list[str], **overrides) -> list[PipelineModel]:
    """Three boosted models whose probabilities are averaged; no row limit."""
    return [fit_gbt(train, features, f"voting_{p}", **overrides) for p in ("primary", "secondary", "plain")]


def _all_scores(df: DataFrame, models: list[PipelineModel]) -> DataFrame:
    """Each model's probability as score_0, score_1, … in one pass over the rows."""
    names = feature_names(models[0])
    out = models[0].stages[0].transform(finite_features(df, names))
    for i, m in enumerate(models):
        out = (m.stages[1].transform(out).withColumn(f"score_{i}", probability())
               .drop("rawPrediction", "probability", "prediction"))
    return out.select(*df.columns, *[f"score_{i}" for i in range(len(models))])


def average_scores(df: DataFrame, names: list[str]) -> DataFrame:
    mean = reduce(lambda a, b: a + b, [F.col(n) for n in names]) / len(names)
    return df.withColumn("score", mean).withColumn("pred", (F.col("score") > 0.5).cast("int"))


def voting_soft(df: DataFrame, models: list[PipelineModel]) -> DataFrame:
    return average_scores(_all_scores(df, models), [f"score_{i}" for i in range(len(models))])


def fit_stacking(train: DataFrame, features: list[str], folds: int = 3, id_column: str = "seq", **overrides):
    """Out-of-fold scores of three models feed a logistic model: (base models, meta model)."""
    presets = [f"stacking_{p}" for p in ("primary", "secondary", "plain")]
    fold = F.conv(F.substring(draw("fold", id_column), 1, 8), 16, 10).cast("long") % folds
    parted = train.withColumn("_fold", fold)
    held_out = []
    for i in range(folds):
        models = [fit_gbt(parted.where(F.col("_fold") != i), features, p, **overrides) for p in presets]
        held_out.append(_all_scores(parted.where(F.col("_fold") == i), models))
    meta = _meta_pipeline(len(presets)).fit(reduce(DataFrame.unionByName, held_out))
    return [fit_gbt(train, features, p, **overrides) for p in presets], meta


def _meta_pipeline(n: int) -> Pipeline:
    assembler = VectorAssembler(inputCols=[f"score_{i}" for i in range(n)], outputCol="meta")
    return Pipeline(stages=[assembler, LogisticRegression(featuresCol="meta", labelCol="label", maxIter=1000)])


def score_stacking(df: DataFrame, fitted) -> DataFrame:
    models, meta = fitted
    out = meta.transform(_all_scores(df, models))
    return out.select(*df.columns, probability().alias("score"), F.col("prediction").cast("int").alias("pred"))


def draw_trials(preset: str = "primary", trials: int = 50, seed: int = SEED, space: dict | None = None) -> list[dict]:
    """Seeded random parameter sets from the preset's space, or from ``space``; learning rates are log-uniform."""
    rng = random.Random(seed)
    out = []
    for _ in range(trials):
        one = {}
        for name, (low, high, kind) in (space or SPACES[preset]).items():
            if kind == "int":
                one[name] = rng.randint(low, high)
            elif kind == "log":
                one[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                one[name] = rng.uniform(low, high)
        out.append(one)
    return out


def tune(train: DataFrame, validation: DataFrame, features: list[str], preset: str = "primary", trials: int = 50,
         parallelism: int = 2, seed: int = SEED, space: dict | None = None) -> list[tuple[int, dict, float]]:
    """(trial, parameters, validation ROC-AUC) of each random trial, several fitted at a time.

    Every fit uses exactly the parameters drawn for it.
    """
    def run(numbered):
        i, params = numbered
        model = fit_gbt(train, features, preset, **spark_params(params))
        auc = metrics.roc_auc(score_rows(validation, model)).first().roc_auc
        return i, params, float(auc)

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(run, enumerate(draw_trials(preset, trials, seed, space))))


def tuning_history(spark: SparkSession, results: list[tuple[int, dict, float]], baseline: float = BASELINE_AUC) -> DataFrame:
    """One row per trial: parameters, score, whether it is the best, gain over the baseline."""
    rows = [(i, {k: float(v) for k, v in p.items()}, auc) for i, p, auc in results]
    df = spark.createDataFrame(rows, "trial int, params map<string,double>, roc_auc double")
    best = df.agg(F.max_by("trial", F.struct("roc_auc", -F.col("trial"))).alias("_best"))
    return df.join(F.broadcast(best)).select(  # one row per trial
        "trial", "params", "roc_auc", (F.col("trial") == F.col("_best")).alias("best"),
        (F.col("roc_auc") - F.lit(baseline)).alias("gain"))


def best_trial(results: list[tuple[int, dict, float]]) -> dict:
    return max(results, key=lambda r: (r[2], -r[0]))[1]


def importances(model: PipelineModel) -> dict[str, float]:
    """Importance by feature, in training order."""
    return dict(zip(feature_names(model), (float(w) for w in model.stages[-1].featureImportances.toArray())))


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Importance per named feature, largest first."""
    return spark.createDataFrame(list(importances(model).items()), "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)
