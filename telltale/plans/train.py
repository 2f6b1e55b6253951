"""Train, compare and keep the best model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.operators import learning as ml
from telltale.operators.metrics import evaluate, select_best_model
from telltale.operators.neighbours import smote_oversample
from telltale.operators.sampling import stratified_split, validation_split
from telltale.plans.prepare import training_features
from telltale.session import materialized
from telltale.sources.sinks import save_model, sink_results


def test_scores(test: DataFrame, model, name: str) -> DataFrame:
    return ml.score_rows(test, model).select(F.lit(name).alias("model"), "seq", "label", "score", "pred")


def train_tuned(train: DataFrame, test: DataFrame, features: list[str], tuned: dict = ml.TUNED, preset: str = "primary",
                name: str = "tuned"):
    """Fit with exactly the stored parameters: (model, scored test rows)."""
    model = ml.fit_gbt(train, features, preset, **ml.spark_params(tuned))
    return model, test_scores(test, model, name)


def compare_models(train: DataFrame, test: DataFrame, features: list[str], use_smote: bool = False, **overrides):
    """Fit the two boosted presets and the voting ensemble: (models, one metrics row each)."""
    if use_smote:
        train = smote_oversample(train, features)
    models = {p: ml.fit_gbt(train, features, p, **overrides) for p in ("primary", "secondary")}
    scored = [test_scores(test, m, p) for p, m in models.items()]
    voters = ml.fit_voting(train, features, **overrides)
    scored.append(ml.voting_soft(test, voters).select(F.lit("voting").alias("model"), "seq", "label", "score", "pred"))
    rows = scored[0]
    for s in scored[1:]:
        rows = rows.unionByName(s)
    return {**models, "voting": voters}, evaluate(rows)


def keep_best(models: dict, results: DataFrame, path: str) -> str:
    """Save the model with the highest ROC-AUC and all results; returns its name."""
    best = select_best_model(results).first().model
    chosen = models[best]
    for i, m in enumerate(chosen if isinstance(chosen, list) else [chosen]):
        save_model(m, f"{path}/model-{i}")
    sink_results(results, f"{path}/results")
    return best


def train_and_keep(dataset: DataFrame, path: str, features: list[str], patience: int = ml.PATIENCE, **overrides) -> DataFrame:
    """From a prepared dataset to a stored model: extra features, split, fits that stop early on validation rows cut
    from the training ones, metrics on the test rows, and the best model saved under ``path``. One row per model."""
    rows = materialized(training_features(dataset), "training")
    cut = materialized(stratified_split(rows), "split")
    inner = materialized(validation_split(cut.where("split = 'train'")), "inner")
    models, results = compare_models(inner.where("split = 'train'"), cut.where("split = 'test'"), features,
                                     validation=inner.where("split = 'validation'"), patience=patience, **overrides)
    results = materialized(results, "compared")
    best = keep_best(models, results, path)
    trees = {name: [m.stages[-1].getNumTrees for m in (fitted if isinstance(fitted, list) else [fitted])] for name, fitted in models.items()}
    rounds = F.create_map(*[F.lit(x) for name, n in trees.items() for x in (name, sum(n))])
    return results.withColumns({"trees": rounds[F.col("model")], "kept": F.col("model") == best})


def tune_and_refit(train: DataFrame, validation: DataFrame, test: DataFrame, features: list[str],
                   preset: str = "primary", trials: int = 50, space: dict | None = None):
    """Search on train/validation, refit the best draw on both, score the test rows once."""
    results = ml.tune(train, validation, features, preset, trials, space=space)
    both = train.unionByName(validation)
    model, scored = train_tuned(both, test, features, ml.best_trial(results), preset)
    return results, model, scored
