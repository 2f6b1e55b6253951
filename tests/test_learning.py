import math
import random

import numpy as np
import pytest
from conftest import stream_rows
from pyspark.sql import functions as F

from telltale import catalog
from telltale.operators import learning as ml, neighbours as nb, scaling as sca
from telltale.plans import prepare, train as training
from telltale.session import scratch_path
from telltale.sources import sinks

SMALL = dict(maxIter=3, maxDepth=2)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for i in range(600):
        y = int(rng.random() < 0.25)
        data.append((i, y, rng.gauss(30 + 30 * y, 12), rng.gauss(20 + 5 * y, 9), float(i % 5)))
    df = spark.createDataFrame(data, "seq long, label int, a double, b double, c double").repartition(4)
    return df.where("seq < 400"), df.where("seq >= 400 and seq < 500"), df.where("seq >= 500")


FEATURES = ["a", "b", "c"]


def brute(ids, x, k):
    out = {}
    for i, v in zip(ids, x):
        d = sorted((math.dist(v, w), j) for j, w in zip(ids, x) if j != i)
        out[i] = [j for _, j in d[:k]]
    return out


def test_written_tables_are_read_in_splits(spark):
    table = catalog._once(spark, "many", "splits", lambda: spark.range(4_000_000, numPartitions=1).select("id", F.rand(1).alias("x")))
    parts = [r["count"] for r in table.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert sum(parts) == 4_000_000 and max(parts) <= 2_600_000


@pytest.mark.parametrize("block", [5, 2048])
def test_neighbours_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nb, "BLOCK", block)
    monkeypatch.setattr(nb, "ROWS_PER_LEAF", 12)
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 1, (150, 3)), rng.normal(6, 0.1, (80, 3)), [[50.0, 50.0, 50.0]], [[0.0, 0.0, 0.0]] * 9])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {}
    for r in nb.nearest_neighbours(df, "id", "vec", 5).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == brute(list(range(len(x))), x.tolist(), 5)


def test_neighbours_of_none_and_of_one(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0])], "id long, vec array<double>")
    assert nb.nearest_neighbours(df, "id", "vec").count() == 0 and nb.nearest_neighbours(df.where("false"), "id", "vec").count() == 0


def test_few_pairs_are_compared_on_clustered_data(spark, monkeypatch):
    monkeypatch.setattr(nb, "ROWS_PER_LEAF", 25)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.05, (100, 6)) + c for c in rng.uniform(-10, 10, (30, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    tree = nb.build_tree(df)
    own = nb.in_own_leaf(tree, tree.placed.select("id", "vec", "leaf"), 6)
    size = {r.leaf: r.n for r in tree.leaves.collect()}
    asked = {r.leaf: r["count"] for r in nb.visits(tree, own).groupBy("leaf").count().collect()}
    compared = sum(n * n for n in size.values()) + sum(n * size[leaf] for leaf, n in asked.items())
    assert sum(size.values()) == len(x) and compared < len(x) ** 2 / 10
    got = {}
    for r in nb.nearest_neighbours(df, "id", "vec", 5).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert got == {i: list(np.lexsort((np.arange(len(x)), row))[:5]) for i, row in enumerate(d)}


def test_queries_are_sent_to_bundles_not_to_leaves(spark, monkeypatch):
    """Far fewer vectors are shuffled than there are pairs of a query and a leaf that it reaches."""
    monkeypatch.setattr(nb, "ROWS_PER_LEAF", 10)
    sent, past = [], nb._past
    monkeypatch.setattr(nb, "_past", lambda held, passing, *rest: sent.append(passing.count()) or past(held, passing, *rest))
    x, big = np.random.default_rng(7).normal(size=(800, 24)), 2 ** 60  # ids that a double can't hold
    df = spark.createDataFrame([(big + i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {}
    for r in nb.nearest_neighbours(df, "id", "vec", 5).orderBy("id", "rank").collect():
        got.setdefault(r.id - big, []).append(r.neighbour - big)
    assert got == brute(list(range(len(x))), x.tolist(), 5) and max(sent) <= 8 * len(x)


def test_smote_fills_the_minority_between_neighbours(spark, rows):
    train = rows[0]
    out = nb.smote_oversample(train, ["a", "b"])
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[0] == counts[1]
    few = {r.seq: (r.a, r.b) for r in train.where("label = 1").collect()}
    near = brute(list(few), list(few.values()), 5)
    for r in out.where("synthetic = 1").collect():
        base = few[r.seq]
        ok = False
        for other in near[r.seq]:
            o = few[other]
            u = (r.a - base[0]) / (o[0] - base[0])
            ok |= -1e-9 <= u <= 1 and math.isclose(r.b, base[1] + u * (o[1] - base[1]), abs_tol=1e-6)
        assert ok
    again = nb.smote_oversample(train.repartition(3), ["a", "b"])
    assert out.exceptAll(again).count() == 0


def test_robust_scaler(spark, rows):
    fitted = sca.fit_robust_scaler(rows[0].withColumn("k", F.lit(3.0)), ["a", "k"])
    x = np.array([r.a for r in rows[0].collect()])
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    assert fitted["a"] == pytest.approx((q2, q3 - q1)) and fitted["k"] == (3.0, 1.0)


def test_quartiles_of_many_columns_without_moving_rows(spark):
    rng = np.random.default_rng(2)
    x = {"normal": rng.normal(0, 5, 999), "heavy": rng.exponential(1, 999) ** 9 * rng.choice([-1, 1], 999), "few": rng.integers(0, 3, 999) * 1.0,
         "tiny": rng.random(999) * 1e-300, "zeros": rng.choice([0.0, -0.0], 999), "wide": 10.0 ** rng.uniform(-300, 300, 999)}
    rows = [tuple(None if (i + j) % 5 == 0 else float(v[i]) for j, v in enumerate(x.values())) for i in range(999)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in x) + "").withColumn("none", F.lit(None).cast("double"))
    got = {r.feature: (r.q25, r.q50, r.q75) for r in sca.column_quartiles(df.repartition(5), df.columns).collect()}
    want = {c: tuple(df.agg(*[F.percentile(c, F.lit(q)) for q in (0.25, 0.5, 0.75)]).first()) for c in x}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], rel=1e-12) for c in x)
    assert sca.column_quartiles(df.where("false"), df.columns).count() == 0


def test_train_compare_save_and_load(spark, rows):
    train, validation, test = rows
    models, results = training.compare_models(train, test, FEATURES, **SMALL)
    table = {r.model: r for r in results.collect()}
    assert set(table) == {"primary", "secondary", "voting"} and all(r.roc_auc > 0.8 for r in table.values())
    path = scratch_path(spark, "best")
    best = training.keep_best(models, results, path)
    assert best == max(table, key=lambda m: (table[m].roc_auc, m))
    model = ml.fit_gbt(train, FEATURES, **SMALL)
    again = sinks.load_model(sinks.save_model(model, scratch_path(spark, "m")))
    assert ml.feature_names(again) == FEATURES
    assert ml.score_rows(test, model).exceptAll(ml.score_rows(test, again)).count() == 0
    missing = ml.score_rows(test.drop("c"), model)
    assert missing.exceptAll(ml.score_rows(test.withColumn("c", F.lit(0.0)).drop("c"), model)).count() == 0
    weights = ml.feature_importance(spark, model).collect()
    assert weights[0].feature == "a" and sum(w.importance for w in weights) == pytest.approx(1.0)


def test_tuning(spark, rows):
    space = {**ml.SPACES["primary"], "n_estimators": (2, 3, "int"), "max_depth": (2, 3, "int")}
    results, model, scored = training.tune_and_refit(*rows, FEATURES, trials=2, space=space)
    best = ml.spark_params(ml.best_trial(results))
    assert model.stages[1].getOrDefault("maxIter") == best["maxIter"] and model.stages[1].getOrDefault("maxDepth") == best["maxDepth"]
    assert scored.count() == 100 and len(results) == 2
    history = ml.tuning_history(spark, results).collect()
    assert sum(r.best for r in history) == 1 and max(r.roc_auc for r in history) == [r.roc_auc for r in history if r.best][0]
    assert ml.draw_trials(trials=3) == ml.draw_trials(trials=3)
    for one in ml.draw_trials("secondary", 20):
        assert 0.01 <= one["learning_rate"] <= 0.1 and 31 <= one["num_leaves"] <= 127


def test_early_stop(spark, rows):
    assert ml.best_round([5.0, 4.0, 4.5, 4.6, 1.0], patience=2) == 2
    assert ml.best_round([5.0, 4.0, 4.5, 4.6, 1.0], patience=5) == 5
    model, rounds = ml.early_stop(rows[0], rows[1], FEATURES, patience=1, **SMALL)
    assert 1 <= rounds <= 3 and model.stages[1].getNumTrees == rounds


def test_first_trees_are_the_fit_of_as_many_rounds(spark, rows):
    train, validation, test = rows
    long, short = (ml.fit_gbt(train, FEATURES, maxIter=n, maxDepth=3) for n in (6, 2))
    cut = ml.PipelineModel([long.stages[0], ml.first_trees(long.stages[1], 2)])
    assert ml.score_rows(test, cut).exceptAll(ml.score_rows(test, short)).count() == 0
    ready = long.stages[0].transform(validation.withColumn("weight", F.lit(1.0)))
    losses = long.stages[1].evaluateEachIteration(ready)
    assert cut.stages[1].evaluateEachIteration(ready) == losses[:2] == short.stages[1].evaluateEachIteration(ready)
    again = sinks.load_model(sinks.save_model(cut, scratch_path(spark, "cut")))
    assert ml.score_rows(test, again).exceptAll(ml.score_rows(test, short)).count() == 0 and again.stages[1].getNumTrees == 2
    stopped = ml.fit_gbt(train, FEATURES, validation=validation, patience=2, maxIter=6, maxDepth=3)
    assert stopped.stages[1].getNumTrees == ml.best_round(losses, 2)
    assert len(ml.fit_voting(train, FEATURES, validation=validation, patience=1, maxIter=2, maxDepth=2)) == 3


def test_mlp_and_stacking(spark, rows):
    train, _, test = rows
    scored = ml.score_mlp(test, ml.fit_mlp(train, FEATURES, hidden=(8, 4), max_iter=15))
    assert scored.count() == 100 and scored.where("score < 0 or score > 1").count() == 0
    stacked = ml.score_stacking(test, ml.fit_stacking(train, FEATURES, maxIter=1, maxDepth=2))
    assert stacked.count() == 100 and set(stacked.columns) >= {"score", "pred", "seq"}


def test_training_run_keeps_the_best_model(spark):
    rng = np.random.default_rng(11)
    p = stream_rows(spark, [{"pid": int(q), "seq": i, "t": i, "cpu": float(rng.gamma(1, 20)), "mem": float(rng.gamma(1, 9))}
                            for i, q in enumerate(rng.integers(1, 8, 400))])
    dataset = prepare.engineer(p).withColumn("label", (F.col("cpu") + F.col("mem_mean_5") > 30).cast("int"))
    path = scratch_path(spark, "flow")
    table = training.train_and_keep(dataset, path, ["cpu", "mem", "mem_mean_5", "cpu_max_3", "cpu_pct_rank", "cpu_dev_from_avg"],
                                    patience=2, maxIter=5, maxDepth=3).collect()
    assert {r.model for r in table} == {"primary", "secondary", "voting"} and all(r.roc_auc > 0.8 for r in table)
    assert [r.model for r in table if r.kept] == [max(table, key=lambda r: (r.roc_auc, r.model)).model]
    assert all(1 <= r.trees <= (15 if r.model == "voting" else 5) and r.tp + r.tn + r.fp + r.fn == 100 for r in table)
    assert sinks.load_model(f"{path}/model-0").stages[1].getNumTrees <= 5


def test_only_near_pairs_are_compared_one_by_one(monkeypatch):
    """Distances and ties as by direct differences of all pairs, which are not made."""
    import numpy as np
    import pandas as pd
    from telltale.operators import neighbours as nb
    rng = np.random.default_rng(5)
    for vectors in (rng.normal(size=(3000, 16)), rng.integers(0, 4, (3000, 3)).astype(float), 1e9 + rng.integers(0, 50, (3000, 2))):
        asked, ids = vectors[::10], rng.permutation(3000)
        d = nb._distances(asked, vectors)
        order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :6]
        with monkeypatch.context() as m:
            m.setattr(nb, "_distances", None)
            best = None
            for part in (slice(0, 1000), slice(1000, 3000)):
                best = nb._merge(asked, best, pd.DataFrame({"id": ids[part], "vec": list(vectors[part])}), 6)
        assert (best[0] == np.take_along_axis(d, order, 1)).all() and (best[1] == ids[order]).all()


# ---- the registered queries fit what the library stores or draws, whole ----

@pytest.fixture
def fits(monkeypatch):
    """(preset, parameters, patience) of every boosted fit that was asked for; one round of one split is fitted."""
    asked, fit = [], ml.fit_gbt

    def small(train, features, preset="primary", validation=None, patience=ml.PATIENCE, **overrides):
        asked.append((preset, {**ml.PRESETS[preset], **overrides}, patience))
        return fit(train, features, preset, validation, patience, **{**overrides, "maxIter": 1, "maxDepth": 1})

    monkeypatch.setattr(ml, "fit_gbt", small)
    monkeypatch.setattr(catalog, "_MODELS", {})
    return asked


def _whole(*presets):
    return [(p, ml.PRESETS[p], 50) for p in presets]


@pytest.mark.parametrize("name, preset", [("gbt_primary", "primary"), ("gbt_secondary", "secondary"), ("gbt_plain", "plain"),
                                          ("feature_importance", "primary")])
def test_boosted_queries_fit_whole_presets(spark, sf, fits, name, preset):
    assert catalog.QUERIES[name](spark, sf).count() and fits == _whole(preset)


def test_live_alerts_come_from_the_whole_preset(spark, sf, fits, monkeypatch):
    class Stored(Exception):
        pass

    def stop(*_, **__):
        raise Stored

    monkeypatch.setattr(catalog, "_DETECTORS", {})
    monkeypatch.setattr(catalog.live, "stored_model_detector", stop)
    with pytest.raises(Stored):
        catalog.QUERIES["live_model_alerts"](spark, sf)
    assert fits == _whole("primary")


def test_early_stop_query_fits_the_whole_preset(spark, sf, fits):
    assert catalog.QUERIES["early_stop"](spark, sf).count() and fits == _whole("primary")


def test_network_query_fits_the_whole_network(spark, sf, monkeypatch):
    made, net = [], ml.MultilayerPerceptronClassifier
    monkeypatch.setattr(ml, "MultilayerPerceptronClassifier", lambda **p: made.append(p) or net(**{**p, "maxIter": 1}))
    monkeypatch.setattr(catalog, "_MODELS", {})
    assert catalog.QUERIES["mlp"](spark, sf).count()
    assert [(p["maxIter"], p["layers"][1:]) for p in made] == [(300, [128, 64, 32, 2])]


def test_stacking_query_fits_whole_presets(spark, sf, fits):
    assert catalog.QUERIES["stacking"](spark, sf).count()
    assert fits == 4 * _whole("stacking_primary", "stacking_secondary", "stacking_plain")


def test_tuned_query_fits_the_stored_parameters(spark, sf, fits):
    assert catalog.QUERIES["train_tuned"](spark, sf).count()
    assert [p for _, p, _ in fits] == [{**ml.PRESETS["primary"], **ml.spark_params(ml.TUNED)}] and fits[0][1]["maxIter"] == 731


def test_training_flow_query_fits_whole_presets(spark, sf, fits):
    assert catalog.QUERIES["training_flow"](spark, sf).count() == 3
    assert fits == _whole("primary", "secondary", "voting_primary", "voting_secondary", "voting_plain")


def test_tuning_queries_try_the_whole_space(spark, sf, fits, monkeypatch):
    drawn, draw = [], ml.draw_trials

    def two(*args):
        drawn.append(draw(*args))
        return drawn[0][:2]

    monkeypatch.setattr(ml, "draw_trials", two)
    assert catalog.QUERIES["tune"](spark, sf).count() and catalog.QUERIES["tuning_history"](spark, sf).count() == 2
    assert drawn == [draw("primary", 50)] and 300 <= min(p["n_estimators"] for p in drawn[0]) and 12 == max(p["max_depth"] for p in drawn[0])
    rounds = [p["n_estimators"] for p in drawn[0][:2]]
    assert sorted(p["maxIter"] for _, p, _ in fits[:2]) == sorted(rounds) and fits[2][1]["maxIter"] in rounds


def test_voting_query_fits_whole_presets(spark, sf, fits):
    assert catalog.QUERIES["voting_soft"](spark, sf).count()
    assert fits == _whole("voting_primary", "voting_secondary", "voting_plain")
