"""Confusion and ranking metrics over ``label``, ``pred`` and ``score`` columns.

``by`` evaluates several models or sessions in one pass. Ranking metrics first count per distinct
score; scores above the block limit are walked in blocks, never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.functions.scalars import ratio
from telltale.operators.blocks import Series

COMPARED = ("roc_auc", "avg_precision", "f1", "mcc")
TABLE = ("roc_auc", "avg_precision", "f1", "mcc", "fpr", "fnr")
LOWER_IS_BETTER = ("fpr", "fnr")


def confusion_matrix(df: DataFrame, by=()) -> DataFrame:
    hit, called = F.col("label") == 1, F.col("pred") == 1
    return df.groupBy(*by).agg(
        F.count_if(hit & called).alias("tp"), F.count_if(~hit & ~called).alias("tn"),
        F.count_if(~hit & called).alias("fp"), F.count_if(hit & ~called).alias("fn"))


def precision() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def f1() -> Column:
    return ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def mcc() -> Column:
    """Matthews correlation; any empty margin gives 0."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    margins = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return ratio(tp * tn - fp * fn, margins)


def fpr() -> Column:
    return ratio(F.col("fp"), F.col("fp") + F.col("tn"))


def fnr() -> Column:
    return ratio(F.col("fn"), F.col("fn") + F.col("tp"))


def composite_score() -> Column:
    return (F.col("roc_auc") + F.col("avg_precision") + F.col("f1") + (1 + F.col("mcc")) / 2) / 4


def f1_mcc(cm: DataFrame) -> DataFrame:
    return cm.withColumns({"f1": f1(), "mcc": mcc()})


def fpr_fnr(cm: DataFrame) -> DataFrame:
    return cm.withColumns({"fpr": fpr(), "fnr": fnr()})


def precision_recall(cm: DataFrame) -> DataFrame:
    return cm.withColumns({"precision": precision(), "recall": recall()})


def classification_report(cm: DataFrame, by=()) -> DataFrame:
    """Per class precision, recall, f1 and support, then accuracy, macro and weighted means."""
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")

    def scores(tp, fp, fn):
        return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}

    neg = scores(F.col("tn"), F.col("fn"), F.col("fp"))
    pos = scores(F.col("tp"), F.col("fp"), F.col("fn"))
    n_neg, n_pos = F.col("tn") + F.col("fp"), F.col("tp") + F.col("fn")
    accuracy = ratio(F.col("tp") + F.col("tn"), n)

    def line(name, values, support):
        return F.struct(F.lit(name).alias("class"), *[v.alias(k) for k, v in values.items()], support.alias("support"))

    macro = {k: (neg[k] + pos[k]) / 2 for k in neg}
    weighted = {k: ratio(neg[k] * n_neg + pos[k] * n_pos, n) for k in neg}
    lines = F.array(line("normal", neg, n_neg), line("anomaly", pos, n_pos),
                    line("accuracy", {k: accuracy for k in neg}, n),
                    line("macro_avg", macro, n), line("weighted_avg", weighted, n))
    return cm.select(*by, F.inline(lines))


def ranking_frame(df: DataFrame, by=(), score: str = "score") -> DataFrame:
    """Per distinct score, highest first: its positives and negatives, and running totals."""
    group = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    counts = rows.groupBy(*group, F.col(score).alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    s = Series(counts.withColumn("_down", -F.col("score")), group, ("_down",))
    s.running(F.sum, tp=F.col("pos"), fp=F.col("neg")).whole(all_pos=F.sum("pos"), all_neg=F.sum("neg"))
    return s.done().drop("_down") if by else s.done().drop("_down", "_all")


def _auc() -> Column:
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return ratio(area, F.max("all_pos").cast("double") * F.max("all_neg"))


def _average_precision() -> Column:
    return ratio(F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))), F.max("all_pos"))


def roc_auc(df: DataFrame, by=(), score: str = "score") -> DataFrame:
    """Exact area under the ROC curve; ties count half. One class only gives 0."""
    return ranking_frame(df, by, score).groupBy(*by).agg(_auc().alias("roc_auc"))


def average_precision(df: DataFrame, by=(), score: str = "score") -> DataFrame:
    """Sum of recall steps times precision."""
    return ranking_frame(df, by, score).groupBy(*by).agg(_average_precision().alias("avg_precision"))


def roc_points(df: DataFrame, by=(), score: str = "score") -> DataFrame:
    """(fpr, tpr, threshold) at every distinct score, from (0, 0) with no threshold."""
    frame = ranking_frame(df, by, score)
    points = frame.select(*by, ratio(F.col("fp"), F.col("all_neg")).alias("fpr"),
                          ratio(F.col("tp"), F.col("all_pos")).alias("tpr"), F.col("score").alias("threshold"))
    start = frame.groupBy(*by).agg(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                                   F.lit(None).cast("double").alias("threshold"))
    return points.unionByName(start)


def pr_points(df: DataFrame, by=(), score: str = "score") -> DataFrame:
    """(recall, precision, threshold) at every distinct score, to (0, 1), with the base rate."""
    frame = ranking_frame(df, by, score)
    base = F.col("all_pos") / (F.col("all_pos") + F.col("all_neg"))
    points = frame.select(*by, ratio(F.col("tp"), F.col("all_pos")).alias("recall"),
                          ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                          F.col("score").alias("threshold"), base.alias("base_rate"))
    last = frame.groupBy(*by).agg(
        F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(None).cast("double").alias("threshold"),
        (F.max("all_pos") / (F.max("all_pos") + F.max("all_neg"))).alias("base_rate"))
    return points.unionByName(last)


def confusion_percent(df: DataFrame) -> DataFrame:
    """Each cell of the matrix with its share of the actual class and the overall accuracy."""
    cells = df.groupBy(F.col("label").alias("actual"), F.col("pred").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    grid = cells.groupBy("actual").agg(
        *[F.coalesce(F.sum(F.when(F.col("predicted") == p, F.col("n"))), F.lit(0)).alias(f"n{p}") for p in (0, 1)])
    right = grid.agg(F.sum(F.when(F.col("actual") == 1, F.col("n1")).otherwise(F.col("n0"))).alias("_right"),
                     F.sum(F.col("n0") + F.col("n1")).alias("_all"))
    both = grid.select("actual", F.inline(F.array(*[
        F.struct(F.lit(p).alias("predicted"), F.col(f"n{p}").alias("n"),
                 (ratio(F.col(f"n{p}"), F.col("n0") + F.col("n1")) * 100).alias("pct")) for p in (0, 1)])))
    return both.join(F.broadcast(right)).select(  # a one-row table
        "actual", "predicted", "n", "pct", ratio(F.col("_right"), F.col("_all")).alias("accuracy"))


def evaluate(df: DataFrame, by=("model",), score: str = "score") -> DataFrame:
    """One metrics row per model: ranking and confusion metrics and the composite score."""
    ranks = ranking_frame(df, by, score).groupBy(*by).agg(_auc().alias("roc_auc"), _average_precision().alias("avg_precision"))
    cm = fpr_fnr(f1_mcc(confusion_matrix(df, by)))
    return (ranks.join(cm, list(by)).withColumn("composite_score", composite_score())
            .select(*by, *TABLE, "composite_score", "tp", "tn", "fp", "fn"))


def metric_comparison(results: DataFrame) -> DataFrame:
    """Models ranked per metric. ``results`` holds one row per model."""
    long = results.unpivot(["model"], list(COMPARED), "metric", "value")
    w = Window.partitionBy("metric").orderBy(F.col("value").desc())
    return long.withColumn("position", F.rank().over(w))


def performance_table(results: DataFrame) -> DataFrame:
    """4-decimal metrics, each flagged when it is the best of its column."""
    small = results.select("model", *[F.round(c, 4).alias(c) for c in TABLE])
    best = small.agg(*[(F.min(c) if c in LOWER_IS_BETTER else F.max(c)).alias(f"_{c}") for c in TABLE])
    return small.join(F.broadcast(best)).select(  # a one-row table
        "model", *TABLE, *[(F.col(c) == F.col(f"_{c}")).cast("int").alias(f"best_{c}") for c in TABLE])


def rank_models(results: DataFrame) -> DataFrame:
    """Models by ROC-AUC, best first; ties go to the first name."""
    w = Window.orderBy(F.col("roc_auc").desc(), "model")  # one row per model
    return results.withColumn("position", F.row_number().over(w))


def select_best_model(results: DataFrame) -> DataFrame:
    return results.orderBy(F.col("roc_auc").desc(), "model").limit(1)
