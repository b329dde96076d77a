"""Weights, ROC curves, thresholds and scores of classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.select import running


def balanced_weights(rows: DataFrame, group: str = "dataset") -> DataFrame:
    """Adds weight = rows / (groups * rows of the group), so that groups weigh alike and weights sum to the rows."""
    per = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    total = per.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__groups"))
    per = per.join(F.broadcast(total))
    return rows.join(F.broadcast(per), group).withColumn("weight", F.col("__all") / (F.col("__groups") * F.col("__n"))).drop("__n", "__all", "__groups")


def _steps(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold) for every distinct score with pos and neg, its rows of either class, and their running sums from the
    highest score down, sums of the group, and numbers at the next lower score."""
    per = scores.groupBy(*by, F.col("score").alias("threshold")).agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count(F.lit(1)).alias("all"))
    per = per.select(*by, "threshold", "pos", (F.col("all") - F.col("pos")).alias("neg"))
    return running(per, by, "threshold", ["pos", "neg"])


def cumulative(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, threshold, tp, fp, p, n): true and false positives at every score from the highest down.
    Rows are first combined by score, and no task holds all scores of a group."""
    by = by or []
    return _steps(scores, by).select(*by, "threshold", F.col("run_pos").alias("tp"), F.col("run_neg").alias("fp"), F.col("all_pos").alias("p"), F.col("all_neg").alias("n"))


def roc_points(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, threshold, fpr, tpr): the curve's corners from an infinite threshold down; points within a
    straight piece (equal steps on both sides) are left out."""
    by = by or []
    rows = _steps(scores, by)
    # The step to a score is its own rows, that from it the rows of the next; ends have one of them.
    first = (F.col("run_pos") == F.col("pos")) & (F.col("run_neg") == F.col("neg"))
    straight = ~first & (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
    rows = rows.filter(~F.coalesce(straight, F.lit(False)))
    zero = rows.filter(first).select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("run_neg"), F.lit(0).cast("long").alias("run_pos"), "all_neg", "all_pos")
    rows = zero.unionByName(rows.select(*by, F.col("threshold").cast("double").alias("threshold"), "run_neg", "run_pos", "all_neg", "all_pos"))
    return rows.select(*by, "threshold", F.try_divide("run_neg", "all_neg").alias("fpr"), F.try_divide("run_pos", "all_pos").alias("tpr"))


def _best(rows: DataFrame, by: list[str], *order) -> DataFrame:
    """Of each group the row that is largest by *order*, column after column."""
    best = rows.groupBy(*by).agg(F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[c for c in rows.columns if c not in by]).alias("row"))).alias("best"))
    return best.select(*by, "best.row.*")


def max_j(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, threshold, j): the highest threshold of largest sensitivity + specificity - 1."""
    by = by or []
    rows = roc_points(scores, by).withColumn("j", F.col("tpr") - F.col("fpr"))
    return _best(rows, by, F.col("j"), F.col("threshold")).select(*by, "threshold", "j")


def high_specificity(scores: DataFrame, by: list[str] | None = None, target: float = 0.95) -> DataFrame:
    """(by, threshold, sensitivity, specificity): of thresholds with specificity of *target* or more the
    most sensitive; without any, the most specific. Of equals the highest."""
    by = by or []
    rows = roc_points(scores, by).select(*by, "threshold", F.col("tpr").alias("sensitivity"), (1 - F.col("fpr")).alias("specificity"))
    ok = F.col("specificity") >= target
    key = F.when(ok, F.col("sensitivity")).otherwise(F.col("specificity"))
    return _best(rows, by, ok.cast("int"), key, F.col("threshold"))


def confusion(scores: DataFrame, threshold, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of score >= threshold against y; rates without cases are 0, NPV is NULL."""
    by = by or []
    hit, y = F.col("score") >= threshold, F.col("y") == 1
    n = scores.groupBy(*by).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    sens, spec, ppv = rate(tp, tp + fn), rate(tn, tn + fp), rate(tp, tp + fp)
    return n.withColumns(
        {"accuracy": rate(tp + tn, tp + fp + tn + fn), "balanced_accuracy": (sens + spec) / 2, "f1": rate(2 * tp, 2 * tp + fp + fn),
         "sensitivity": sens, "specificity": spec, "ppv": ppv, "npv": F.try_divide(tn, tn + fn)}
    )


def auc(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, auc, n_samples): share of pairs of a positive and a negative in order, ties counting half; NULL with one class."""
    by = by or []
    rows = _steps(scores, by).withColumn("area", F.col("neg") * (2 * F.col("run_pos") - F.col("pos")) / 2)
    p, n = F.max("all_pos"), F.max("all_neg")
    return rows.groupBy(*by).agg(F.try_divide(F.sum("area"), p * n).alias("auc"), (p + n).alias("n_samples"))


def mean_auc(aucs: DataFrame) -> DataFrame:
    """One row: mean, and mean weighted by samples."""
    return aucs.agg(F.avg("auc").alias("mean_auc"), F.try_divide(F.sum(F.col("auc") * F.col("n_samples")), F.sum("n_samples")).alias("weighted_mean_auc"))


def fold_scores(folds: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """(by, mean_score, se): mean, and population deviation over the root of the number of folds."""
    return folds.groupBy(*by).agg(F.avg(score).alias("mean_score"), (F.stddev_pop(score) / F.sqrt(F.count(F.lit(1)))).alias("se"))


def one_se(grid: DataFrame, main: str, other: str, score: str = "mean_score", se: str = "se") -> DataFrame:
    """The simplest row within one standard error of the best: no parameter above the best's, the least
    *main*, then *other*. The best itself always qualifies. Of equal best rows the one of least parameters."""
    best = grid.orderBy(F.desc(score), main, other).limit(1).select(F.col(score).alias("__s"), F.col(se).alias("__e"), F.col(main).alias("__m"), F.col(other).alias("__o"))
    ok = (F.col(score) >= F.col("__s") - F.col("__e")) & (F.col(main) <= F.col("__m")) & (F.col(other) <= F.col("__o"))
    return grid.join(F.broadcast(best)).filter(ok).orderBy(main, other).limit(1).select(main, other, score, se)
