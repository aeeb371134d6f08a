"""Evaluation: errors, binary metrics, sweeps, comparisons, agreement of raters, error decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M


def distance_errors(df: DataFrame, pred: str, truth: str, by: list[str] | None = None) -> DataFrame:
    p, t = F.col(pred), F.col(truth)
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), M.mae(p, t).alias("mae"), M.medae(p, t).alias("medae"), M.rmse(p, t).alias("rmse"))


def binary_metrics(df: DataFrame, pred: str, truth: str, operator: str = "operator") -> DataFrame:
    """Confusion counts and scores per operator and overall, in one pass over the rows."""
    cells = df.groupingSets([[], [F.col(operator)]], F.col(operator)).agg(F.grouping(operator).alias("_all"), *M.confusion(F.col(pred), F.col(truth)))
    return cells.withColumn(operator, F.when(F.col("_all") == 1, "overall").otherwise(F.col(operator))).drop("_all").select("*", *M.binary_scores())


def threshold_sweep(df: DataFrame, distance: str, truth: str, taus: dict[str, list[float]], extra: Column | None = None, operator: str = "operator") -> DataFrame:
    """Scores of "distance <= tau" per operator and tau. Distances are computed once; each row meets its operator's short list of taus.

    extra: a further condition for a positive answer, such as a projection that falls on the segment.
    """
    grid = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in taus.items() for x in kv])
    rows = df.withColumn("tau", F.explode(F.try_element_at(grid, F.col(operator))))
    hit = (F.col(distance) <= F.col("tau")) & (F.lit(True) if extra is None else extra)
    cells = rows.withColumn("_pred", F.coalesce(hit, F.lit(False)).cast("int")).groupBy(operator, "tau").agg(*M.confusion(F.col("_pred"), F.col(truth)))
    return cells.select("*", *M.binary_scores())


def compare(df: DataFrame, a: str, b: str, truth: str) -> DataFrame:
    """Errors of two methods on the same rows, and of their difference."""
    ea, eb = F.abs(F.col(a) - F.col(truth)), F.abs(F.col(b) - F.col(truth))
    return df.agg(F.count("*").alias("n"), F.avg(ea).alias("mae_a"), F.avg(eb).alias("mae_b"), F.median(ea).alias("medae_a"), F.median(eb).alias("medae_b"), F.avg(eb - ea).alias("mean_difference"), F.count_if(eb > ea).alias("b_worse"))


def failures(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """Rows whose prediction isn't the truth, missing ones included."""
    return df.where(~M.same(F.col(pred), F.col(truth)))


def errors_by_range(df: DataFrame, pred: str, truth: str, method: str = "method") -> DataFrame:
    """Errors by method and by the range that the true distance falls in; rows without a prediction count as failed only."""
    e = F.abs(F.col(pred) - F.col(truth))
    return (
        df.withColumn("range", M.range_bucket(F.col(truth)))
        .groupBy(method, "range")
        .agg(F.count(pred).alias("n_valid"), F.count_if(F.col(pred).isNull()).alias("n_failed"), F.avg(e).alias("mae"), F.median(e).alias("medae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.try_divide(e, F.col(truth)))).alias("relative_pct"))
    )


def method_summary(df: DataFrame, pred: str, truth: str, method: str = "method") -> DataFrame:
    """Valid and failed predictions and errors by method, one row a method."""
    e = F.abs(F.col(pred) - F.col(truth))
    return df.groupBy(method).agg(F.count("*").alias("n"), F.count(pred).alias("n_valid"), F.count_if(F.col(pred).isNull()).alias("n_failed"), F.avg(e).alias("mae"), F.median(e).alias("medae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def long_votes(df: DataFrame, item: str, raters: list[str]) -> DataFrame:
    """(item, rater, vote), missing votes left out."""
    return df.unpivot([item], raters, "rater", "vote").where("vote IS NOT NULL")


def kappa_pairs(votes: DataFrame, item: str) -> DataFrame:
    """Cohen's kappa of every two raters over the items that both judged."""
    a = votes.select(item, F.col("rater").alias("rater_a"), F.col("vote").alias("va"))
    b = votes.select(item, F.col("rater").alias("rater_b"), F.col("vote").alias("vb"))
    n = a.join(b, item).where("rater_a < rater_b").groupBy("rater_a", "rater_b").agg(F.count("*").alias("n"), F.count_if(F.col("va") == F.col("vb")).alias("agree"), F.sum("va").alias("ones_a"), F.sum("vb").alias("ones_b"))
    return n.select("rater_a", "rater_b", "n", M.kappa(F.col("n"), F.col("agree"), F.col("ones_a"), F.col("ones_b")).alias("kappa"))


def rater_accuracy(votes: DataFrame, truth: DataFrame, item: str) -> DataFrame:
    return votes.join(truth, item).groupBy("rater").agg(F.count("*").alias("n"), M.top1(F.col("vote"), F.col("truth")).alias("accuracy"))


def decompose(df: DataFrame, total: str, geometric: str, truth: str, grounded: str) -> DataFrame:
    """Total error, its geometric part and the rest, due to grounding. Errors skip rows without a distance; grounding accuracy divides by all rows."""
    te, ge = F.abs(F.col(total) - F.col(truth)), F.abs(F.col(geometric) - F.col(truth))
    return df.agg(F.count("*").alias("n"), F.count(total).alias("n_computed"), M.top1(F.col(grounded), F.lit(True)).alias("grounding_accuracy"), F.avg(te).alias("mae_total"), F.avg(ge).alias("mae_geometric"), (F.avg(te) - F.avg(ge)).alias("delta_grounding"))
