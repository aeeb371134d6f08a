"""Metrics as aggregate expressions. Empty denominators give 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mae(pred: Column, truth: Column) -> Column:
    return F.avg(F.abs(pred - truth))


def medae(pred: Column, truth: Column) -> Column:
    return F.median(F.abs(pred - truth))


def rmse(pred: Column, truth: Column) -> Column:
    return F.sqrt(F.avg((pred - truth) * (pred - truth)))


def same(a: Column, b: Column) -> Column:
    """Equality in which a missing value equals nothing."""
    return F.coalesce(a == b, F.lit(False))


def top1(pred: Column, truth: Column) -> Column:
    return F.avg(same(pred, truth).cast("double"))


def parse_rate(value: Column) -> Column:
    return F.avg(value.isNotNull().cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(pred: Column, truth: Column) -> list[Column]:
    """n, tp, tn, fp, fn of 0/1 labels; a missing prediction counts in n only."""
    p = pred
    cells = {"tp": (truth == 1) & (p == 1), "tn": (truth == 0) & (p == 0), "fp": (truth == 0) & (p == 1), "fn": (truth == 1) & (p == 0)}
    return [F.count("*").alias("n"), *[F.count_if(v).alias(k) for k, v in cells.items()]]


def binary_scores() -> list[Column]:
    """accuracy, precision, recall, f1 from the columns of ``confusion``; a row without a prediction is not accurate."""
    n, tp, tn, fp, fn = (F.col(k) for k in ("n", "tp", "tn", "fp", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [
        ratio(tp + tn, n).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
    ]


def kappa(n: Column, agree: Column, ones_a: Column, ones_b: Column) -> Column:
    """Cohen's kappa of two binary raters from counts; 1 where chance agreement is certain, null without items."""
    po, pa, pb = (F.try_divide(v.cast("double"), n) for v in (agree, ones_a, ones_b))
    pe = pa * pb + (1 - pa) * (1 - pb)
    return F.when(n > 0, F.when(pe >= 1, F.lit(1.0)).otherwise(F.try_divide(po - pe, 1 - pe)))


def majority(votes: list[Column]) -> Column:
    """1 if more than half of the given votes are 1, 0 on ties and otherwise, -1 without votes."""
    given = F.filter(F.array(*votes), lambda v: v.isNotNull())
    ones = F.aggregate(given, F.lit(0), lambda a, v: a + v.cast("int"))
    return F.when(F.size(given) == 0, -1).when(ones * 2 > F.size(given), 1).otherwise(0)


def range_bucket(d: Column, short: float = 1.5, medium: float = 3.0) -> Column:
    return F.when(d <= short, "short").when(d <= medium, "medium").when(d.isNotNull(), "long")
