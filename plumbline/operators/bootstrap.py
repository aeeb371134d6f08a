"""Bootstrap uncertainty of surface distances, and exact bootstrap shares of nearest winners.

Which points a resample holds matters, not how often: a minimum doesn't change with repeats. So a replicate is a set of points, and
its minimum is the least distance over pairs of points that are both in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import clouds_of, paired, point_neighbours
from .objects import downsample

#: Modulus and factor of the random numbers of replicates (fixed values, a well-known full-period pair).
MODULUS, FACTOR = 2_147_483_647, 48_271


@lru_cache(maxsize=8)
def _powers(n: int) -> np.ndarray:
    out, x = np.empty(n, np.int64), 1
    for k in range(n):
        x = out[k] = x * FACTOR % MODULUS
    return out


def draws(seed: int, names: tuple[str, ...], replicate: int, n: int) -> np.ndarray:
    """Random numbers 1 to n of a replicate: number k is start times FACTOR^k modulo MODULUS, and start comes from md5 of seed, names and
    replicate. So each number is a function of its place alone, in any order, on any machine, in SQL as well."""
    start = int(hashlib.md5("|".join([str(seed), *names, str(replicate)]).encode()).hexdigest()[:7], 16) + 1
    return start * _powers(n) % MODULUS


def lows(u: np.ndarray, v: np.ndarray, names: tuple[str, ...], replicates: int, seed: int, nearest: int = 4096, block: int = 64) -> np.ndarray:
    """Least squared distance of the resampled clouds in each replicate. The ``nearest`` closest point pairs are tried in order first: the first
    with both points in the replicate is its minimum. Only a replicate that holds none of them looks at all its pairs."""
    d2 = sum(np.subtract.outer(u[:, k], v[:, k]) ** 2 for k in range(3))
    flat, most = d2.ravel(), min(nearest, d2.size)
    close = np.argpartition(flat, most - 1)[:most]
    close = close[np.argsort(flat[close], kind="stable")]
    i, j = np.divmod(close, len(v))
    out = np.empty(replicates)
    for r0 in range(0, replicates, block):
        x = np.stack([draws(seed, names, r, len(u) + len(v)) for r in range(r0, min(replicates, r0 + block))])
        rows = np.arange(len(x))[:, None]
        in_a, in_b = np.zeros((len(x), len(u)), bool), np.zeros((len(x), len(v)), bool)
        in_a[rows, x[:, : len(u)] % len(u)] = True
        in_b[rows, x[:, len(u) :] % len(v)] = True
        hit = in_a[:, i] & in_b[:, j]
        first = hit.argmax(axis=1)
        found = flat[close[first]]
        for k in np.flatnonzero(~hit[np.arange(len(x)), first]):
            found[k] = d2[np.ix_(in_a[k], in_b[k])].min()
        out[r0 : r0 + len(x)] = found
    return out


def distance_ci(pairs: DataFrame, points: DataFrame, replicates: int = 1000, cap: int = 2000, seed: int = 42) -> DataFrame:
    """Per pair(object_a, object_b): point estimate, bootstrap mean, population deviation, 2.5 and 97.5 percentiles, width, width in % of the estimate.

    Clouds are capped at ``cap`` points (see objects.downsample), so a pair's matrix is bounded. A replicate's points are those that ``draws``
    picks: as many as the cloud has, first of a, then of b, in order of pt_idx.
    """
    cloud = downsample(points, ["object_id"], "pt_idx", cap, seed)

    shape = "object_a string, object_b string, point double, mean double, std double, ci_low double, ci_high double, ci_width double, ci_width_pct double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out, names = [], [x.column(k).to_pylist() for k in ("object_a", "object_b")]
            (us, starts_a), (vs, starts_b) = clouds_of(x, "a"), clouds_of(x, "b")
            for n, (i, j) in enumerate(zip(*names, strict=True)):
                u, v = us[starts_a[n] : starts_a[n + 1]], vs[starts_b[n] : starts_b[n + 1]]
                low = np.sqrt(lows(u, v, (i, j), replicates, seed))
                a, b = np.percentile(low, [2.5, 97.5])
                point = float(np.sqrt(sum(np.subtract.outer(u[:, k], v[:, k]) ** 2 for k in range(3)).min()))
                out.append((point, float(np.mean(low)), float(np.std(low)), a, b, b - a, (b - a) / point * 100 if point else None))
            figures = [pa.array(c, pa.float64()) for c in zip(*out, strict=True)] or [pa.array([], pa.float64())] * 7
            yield pa.RecordBatch.from_arrays([x.column("object_a"), x.column("object_b"), *figures], ["object_a", "object_b", "point", "mean", "std", "ci_low", "ci_high", "ci_width", "ci_width_pct"])

    return paired(pairs, cloud).mapInArrow(run, shape)


def winner_shares(candidates: DataFrame, points: DataFrame, cap: int = 2000, seed: int = 42) -> DataFrame:
    """Per question (object_a, label_b) and candidate (object_b, ord_b): the share of all resamples of the reference's cloud that it wins, and ``first``: whether it wins with the cloud itself.

    Exact, without replicates. Let the reference have n points, in order of their least distance to any candidate. The
    candidate nearest to the first point drawn wins, and the i-th point is the first one drawn with probability
    ((n - i + 1) / n)^n - ((n - i) / n)^n; a candidate's share is the sum over the points it is nearest to. Equal distances go to the
    first candidate in enumeration order.
    """
    each = candidates.select("object_a", "label_b", "object_b", "ord_b").distinct()
    near = point_neighbours(each, downsample(points, ["object_id"], "pt_idx", cap, seed)).select("object_a", "object_b", "pt_a", "d2")
    question = ["object_a", "label_b"]
    least = each.join(near, ["object_a", "object_b"]).groupBy(*question, "pt_a").agg(F.min(F.struct("d2", "ord_b", "object_b")).alias("m"))
    placed = least.withColumns({"i": F.row_number().over(Window.partitionBy(*question).orderBy("m.d2", "m.ord_b", "pt_a")), "n": F.count("*").over(Window.partitionBy(*question)).cast("double")})
    chance = F.pow((F.col("n") - F.col("i") + 1) / F.col("n"), "n") - F.pow((F.col("n") - F.col("i")) / F.col("n"), "n")
    share = placed.groupBy(*question, F.col("m.object_b").alias("object_b")).agg(F.round(F.sum(chance), 12).alias("share"), (F.min("i") == 1).alias("first"))
    return each.join(share, [*question, "object_b"], "left").na.fill({"share": 0.0, "first": False})


def nearest_stability(candidates: DataFrame, points: DataFrame, answers: DataFrame | None = None, cap: int = 2000, seed: int = 42) -> DataFrame:
    """Per question (object_a, label_b): n_candidates, point_winner (with the clouds as they are), gt_winner (the given answer), gt_correct_point
    (whether they agree), gt_stability (the share of resamples that the given answer wins), boot_winner (of the largest share, the first of
    equal ones) and boot_winner_stability (its share).

    answers(object_a, label_b, gt_winner): one row a question at most. A question without an answer has a null gt_winner, which is
    never right and wins no resample; so does an answer that is no candidate.
    """
    shares = winner_shares(candidates, points, cap, seed)
    question = ["object_a", "label_b"]
    none = F.lit(None).cast("string")
    asked = shares.join(answers.select(*question, "gt_winner"), question, "left") if answers is not None else shares.withColumn("gt_winner", none)
    most = F.min(F.struct((-F.col("share")).alias("s"), "ord_b", "object_b"))
    out = asked.groupBy(*question).agg(
        F.count("*").alias("n_candidates"),
        F.max(F.when(F.col("first"), F.col("object_b"))).alias("point_winner"),
        F.max("gt_winner").alias("gt_winner"),
        F.coalesce(F.max(F.when(F.col("object_b") == F.col("gt_winner"), F.col("share"))), F.lit(0.0)).alias("gt_stability"),
        most.alias("m"),
    )
    right = F.coalesce(F.col("point_winner") == F.col("gt_winner"), F.lit(False)).alias("gt_correct_point")
    return out.select(*question, "n_candidates", "point_winner", "gt_winner", right, "gt_stability", F.col("m.object_b").alias("boot_winner"), (-F.col("m.s")).alias("boot_winner_stability"))


def summarise(ci: DataFrame) -> DataFrame:
    return ci.agg(F.count("*").alias("n"), F.avg("ci_width").alias("mean_width"), F.median("ci_width").alias("median_width"), F.max("ci_width").alias("max_width"), F.avg("ci_width_pct").alias("mean_width_pct"))


def summarise_nearest(stability: DataFrame, least: float = 0.95) -> DataFrame:
    """Over all questions with an answer: n, mean, median and least share of the right answer, how many reach ``least``, and how often the point winner is right."""
    s = F.col("gt_stability")
    asked = stability.where(F.col("gt_winner").isNotNull())
    return asked.agg(F.count("*").alias("n"), F.avg(s).alias("mean_stability"), F.median(s).alias("median_stability"), F.min(s).alias("min_stability"), F.count_if(s >= least).alias("n_stable"), F.count_if("gt_correct_point").alias("n_correct"))
