"""The nearest point of another cloud for every point of a cloud."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Point pairs of two clouds that are all looked at.
SMALL = 1 << 12

#: Points in a batch of rows that a task gives back, about.
BLOCK_POINTS = 1 << 16


def leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Positions of the points in groups of at most ``size``, halved along the widest side again and again."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(np.sort(at))
            continue
        mine = points[at]
        k, half = int(np.argmax(mine.max(axis=0) - mine.min(axis=0))), len(at) // 2
        order = np.argpartition(mine[:, k], half)
        todo += [at[order[:half]], at[order[half:]]]
    return out


def nearest_points(u: np.ndarray, v: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """For each row of u the position of the nearest row of v (the first of equal ones) and the squared distance.

    Two small clouds meet in one go. Else v is cut into about sqrt(len(v)) leaves. A row of u visits leaves in order of the distance to their boxes and stops when the
    next box is further than the nearest point so far, so it meets a few leaves and not all points.
    """
    if len(u) * len(v) <= SMALL:
        d = [np.subtract.outer(u[:, k], v[:, k]) for k in range(3)]
        d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        at = d2.argmin(axis=1)
        return at, d2[np.arange(len(u)), at]
    groups = leaves(v, max(8, int(len(v) ** 0.5)))
    low, high = np.array([v[g].min(axis=0) for g in groups]), np.array([v[g].max(axis=0) for g in groups])
    width = max(map(len, groups))
    member = np.array([np.pad(g, (0, width - len(g)), mode="edge") for g in groups])
    best, where = np.full(len(u), np.inf), np.zeros(len(u), np.int64)
    for at in range(0, len(u), block):
        some = u[at : at + block]
        gap = np.maximum(0, np.maximum(low[None] - some[:, None], some[:, None] - high[None]))
        bound = gap[..., 0] ** 2 + gap[..., 1] ** 2 + gap[..., 2] ** 2
        order = np.argsort(bound, axis=1, kind="stable")
        active = np.arange(len(some))
        for step in range(len(groups)):
            leaf = order[active, step]
            active_bound = bound[active, leaf]
            # a box as far as the best point may still hold an earlier point of that distance; rounding is allowed for
            go = active_bound * (1 - 1e-12) <= best[at + active]
            active, leaf = active[go], leaf[go]
            if not len(active):
                break
            mine = member[leaf]
            d = v[mine] - some[active][:, None]
            d2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
            near = d2.min(axis=1)
            first = np.where(d2 == near[:, None], mine, len(v)).min(axis=1)
            rows = at + active
            better = (near < best[rows]) | ((near == best[rows]) & (first < where[rows]))
            best[rows], where[rows] = np.where(better, near, best[rows]), np.where(better, first, where[rows])
    return where, best


def packed(points: DataFrame) -> DataFrame:
    """object_id, pt (point numbers) and xyz (three numbers a point, one after another): the points in order of pt_idx, one row an object.

    Plain numbers, so that a task reads them as they lie in Arrow's memory and makes no Python object a point.
    """
    p = points.select("object_id", "pt_idx", *[F.col(k).cast("double").alias(k) for k in "xyz"])
    cloud = p.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("pt_idx", "x", "y", "z"))).alias("cloud"))
    flat = F.flatten(F.transform("cloud", lambda q: F.array(q["x"], q["y"], q["z"])))
    return cloud.select("object_id", F.col("cloud.pt_idx").cast("array<int>").alias("pt"), flat.alias("xyz"))


def xyz(cloud) -> np.ndarray:
    return np.array([(p["x"], p["y"], p["z"]) for p in cloud])


def paired(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Distinct pairs (object_a, object_b) with both clouds (pt_a, xyz_a, pt_b, xyz_b; see packed), by two joins on the object; pairs with an empty cloud fall out."""
    cloud = packed(points)
    named = lambda s: cloud.select(*[F.col(c).alias(c.replace("object_id", "object") + f"_{s}") for c in cloud.columns])
    both = pairs.select("object_a", "object_b").distinct().join(named("a"), "object_a").join(named("b"), "object_b")
    return both.select("object_a", "object_b", "pt_a", "xyz_a", "pt_b", "xyz_b")


def clouds_of(batch: pa.RecordBatch, side: str) -> tuple[np.ndarray, np.ndarray]:
    """All points of the side's clouds, a row a point, and where each row's cloud begins (and the last one ends); no copy is made."""
    lists = batch.column(f"xyz_{side}")
    if lists.values.null_count:
        raise ValueError("a point lacks x, y or z")
    return lists.values.to_numpy().reshape(-1, 3), lists.offsets.to_numpy() // 3


def point_neighbours(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """object_a, object_b, pt_a, pt_b, d2: for each pair and each point of a its nearest point of b (the smallest pt_idx of equal ones) and the squared distance.

    points(object_id, pt_idx, x, y, z). A task has the two clouds of a pair and finds neighbours by leaves of b (see nearest_points).
    Rows leave it in batches of about BLOCK_POINTS points, so what it holds beside Arrow's batch doesn't grow with the number of pairs.
    """

    def rows(x: pa.RecordBatch, first: int, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        of = pa.array(np.repeat(np.arange(first, first + len(found)), [len(at) for at, _ in found]))
        a, b = (x.column(f"pt_{s}") for s in "ab")
        starts = b.offsets.to_numpy()[first : first + len(found)]
        mine = a.slice(first, len(found)).flatten()
        near = b.values.take(pa.array(np.concatenate([at + s for (at, _), s in zip(found, starts, strict=True)])))
        return pa.RecordBatch.from_arrays([x.column("object_a").take(of), x.column("object_b").take(of), mine, near, pa.array(np.concatenate([d for _, d in found]))], ["object_a", "object_b", "pt_a", "pt_b", "d2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            (u, i), (v, j) = clouds_of(x, "a"), clouds_of(x, "b")
            first, found, size = 0, [], 0
            for n in range(x.num_rows):
                found.append(nearest_points(u[i[n] : i[n + 1]], v[j[n] : j[n + 1]]))
                size += len(found[-1][0])
                if size >= BLOCK_POINTS or n == x.num_rows - 1:
                    yield rows(x, first, found)
                    first, found, size = n + 1, [], 0

    return paired(pairs, points).mapInArrow(run, "object_a string, object_b string, pt_a int, pt_b int, d2 double")
