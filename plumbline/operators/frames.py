"""Camera frames: projection of points and boxes, visibility, best window, sampling.

A pose is the rigid camera-to-world matrix as 16 numbers, row by row; its inverse is the transposed rotation, so no matrix is inverted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def to_camera(pose: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """Camera coordinates of a world point."""
    d = [v - pose[4 * i + 3] for i, v in enumerate((x, y, z))]
    return [sum((pose[4 * i + j] * d[i] for i in (1, 2)), pose[j] * d[0]) for j in range(3)]


def project(points: DataFrame, near: float = 1e-6, scale: tuple[float, float] | None = None) -> DataFrame:
    """points(pose, fx, fy, cx, cy, x, y, z, ...) plus u, v (null at or before the near plane) and depth.

    scale: factors from camera to output pixels; u and v are then whole numbers, cut toward zero.
    """
    cam = to_camera(F.col("pose"), F.col("x"), F.col("y"), F.col("z"))
    out = points.withColumns({"_cx": cam[0], "_cy": cam[1], "depth": cam[2]})
    seen = F.col("depth") > near
    u = F.col("fx") * F.try_divide(F.col("_cx"), F.col("depth")) + F.col("cx")
    v = F.col("fy") * F.try_divide(F.col("_cy"), F.col("depth")) + F.col("cy")
    if scale:
        u, v = (u * scale[0]).cast("int"), (v * scale[1]).cast("int")
    return out.withColumns({"u": F.when(seen, u), "v": F.when(seen, v)}).drop("_cx", "_cy")


def look_at(points: DataFrame, position: tuple, target: tuple, up: tuple, fov_deg: float, width: int, height: int, near: float = 1e-6) -> DataFrame:
    """points(x, y, z) plus u, v and depth seen from a position towards a target."""
    import math

    sub, dot = lambda a, b: [p - q for p, q in zip(a, b, strict=True)], lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    unit = lambda a: [p / math.sqrt(dot(a, a)) for p in a]
    forward = unit(sub(target, position))
    right = unit(cross(forward, up))
    top = cross(right, forward)
    along = lambda axis: sum(((F.col(k) - p) * a for k, p, a in list(zip("xyz", position, axis, strict=True))[1:]), (F.col("x") - position[0]) * axis[0])
    focal = 0.5 * height / math.tan(math.radians(fov_deg) / 2)
    out = points.withColumns({"_r": along(right), "_t": along(top), "depth": along(forward)})
    seen = F.col("depth") > near
    return out.withColumns({"u": F.when(seen, width / 2 + focal * F.try_divide(F.col("_r"), F.col("depth"))), "v": F.when(seen, height / 2 - focal * F.try_divide(F.col("_t"), F.col("depth")))}).drop("_r", "_t")


def project_boxes(frames: DataFrame, boxes: DataFrame, scale: tuple[float, float], near: float = 0.1, far: float = 15.0, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Corners of each box in each frame of its scene, in corner order, if every corner lies between near and far; other boxes are left out.

    bounds (width, height): corners must also lie within one image's size of the image, on each side.
    frames(scene_id, frame_idx, pose, fx, fy, cx, cy), boxes(scene_id, object_id, aabb_min_*, aabb_max_*).
    """
    corners = boxes.select("scene_id", "object_id", F.posexplode(G.box_corners("aabb_min", "aabb_max")).alias("corner", "p")).select("scene_id", "object_id", "corner", "p.*")
    seen = project(frames.join(corners, "scene_id"), near, scale)
    good = F.col("u").isNotNull() & (F.col("depth") <= far)
    if bounds:
        good = good & F.col("u").between(-bounds[0], 2 * bounds[0]) & F.col("v").between(-bounds[1], 2 * bounds[1])
    packed = seen.groupBy("scene_id", "frame_idx", "object_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("ok"), F.array_sort(F.collect_list(F.struct("corner", "u", "v"))).alias("corners"))
    return packed.where("ok").drop("ok")


def in_view(frames: DataFrame, boxes: DataFrame, width: int, height: int, near: float = 1e-6, slack: float = 1e-6) -> DataFrame:
    """Frames of a scene with the objects that may have a point in the image: those whose box isn't wholly on the outer side of one plane of the view.

    frames(scene_id, frame_idx, pose, fx, fy, cx, cy), boxes(scene_id, object_id, aabb_min_*, aabb_max_*). A plane's greatest
    value over a box is the sum of the greatest value along each axis, so no corner is made.
    """
    p = lambda i, j: F.col("pose")[4 * i + j]

    def most(weight: dict[int, Column]) -> Column:
        """Greatest value, over the box, of the sum of camera coordinates times their weights."""
        parts = []
        for i, k in enumerate("xyz"):
            g = sum((p(i, j) * w for j, w in list(weight.items())[1:]), p(i, next(iter(weight))) * next(iter(weight.values())))
            parts.append(F.greatest(g * (F.col(f"aabb_min_{k}") - p(i, 3)), g * (F.col(f"aabb_max_{k}") - p(i, 3))))
        return parts[0] + parts[1] + parts[2]

    planes = [{0: F.col("fx"), 2: F.col("cx")}, {0: -F.col("fx"), 2: (width - 1) - F.col("cx")}, {1: F.col("fy"), 2: F.col("cy")}, {1: -F.col("fy"), 2: (height - 1) - F.col("cy")}]
    seen = most({2: F.lit(1.0)}) > near - slack
    for w in planes:
        seen = seen & (most(w) >= -slack)
    return frames.join(boxes.select("scene_id", "object_id", *[f"aabb_{m}_{k}" for m in ("min", "max") for k in "xyz"]), "scene_id").where(seen).select(*frames.columns, "object_id")


def cloud_boxes(seen: DataFrame, points: DataFrame, width: int, height: int, least: int = 20, near: float = 1e-6) -> DataFrame:
    """scene_id, frame_idx, object_id, n_visible, x0, y0, x1, y1: box of an object's points inside the image, as by image_boxes.

    seen(scene_id, frame_idx, pose, fx, fy, cx, cy, object_id): frames with the objects that may be in them (see in_view). Clouds are packed, a
    row an object, and meet each (frame, object) once; points are projected, counted and bounded within the row, so none is made a row or shuffled.
    """
    cloud = points.groupBy("object_id").agg(F.collect_list(F.struct(*[F.col(k).cast("double").alias(k) for k in "xyz"])).alias("_cloud"))
    both = seen.join(cloud, "object_id")

    def image(p: Column) -> Column:
        x, y, d = to_camera(F.col("pose"), p["x"], p["y"], p["z"])
        return F.struct(x.alias("x"), y.alias("y"), d.alias("d"))

    uv = F.transform(
        F.filter(F.transform("_cloud", image), lambda c: c["d"] > near),
        lambda c: F.struct((F.col("fx") * F.try_divide(c["x"], c["d"]) + F.col("cx")).alias("u"), (F.col("fy") * F.try_divide(c["y"], c["d"]) + F.col("cy")).alias("v")),
    )
    inside = both.select("scene_id", "frame_idx", "object_id", F.filter(uv, lambda p: p["u"].between(0, width - 1) & p["v"].between(0, height - 1)).alias("_in"))
    side = lambda f, k: f(F.col(f"_in.{k}"))
    out = inside.where(F.size("_in") >= least).select(
        "scene_id", "frame_idx", "object_id", F.size("_in").cast("long").alias("n_visible"),
        F.floor(side(F.array_min, "u")).alias("x0"), F.floor(side(F.array_min, "v")).alias("y0"), F.ceil(side(F.array_max, "u")).alias("x1"), F.ceil(side(F.array_max, "v")).alias("y1"),
    )
    return out.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def image_boxes(projected: DataFrame, keys: list[str], width: int, height: int, least: int = 20) -> DataFrame:
    """Box of the points inside the image, by key, if there are ``least`` of them and the box isn't empty."""
    inside = projected.where(F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1))
    out = inside.groupBy(*keys).agg(F.count("*").alias("n_visible"), F.floor(F.min("u")).alias("x0"), F.floor(F.min("v")).alias("y0"), F.ceil(F.max("u")).alias("x1"), F.ceil(F.max("v")).alias("y1"))
    return out.where((F.col("n_visible") >= least) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def clamp_boxes(boxes: DataFrame, width: int, height: int, least_side: float = 6) -> DataFrame:
    """Boxes cut to the image; those with a side under least_side are dropped."""
    cut = lambda c, top: F.greatest(F.lit(0), F.least(F.col(c), F.lit(top)))
    out = boxes.withColumns({"x0": cut("x0", width - 1), "x1": cut("x1", width - 1), "y0": cut("y0", height - 1), "y1": cut("y1", height - 1)})
    return out.where((F.col("x1") - F.col("x0") >= least_side) & (F.col("y1") - F.col("y0") >= least_side))


def visibility(projected: DataFrame, width: int, height: int, near: float = 0.3, far: float = 8.0) -> DataFrame:
    """Score of each frame: over the centroids seen in it, 1 less 0.4 of the mean offset from the image's centre. projected(scene_id, frame_idx, u, v, depth)."""
    hw, hh = width // 2, height // 2
    offset = (F.abs(F.col("u") - hw) / hw + F.abs(F.col("v") - hh) / hh) / 2
    seen = (F.col("u") > 0) & (F.col("u") < width) & (F.col("v") > 0) & (F.col("v") < height) & (F.col("depth") > near) & (F.col("depth") < far)
    return projected.groupBy("scene_id", "frame_idx").agg(F.sum(F.when(seen, 1.0 - 0.4 * offset).otherwise(0.0)).alias("score"))


def best_window(scores: DataFrame, n_frames: int, stride: int = 3) -> DataFrame:
    """Per scene the start of the best n_frames // stride consecutive sampled frames; of equal sums the earliest."""
    size = max(1, n_frames // stride)
    w = Window.partitionBy("scene_id").orderBy("frame_idx")
    ahead = w.rowsBetween(0, size - 1)
    sums = scores.where(F.col("frame_idx") % stride == 0).withColumns({"sum": F.sum("score").over(ahead), "n": F.count("*").over(ahead)}).where(F.col("n") == size)
    best = F.max(F.struct(F.col("sum"), (-F.col("frame_idx")).alias("i")))
    return sums.groupBy("scene_id").agg(best.alias("m")).select("scene_id", (-F.col("m.i")).alias("start_frame"), F.col("m.sum").alias("window_score"))


def sample_frames(frames: DataFrame, step: int, most: int) -> DataFrame:
    """Every step-th frame of a scene, the first ``most`` of them."""
    w = Window.partitionBy("scene_id").orderBy("frame_idx")
    return frames.where(F.col("frame_idx") % step == 0).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def frame_range(frames: DataFrame, first: int, last: int, stride: int = 1) -> DataFrame:
    return frames.where(F.col("frame_idx").between(first, last) & ((F.col("frame_idx") - first) % stride == 0))
