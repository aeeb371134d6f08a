"""Geometry as Column expressions: no Python at run time. Coordinates are doubles; every tolerance is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Squared length below which a segment counts as a point.
POINT_SQ = 1e-12
#: Length below which a box-anchored segment counts as a point.
POINT_LEN = 1e-6


def c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def sq(v: Column) -> Column:
    return v * v


def distance_3d(a: str, b: str) -> Column:
    """Euclidean distance of the points (a_x, a_y, a_z) and (b_x, b_y, b_z)."""
    return F.sqrt(sum((sq(F.col(f"{a}_{k}") - F.col(f"{b}_{k}")) for k in "yz"), sq(F.col(f"{a}_x") - F.col(f"{b}_x"))))


def _segment(x: str, a: str, b: str) -> dict[str, Column]:
    ax, ay, bx, by, px, py = (F.col(f"{p}_{k}") for p in (a, b, x) for k in "xy")
    dx, dy = bx - ax, by - ay
    return {"ax": ax, "ay": ay, "dx": dx, "dy": dy, "px": px, "py": py, "len_sq": sq(dx) + sq(dy), "to_a": F.sqrt(sq(px - ax) + sq(py - ay))}


def segment_position_xy(x: str, a: str, b: str) -> Column:
    """Position of x's projection along a-b, unclamped: 0 at a, 1 at b; 0 if a and b coincide."""
    s = _segment(x, a, b)
    t = F.try_divide((s["px"] - s["ax"]) * s["dx"] + (s["py"] - s["ay"]) * s["dy"], s["len_sq"])
    return F.when(s["len_sq"] <= POINT_SQ, F.lit(0.0)).otherwise(t)


def segment_distance_xy(x: str, a: str, b: str) -> Column:
    """Distance of x to the segment a-b in the plane; to a if a and b coincide."""
    s = _segment(x, a, b)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), segment_position_xy(x, a, b)))
    d = F.sqrt(sq(s["px"] - (s["ax"] + t * s["dx"])) + sq(s["py"] - (s["ay"] + t * s["dy"])))
    return F.when(s["len_sq"] <= POINT_SQ, s["to_a"]).otherwise(d)


def line_distance_xy(x: str, a: str, b: str) -> Column:
    """Distance of x to the infinite line through a and b; to a if they coincide."""
    s = _segment(x, a, b)
    cross = s["dx"] * (s["py"] - s["ay"]) - s["dy"] * (s["px"] - s["ax"])
    return F.when(s["len_sq"] <= POINT_SQ, s["to_a"]).otherwise(F.try_divide(F.abs(cross), F.sqrt(s["len_sq"])))


def between_xy(x: str, a: str, b: str, tau: float | Column, degenerate: str = "distance", tau_mode: str = "absolute") -> Column:
    """Whether x lies between a and b: its projection falls on the segment (ends included) and its distance is at most tau.

    degenerate: what coinciding ends mean: "distance" (within tau of a) or "false". tau_mode "relative": tau times the
    segment's length, with ends closer than POINT_LEN coinciding.
    """
    s, t = _segment(x, a, b), segment_position_xy(x, a, b)
    length = F.sqrt(s["len_sq"])
    limit = F.lit(tau) if not isinstance(tau, Column) else tau
    limit = limit * length if tau_mode == "relative" else limit
    hit = (t >= 0) & (t <= 1) & (segment_distance_xy(x, a, b) <= limit)
    if degenerate == "false" or tau_mode == "relative":
        point = length < POINT_LEN if tau_mode == "relative" else s["len_sq"] <= POINT_SQ
        return F.when(point, F.lit(False)).otherwise(hit)
    return hit


def aligned_xy(a: str, b: str, c_: str, tau: float | Column, pivot: str = "last", degenerate: str = "distance", tau_mode: str = "absolute") -> Column:
    """Whether three points are in line. pivot "last": distance of the third to the line of the first two; "middle": of the second to the line of the outer two."""
    x, p, q = (c_, a, b) if pivot == "last" else (b, a, c_)
    s = _segment(x, p, q)
    length = F.sqrt(s["len_sq"])
    limit = F.lit(tau) if not isinstance(tau, Column) else tau
    limit = limit * length if tau_mode == "relative" else limit
    hit = line_distance_xy(x, p, q) <= limit
    if degenerate == "false" or tau_mode == "relative":
        point = length < POINT_LEN if tau_mode == "relative" else s["len_sq"] <= POINT_SQ
        return F.when(point, F.lit(False)).otherwise(hit)
    return hit


def above(min_z: str | Column, max_z: str | Column, tau: float = 0.0) -> Column:
    """Whether a box whose bottom is min_z stands above one whose top is max_z; null if either object is missing."""
    return c(min_z) >= c(max_z) - tau


def box_gap(a: str, b: str) -> Column:
    """Distance of two axis-aligned boxes (a_min_x, a_max_x, ...): a lower bound of the distance of anything inside them."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{a}_min_{k}") - F.col(f"{b}_max_{k}"), F.col(f"{b}_min_{k}") - F.col(f"{a}_max_{k}")) for k in "xyz"]
    return F.sqrt(sq(gaps[0]) + sq(gaps[1]) + sq(gaps[2]))


def box_corners(lo: str, hi: str) -> Column:
    """The eight corners of a box in order: around the bottom, then around the top."""
    order = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    at = lambda i, k: F.col(f"{hi if i else lo}_{k}")
    return F.array(*[F.struct(at(i, "x").alias("x"), at(j, "y").alias("y"), at(k, "z").alias("z")) for i, j, k in order])


#: Corner numbers of a box's twelve edges: bottom, top, uprights.
BOX_EDGES = [(i, (i + 1) % 4) for i in range(4)] + [(4 + i, 4 + (i + 1) % 4) for i in range(4)] + [(i, 4 + i) for i in range(4)]


def fan_triangles(face: str | Column) -> Column:
    """A polygon's vertex numbers as a fan of triangles from its first vertex; none for fewer than three."""
    f = c(face)
    return F.when(F.size(f) >= 3, F.transform(F.sequence(F.lit(1), F.size(f) - 2), lambda j: F.array(F.get(f, F.lit(0)), F.get(f, j), F.get(f, j + 1)))).otherwise(F.array().cast("array<array<int>>"))


def invalid_reason(label: Column, n_points: Column, extents: list[Column], min_points: int = 150, min_points_monitor: int = 80, flat: float = 1e-4, small: float = 0.10) -> Column:
    """Why an object is unusable, by the first rule that it breaks; empty if it breaks none."""
    need = F.when(label == "monitor", F.lit(min_points_monitor)).otherwise(F.lit(min_points))
    norm = F.sqrt(sum((sq(e) for e in extents[1:]), sq(extents[0])))
    return (
        F.when(label.isNull(), "label_not_in_benchmark")
        .when(n_points < need, "too_few_points")
        .when(F.least(*extents) <= flat, "degenerate_bbox")
        .when(norm < small, "too_small_extent")
        .otherwise("")
    )


def quality_score(label: Column, n_points: Column, extents: list[Column], min_points: int = 150, min_points_monitor: int = 80, flat: float = 1e-4) -> Column:
    """Share of three checks passed: label known, points enough, no flat side."""
    need = F.when(label == "monitor", F.lit(min_points_monitor)).otherwise(F.lit(min_points))
    return (label.isNotNull().cast("double") + (n_points >= need).cast("double") + (F.least(*extents) > flat).cast("double")) / 3.0
