"""From vertices, segments and groups to objects: assembly, centroids and boxes, validity, enumeration order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

AXES = ("x", "y", "z")


def assemble(vertices: DataFrame, vertex_segments: DataFrame, groups: DataFrame) -> DataFrame:
    """Points of each instance: vertex -> segment -> group, by equi-joins on (scene_id, seg_id).

    vertices(scene_id, vertex_idx, x, y, z), vertex_segments(scene_id, vertex_idx, seg_id), groups(scene_id, instance_id_raw,
    label_raw, segments array). A segment listed twice in a group counts once.
    """
    listed = groups.select("scene_id", "instance_id_raw", "label_raw", F.explode(F.array_distinct("segments")).alias("seg_id"))
    return vertices.join(vertex_segments, ["scene_id", "vertex_idx"]).join(listed, ["scene_id", "seg_id"]).select("scene_id", "instance_id_raw", "label_raw", "vertex_idx", *AXES)


def segment_point_counts(vertex_segments: DataFrame, groups: DataFrame) -> DataFrame:
    """Points of each group by its segment list; here a segment listed twice counts twice, one without vertices 0."""
    n = vertex_segments.groupBy("scene_id", "seg_id").agg(F.count("*").alias("n"))
    listed = groups.select("scene_id", "instance_id_raw", F.explode_outer("segments").alias("seg_id"))
    return listed.join(n, ["scene_id", "seg_id"], "left").groupBy("scene_id", "instance_id_raw").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_points"))


def measure(points: DataFrame, keys: list[str]) -> DataFrame:
    """n_points, centroid, box, extent and diagonal by key; float sums are taken in doubles."""
    xyz = {k: F.col(k).cast("double") for k in AXES}
    out = points.groupBy(*keys).agg(
        F.count("*").cast("int").alias("n_points"),
        *[F.avg(v).alias(f"centroid_{k}") for k, v in xyz.items()],
        *[F.min(v).alias(f"aabb_min_{k}") for k, v in xyz.items()],
        *[F.max(v).alias(f"aabb_max_{k}") for k, v in xyz.items()],
    )
    out = out.withColumns({f"extent_{k}": F.col(f"aabb_max_{k}") - F.col(f"aabb_min_{k}") for k in AXES})
    return out.withColumn("diag_3d", F.sqrt(sum((G.sq(F.col(f"extent_{k}")) for k in "yz"), G.sq(F.col("extent_x")))))


def manifest(points: DataFrame, min_points: int = 150, min_points_monitor: int = 80, flat: float = 1e-4, small: float = 0.10) -> DataFrame:
    """One row per object of points(scene_id, instance_id_raw, label_raw, x, y, z): label, measures, validity and its reason, quality, and ord,
    the object's place in the enumeration order of its scene (label, then object id; unlabelled objects last)."""
    m = measure(points, ["scene_id", "instance_id_raw", "label_raw"]).withColumn("label_norm", T.normalize_label(F.col("label_raw")))
    extents = [F.col(f"extent_{k}") for k in AXES]
    m = m.withColumn("object_id", T.object_id(F.col("scene_id"), F.col("label_norm"), F.col("instance_id_raw")))
    m = m.withColumn("invalid_reason", G.invalid_reason(F.col("label_norm"), F.col("n_points"), extents, min_points, min_points_monitor, flat, small))
    m = m.withColumn("is_valid_object", F.col("invalid_reason") == "")
    m = m.withColumn("quality_score", G.quality_score(F.col("label_norm"), F.col("n_points"), extents, min_points, min_points_monitor, flat))
    return with_ord(m)


def with_ord(objects: DataFrame) -> DataFrame:
    w = Window.partitionBy("scene_id").orderBy(F.col("label_norm").asc_nulls_last(), "object_id")
    return objects.withColumn("ord", F.row_number().over(w))


def valid(objects: DataFrame) -> DataFrame:
    return objects.where("is_valid_object")


def aliases(objects: DataFrame) -> DataFrame:
    """Short names by label and running number (chair1, chair2, ...), in order of object id, and the object's number in its scene."""
    by_label = Window.partitionBy("scene_id", "label_norm").orderBy("object_id")
    by_scene = Window.partitionBy("scene_id").orderBy("label_norm", "object_id")
    return objects.where("label_norm IS NOT NULL").withColumns(
        {
            "alias": F.concat("label_norm", F.row_number().over(by_label).cast("string")),
            "number": F.row_number().over(by_scene),
            "color_index": F.pmod(F.dense_rank().over(Window.partitionBy("scene_id").orderBy("label_norm")) - 1, F.lit(10)),
        }
    )


def numbered_list(objects: DataFrame) -> DataFrame:
    """Per scene the text that lists its objects for a model: a line "number: label -> id" each, by number. A scene's objects are tens."""
    line = F.format_string("%d: %s -> %s", "number", "label_norm", "object_id")
    each = aliases(objects).select("scene_id", F.struct("number", line.alias("line")).alias("s"))
    return each.groupBy("scene_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("listing"))


def relative_position(objects: DataFrame) -> DataFrame:
    """Which third of its scene's centroid range an object is in, on each axis."""
    names = {"x": ("left", "center", "right"), "y": ("front", "middle", "back"), "z": ("low", "mid-height", "high")}
    w = Window.partitionBy("scene_id")
    out = objects
    for k, (low, mid, high) in names.items():
        v = F.col(f"centroid_{k}")
        share = F.try_divide(v - F.min(v).over(w), F.max(v).over(w) - F.min(v).over(w))
        out = out.withColumn(f"pos_{k}", F.when(share < 1 / 3, low).when(share < 2 / 3, mid).when(share.isNotNull(), high).otherwise(mid))
    return out


def oriented_box(points: DataFrame, keys: list[str], low: float = 0.05, high: float = 0.95, least: int = 20) -> DataFrame:
    """Gravity-aligned box: points outside the given percentiles of an axis are left out (unless fewer than ``least`` remain), the
    plane is turned to its principal axis, and extents are taken there. The angle is in radians from the x axis, in (-pi/2, pi/2]."""
    xyz = [F.col(k).cast("double").alias(k) for k in AXES]
    p = points.select(*keys, *xyz)
    q = p.groupBy(*keys).agg(*[F.percentile(k, F.array(F.lit(low), F.lit(high))).alias(f"q{k}") for k in AXES])
    inside = F.lit(True)
    for k in AXES:
        inside = inside & F.col(k).between(F.col(f"q{k}")[0], F.col(f"q{k}")[1])
    p = p.join(q, keys).withColumn("inside", inside)
    p = p.join(p.groupBy(*keys).agg(F.count_if("inside").alias("n_inside")), keys).where((F.col("n_inside") < least) | F.col("inside"))
    axes = p.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.covar_samp("x", "x").alias("xx"), F.covar_samp("y", "y").alias("yy"), F.covar_samp("x", "y").alias("xy"))
    axes = axes.withColumn("angle", 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")))
    u = (F.col("x") - F.col("cx")) * F.cos("angle") + (F.col("y") - F.col("cy")) * F.sin("angle")
    v = -(F.col("x") - F.col("cx")) * F.sin("angle") + (F.col("y") - F.col("cy")) * F.cos("angle")
    turned = p.join(axes, keys).withColumns({"u": u, "v": v})
    return turned.groupBy(*keys, "cx", "cy", "angle").agg(F.min("u").alias("u_min"), F.max("u").alias("u_max"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


def draw_key(seed: int, *names: str) -> Column:
    """A random order that any engine can repeat: md5 of the seed and the named columns, written with bars between; nulls are left out."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in names]))


def downsample(points: DataFrame, keys: list[str], order: str, limit: int, seed: int = 42) -> DataFrame:
    """At most ``limit`` rows a key without replacement, the same ones on every run: those of the smallest md5 of (seed, key, order)."""
    w = Window.partitionBy(*keys).orderBy(draw_key(seed, *keys, order), order)
    return points.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def stratified_sample(rows: DataFrame, strata: list[str], order: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum, chosen as in ``downsample``."""
    return downsample(rows, strata, order, n, seed)
