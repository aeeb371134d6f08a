"""Spatial tables from the driver's tables, as DataFrames and as the SQL that says the same for DuckDB.

Embeddings become objects: 25 vectors make a scene, and a vector's 64 numbers 21 points (the last number is unused), in units of
centimetres, so that the official thresholds bite. Two of ten labels are unknown. Clouds of one scene overlap in height; where a query needs objects
above others, each is raised by ``shelf`` times vec_id % 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import objects as O

RAW = ["Office Chair", "dining table", "desk", "couch", " bed ", "door", "Kitchen Cabinet", "tv", None, "other"]
PER_SCENE = 25
MIN_POINTS, MIN_POINTS_MONITOR = 20, 15
#: How much objects on the next shelf are raised, in queries about above.
SHELF = 20.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, shelf: float = 0.0) -> DataFrame:
    """Points of all objects: scene_id, instance_id_raw, label_raw, pt_idx, x, y, z."""
    e = read(spark, sf_dir, "embeddings").select(
        F.format_string("scene%04d_00", F.expr("CAST(vec_id div 25 AS INT)")).alias("scene_id"),
        F.col("vec_id").cast("int").alias("instance_id_raw"),
        F.get(F.array(*map(F.lit, RAW)), F.pmod("label", F.lit(10))).alias("label_raw"),
        F.expr(f"transform(sequence(0, 20), i -> struct(100D * CAST(embedding[3 * i] AS DOUBLE) AS x, 100D * CAST(embedding[3 * i + 1] AS DOUBLE) AS y, 100D * CAST(embedding[3 * i + 2] AS DOUBLE) + {float(shelf)}D * (vec_id % 5) AS z))").alias("p"),
    )
    return e.select("scene_id", "instance_id_raw", "label_raw", F.posexplode_outer("p").alias("pt_idx", "q")).select("scene_id", "instance_id_raw", "label_raw", "pt_idx", "q.*")


def objects(spark: SparkSession, sf_dir: str, shelf: float = 0.0, min_points: int = MIN_POINTS, min_points_monitor: int = MIN_POINTS_MONITOR) -> DataFrame:
    return O.manifest(points(spark, sf_dir, shelf), min_points, min_points_monitor)


def valid_objects(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return O.valid(objects(spark, sf_dir, **options))


def clouds(spark: SparkSession, sf_dir: str, objs: DataFrame) -> DataFrame:
    """Points with their object ids."""
    return points(spark, sf_dir).join(objs.select("scene_id", "instance_id_raw", "object_id"), ["scene_id", "instance_id_raw"]).select("scene_id", "object_id", "pt_idx", "x", "y", "z")


_NORM = "CASE label % 10 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(["chair", "table", "desk", "sofa", "bed", "door", "cabinet", "monitor"])) + " END"
_RAW = "CASE label % 10 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(RAW) if c) + " END"


def objects_sql(shelf: float = 0.0, min_points: int = MIN_POINTS, min_points_monitor: int = MIN_POINTS_MONITOR) -> str:
    """CTEs pts (points), obj (all objects) and v (valid objects)."""
    need = f"CASE WHEN label_norm = 'monitor' THEN {min_points_monitor} ELSE {min_points} END"
    ext = "least(extent_x, extent_y, extent_z)"
    return f"""WITH pts AS (
        SELECT printf('scene%04d_00', vec_id // 25) AS scene_id, vec_id::INT AS instance_id_raw, {_RAW} AS label_raw, {_NORM} AS label_norm, i::INT AS pt_idx,
               printf('%s__%s_%03d', printf('scene%04d_00', vec_id // 25), coalesce({_NORM}, 'unknown'), vec_id) AS object_id,
               100.0::DOUBLE * embedding[3 * i + 1]::DOUBLE AS x, 100.0::DOUBLE * embedding[3 * i + 2]::DOUBLE AS y, 100.0::DOUBLE * embedding[3 * i + 3]::DOUBLE + {float(shelf)}::DOUBLE * (vec_id % 5) AS z
        FROM embeddings, range(21) t(i)),
    m AS (SELECT scene_id, instance_id_raw, label_raw, label_norm, object_id, count(*)::INT AS n_points,
               {', '.join(f'avg({k}) AS centroid_{k}, min({k}) AS aabb_min_{k}, max({k}) AS aabb_max_{k}, max({k}) - min({k}) AS extent_{k}' for k in 'xyz')}
        FROM pts GROUP BY scene_id, instance_id_raw, label_raw, label_norm, object_id),
    o AS (SELECT *, sqrt(extent_x * extent_x + extent_y * extent_y + extent_z * extent_z) AS diag_3d FROM m),
    obj AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY label_norm NULLS LAST, object_id) AS ord,
               CASE WHEN label_norm IS NULL THEN 'label_not_in_benchmark' WHEN n_points < {need} THEN 'too_few_points'
                    WHEN {ext} <= 1e-4 THEN 'degenerate_bbox' WHEN diag_3d < 0.1 THEN 'too_small_extent' ELSE '' END AS invalid_reason,
               ((label_norm IS NOT NULL)::INT + (n_points >= {need})::INT + ({ext} > 1e-4)::INT) / 3.0::DOUBLE AS quality_score FROM o),
    v AS (SELECT * FROM obj WHERE invalid_reason = '')"""


def segment_sql(x: str, a: str, b: str) -> dict[str, str]:
    """SQL of the plane geometry of point x against a and b, table aliases with centroid_x and centroid_y."""
    p = {n: f"{t}.centroid_{k}" for n, t, k in (("px", x, "x"), ("py", x, "y"), ("ax", a, "x"), ("ay", a, "y"), ("bx", b, "x"), ("by", b, "y"))}
    dx, dy = f"({p['bx']} - {p['ax']})", f"({p['by']} - {p['ay']})"
    l2 = f"({dx} * {dx} + {dy} * {dy})"
    to_a = f"sqrt(pow({p['px']} - {p['ax']}, 2) + pow({p['py']} - {p['ay']}, 2))"
    t = f"(CASE WHEN {l2} <= 1e-12 THEN 0.0 ELSE (({p['px']} - {p['ax']}) * {dx} + ({p['py']} - {p['ay']}) * {dy}) / {l2} END)"
    tc = f"greatest(0.0, least(1.0, {t}))"
    d = f"(CASE WHEN {l2} <= 1e-12 THEN {to_a} ELSE sqrt(pow({p['px']} - ({p['ax']} + {tc} * {dx}), 2) + pow({p['py']} - ({p['ay']} + {tc} * {dy}), 2)) END)"
    line = f"(CASE WHEN {l2} <= 1e-12 THEN {to_a} ELSE abs({dx} * ({p['py']} - {p['ay']}) - {dy} * ({p['px']} - {p['ax']})) / sqrt({l2}) END)"
    return {"t": t, "d": d, "line": line, "len2": l2}


def distance_sql(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"pow({a}.centroid_{k} - {b}.centroid_{k}, 2)" for k in "xyz") + ")"


#: CTE surf: surface distance of every two valid objects of a scene, both ways round.
SURFACE_SQL = """, surf AS (
        SELECT a.object_id AS object_a, b.object_id AS object_b, sqrt(min(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2))) AS d
        FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.object_id <> b.object_id JOIN pts p ON p.object_id = a.object_id JOIN pts q ON q.object_id = b.object_id
        GROUP BY a.object_id, b.object_id)"""
