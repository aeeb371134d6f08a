"""Queries of camera frames: projection, boxes, visibility, windows, sampling, smoothing; events stand in for the frame clock."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as R
from ..operators import smoothing as S
from .adapters import objects_sql, read, valid_objects

QUERIES: dict = {}
ORACLE_SQL: dict = {}
W, H, FOCAL, STEPS = 640, 480, 300.0, 24


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _frames(v):
    """A camera that turns about the vertical axis, 24 frames a scene, 40 units before the scene's middle; pose is camera to world."""
    scenes = v.groupBy("scene_id").agg(*[F.avg(f"centroid_{k}").alias(f"m{k}") for k in "xyz"])
    i = F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("frame_idx")
    f = scenes.select("scene_id", "mx", "my", "mz", i).withColumn("a", 6.283185307179586 * F.col("frame_idx") / STEPS)
    c, s = F.cos("a"), F.sin("a")
    # camera axes in the world: x to the right, y down, z forward
    pose = [c, F.lit(0.0), s, F.col("mx") - 40 * s, F.lit(0.0), F.lit(1.0), F.lit(0.0), F.col("my"), -s, F.lit(0.0), c, F.col("mz") - 40 * c, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return f.select("scene_id", "frame_idx", F.array(*pose).alias("pose"), F.lit(FOCAL).alias("fx"), F.lit(FOCAL).alias("fy"), F.lit(W / 2).alias("cx"), F.lit(H / 2).alias("cy"))


_FR = f"""{objects_sql()}, sc AS (SELECT scene_id, avg(centroid_x) AS mx, avg(centroid_y) AS my, avg(centroid_z) AS mz FROM v GROUP BY scene_id),
    fr AS (SELECT scene_id, i::INT AS frame_idx, cos(6.283185307179586 * i / {STEPS}) AS c, sin(6.283185307179586 * i / {STEPS}) AS s, mx, my, mz FROM sc, range({STEPS}) t(i))"""


def _cam(x: str, y: str, z: str) -> str:
    """Camera coordinates px, py, pz of a world point for frame alias fr."""
    dx, dy, dz = f"({x} - (mx - 40 * s))", f"({y} - my)", f"({z} - (mz - 40 * c))"
    return f"c * {dx} - s * {dz} AS px, {dy} AS py, s * {dx} + c * {dz} AS pz"


_CENTRES = f", pr AS (SELECT fr.scene_id, frame_idx, object_id, {_cam('centroid_x', 'centroid_y', 'centroid_z')} FROM fr JOIN v USING (scene_id))"


def _projected(spark, sf_dir, **options):
    v = valid_objects(spark, sf_dir)
    p = v.select("scene_id", "object_id", *[F.col(f"centroid_{k}").alias(k) for k in "xyz"])
    return R.project(_frames(v).join(p, "scene_id"), **options)


@query("project_points", f"{_FR}{_CENTRES} SELECT scene_id, frame_idx, object_id, CASE WHEN pz > 1e-6 THEN round({FOCAL} * px / pz + {W / 2}, 4) END AS u, CASE WHEN pz > 1e-6 THEN round({FOCAL} * py / pz + {H / 2}, 4) END AS v, round(pz, 6) AS depth FROM pr")
def project_points(spark, sf_dir):
    return _projected(spark, sf_dir).select("scene_id", "frame_idx", "object_id", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"), F.round("depth", 6).alias("depth"))


_SCALED = f"trunc(({FOCAL} * px / pz + {W / 2}) * 0.5)::INT AS u, trunc(({FOCAL} * py / pz + {H / 2}) * 0.5)::INT AS v"
_CORNERS = f""", k(n, a, b, d) AS (VALUES (0,0,0,0), (1,1,0,0), (2,1,1,0), (3,0,1,0), (4,0,0,1), (5,1,0,1), (6,1,1,1), (7,0,1,1)),
    bx AS (SELECT scene_id, object_id, n, CASE a WHEN 0 THEN aabb_min_x ELSE aabb_max_x END AS x, CASE b WHEN 0 THEN aabb_min_y ELSE aabb_max_y END AS y, CASE d WHEN 0 THEN aabb_min_z ELSE aabb_max_z END AS z FROM v, k),
    pc AS (SELECT fr.scene_id, frame_idx, object_id, n, {_cam('x', 'y', 'z')} FROM fr JOIN bx USING (scene_id)),
    ok AS (SELECT scene_id, frame_idx, object_id FROM pc GROUP BY ALL HAVING bool_and(pz > 0.1 AND pz <= 95))"""


@query("project_boxes", f"{_FR}{_CORNERS} SELECT scene_id, frame_idx, object_id, n AS corner, {_SCALED} FROM pc JOIN ok USING (scene_id, frame_idx, object_id)")
def project_boxes(spark, sf_dir):
    v = valid_objects(spark, sf_dir)
    b = R.project_boxes(_frames(v), v, (0.5, 0.5), far=95.0)
    return b.select("scene_id", "frame_idx", "object_id", F.explode("corners").alias("k")).select("scene_id", "frame_idx", "object_id", "k.corner", "k.u", "k.v")


@query("project_boxes_bounded", f"{_FR}{_CORNERS}, q AS (SELECT scene_id, frame_idx, object_id, n AS corner, {_SCALED} FROM pc JOIN ok USING (scene_id, frame_idx, object_id)) SELECT scene_id, frame_idx, object_id, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM q GROUP BY ALL HAVING min(u) >= -320 AND max(u) <= 640 AND min(v) >= -240 AND max(v) <= 480")
def project_boxes_bounded(spark, sf_dir):
    v = valid_objects(spark, sf_dir)
    b = R.project_boxes(_frames(v), v, (0.5, 0.5), far=95.0, bounds=(320, 240))
    part = lambda f, k: f(F.transform("corners", lambda c: c[k]))
    return b.select("scene_id", "frame_idx", "object_id", part(F.array_min, "u").alias("u0"), part(F.array_max, "u").alias("u1"), part(F.array_min, "v").alias("v0"), part(F.array_max, "v").alias("v1"))


_PTS = f", pp AS (SELECT fr.scene_id, frame_idx, object_id, {_cam('x', 'y', 'z')} FROM fr JOIN pts USING (scene_id) WHERE object_id IN (SELECT object_id FROM v)), uv AS (SELECT scene_id, frame_idx, object_id, {FOCAL} * px / pz + {W / 2} AS u, {FOCAL} * py / pz + {H / 2} AS v FROM pp WHERE pz > 1e-6)"


@query("bbox2d", f"""{_FR}{_PTS}, b AS (SELECT scene_id, frame_idx, object_id, count(*) AS n_visible, floor(min(u)) AS x0, floor(min(v)) AS y0, ceil(max(u)) AS x1, ceil(max(v)) AS y1 FROM uv WHERE u BETWEEN 0 AND {W - 1} AND v BETWEEN 0 AND {H - 1} GROUP BY ALL),
    k AS (SELECT scene_id, frame_idx, object_id, n_visible, greatest(0, least(x0, 599))::BIGINT AS x0, greatest(0, least(x1, 599))::BIGINT AS x1, greatest(0, least(y0, 399))::BIGINT AS y0, greatest(0, least(y1, 399))::BIGINT AS y1 FROM b WHERE n_visible >= 18 AND x1 > x0 AND y1 > y0) SELECT * FROM k WHERE x1 - x0 >= 6 AND y1 - y0 >= 6""")
def bbox2d(spark, sf_dir):
    from .adapters import clouds

    v = valid_objects(spark, sf_dir)
    seen = R.in_view(_frames(v), v, W, H)
    return R.clamp_boxes(R.cloud_boxes(seen, clouds(spark, sf_dir, v), W, H, 18), 600, 400)


_SCORE = f"""{_FR}{_CENTRES}, uv AS (SELECT scene_id, frame_idx, pz, CASE WHEN pz > 0.1 THEN trunc({FOCAL} * px / pz + {W / 2})::INT END AS u, CASE WHEN pz > 0.1 THEN trunc({FOCAL} * py / pz + {H / 2})::INT END AS v FROM pr),
    sco AS (SELECT scene_id, frame_idx, sum(CASE WHEN u > 0 AND u < {W} AND v > 0 AND v < {H} AND pz > 0.3 AND pz < 42 THEN 1.0 - 0.4 * (abs(u - {W // 2}) / {W // 2}::DOUBLE + abs(v - {H // 2}) / {H // 2}::DOUBLE) / 2 ELSE 0.0 END) AS score FROM uv GROUP BY ALL)"""


def _scores(spark, sf_dir):
    return R.visibility(_projected(spark, sf_dir, near=0.1, scale=(1.0, 1.0)), W, H, far=42.0)


@query("frame_scores", f"{_SCORE} SELECT scene_id, frame_idx, round(score, 6) AS score FROM sco")
def frame_scores(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(
    "best_window",
    f"""{_SCORE}, w AS (SELECT scene_id, frame_idx, sum(round(score, 6)) OVER x AS s, count(*) OVER x AS n FROM sco WHERE frame_idx % 3 = 0 WINDOW x AS (PARTITION BY scene_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY round(s, 5) DESC, frame_idx) AS rn FROM w WHERE n = 3) SELECT scene_id, frame_idx AS start_frame, round(s, 5) AS window_score FROM r WHERE rn = 1""",
)
def best_window(spark, sf_dir):
    return R.best_window(_scores(spark, sf_dir).withColumn("score", F.round("score", 6)), 9).withColumn("window_score", F.round("window_score", 5))


@query("look_at_points", f"{objects_sql()}, p AS (SELECT object_id, (0.6 * (centroid_x + 60) + 0.8 * (centroid_y + 80)) AS f, 0.8 * (centroid_x + 60) - 0.6 * (centroid_y + 80) AS r, centroid_z - 5 AS t FROM v) SELECT object_id, round(320 + 240 / tan(radians(30)) * r / f, 4) AS u, round(240 - 240 / tan(radians(30)) * t / f, 4) AS v, round(f, 6) AS depth FROM p")
def look_at_points(spark, sf_dir):
    p = valid_objects(spark, sf_dir).select("object_id", *[F.col(f"centroid_{k}").alias(k) for k in "xyz"])
    return R.look_at(p, (-60.0, -80.0, 5.0), (0.0, 0.0, 5.0), (0.0, 0.0, 1.0), 60.0, W, H).select("object_id", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"), F.round("depth", 6).alias("depth"))


def _clock(spark, sf_dir):
    """Events as frames: a user is a clip, an event's place in it a frame."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("scene_id"), (F.row_number().over(w) - 1).alias("frame_idx"), "event_id", "value")


_CLOCK = "WITH ck AS (SELECT user_id AS scene_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, event_id, value FROM events)"


@query("frame_sample", f"{_CLOCK} SELECT scene_id, frame_idx, event_id FROM ck WHERE frame_idx % 5 = 0 AND frame_idx < 40")
def frame_sample(spark, sf_dir):
    return R.sample_frames(_clock(spark, sf_dir), 5, 8).select("scene_id", "frame_idx", "event_id")


@query("frame_window", f"{_CLOCK} SELECT scene_id, frame_idx, event_id FROM ck WHERE frame_idx BETWEEN 7 AND 21 AND (frame_idx - 7) % 2 = 0")
def frame_window(spark, sf_dir):
    return R.frame_range(_clock(spark, sf_dir), 7, 21, 2).select("scene_id", "frame_idx", "event_id")


@query(
    "ema_smooth",
    f"""{_CLOCK.replace('WITH', 'WITH RECURSIVE')}, m AS (SELECT scene_id, frame_idx, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM ck),
    r AS (SELECT scene_id, frame_idx, value, value AS smoothed FROM m WHERE frame_idx = 0 UNION ALL SELECT m.scene_id, m.frame_idx, m.value, CASE WHEN r.smoothed IS NULL THEN m.value WHEN m.value IS NULL THEN r.smoothed ELSE 0.8 * r.smoothed + 0.2 * m.value END FROM r JOIN m ON m.scene_id = r.scene_id AND m.frame_idx = r.frame_idx + 1)
    SELECT scene_id, frame_idx, value, round(smoothed, 6) AS smoothed FROM r""",
)
def ema_smooth(spark, sf_dir):
    rows = _clock(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 9 != 0, F.col("value")))
    return S.smooth(rows, "scene_id", ["frame_idx"], "value").withColumn("smoothed", F.round("smoothed", 6))


@query(
    "ema_boxes",
    f"""{_CLOCK.replace('WITH', 'WITH RECURSIVE')}, m AS (SELECT scene_id, frame_idx, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 10 = 0 THEN [value, value + 1] ELSE [value, value / 2, value + 3, value * 2] END AS box FROM ck),
    r AS (SELECT scene_id, frame_idx, box, box AS s FROM m WHERE frame_idx = 0 UNION ALL SELECT m.scene_id, m.frame_idx, m.box, CASE WHEN m.box IS NULL THEN r.s WHEN r.s IS NULL OR len(r.s) <> len(m.box) THEN m.box WHEN len(r.s) = 2 THEN [0.8 * r.s[1] + 0.2 * m.box[1], 0.8 * r.s[2] + 0.2 * m.box[2]] ELSE [0.8 * r.s[1] + 0.2 * m.box[1], 0.8 * r.s[2] + 0.2 * m.box[2], 0.8 * r.s[3] + 0.2 * m.box[3], 0.8 * r.s[4] + 0.2 * m.box[4]] END FROM r JOIN m ON m.scene_id = r.scene_id AND m.frame_idx = r.frame_idx + 1)
    SELECT scene_id, frame_idx, len(s) AS sides, round(s[1], 6) AS s0, round(s[2], 6) AS s1, round(s[3], 6) AS s2, round(s[4], 6) AS s3 FROM r""",
)
def ema_boxes(spark, sf_dir):
    v = F.col("value")
    box = F.when(F.col("event_id") % 9 == 0, None).when(F.col("event_id") % 10 == 0, F.array(v, v + 1)).otherwise(F.array(v, v / 2, v + 3, v * 2))
    out = S.smooth_shapes(_clock(spark, sf_dir).withColumn("box", box), "scene_id", ["frame_idx"], "box")
    sides = F.when(F.col("smoothed").isNotNull(), F.size("smoothed").cast("long"))
    return out.select("scene_id", "frame_idx", sides.alias("sides"), *[F.round(F.get("smoothed", i), 6).alias(f"s{i}") for i in range(4)])
