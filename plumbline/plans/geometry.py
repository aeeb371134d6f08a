"""Queries of the geometry core: objects, distances, relations, nearest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import objects as O
from ..operators import spatial as S
from .adapters import SHELF, SURFACE_SQL, clouds, distance_sql, objects, objects_sql, segment_sql, valid_objects

QUERIES: dict = {}
ORACLE_SQL: dict = {}

REFS = T.SURFACES + T.REFERENCES
_MEASURES = [f"{m}_{k}" for m in ("centroid", "aabb_min", "aabb_max", "extent") for k in "xyz"] + ["diag_3d", "quality_score"]
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


_M = ", ".join(f"round({m}, 6) AS {m}" for m in _MEASURES)


@query("object_manifest", f"{objects_sql()} SELECT scene_id, object_id, instance_id_raw, label_raw, label_norm, n_points, invalid_reason, invalid_reason = '' AS is_valid_object, ord, {_M} FROM obj")
def object_manifest(spark, sf_dir):
    cols = ["scene_id", "object_id", "instance_id_raw", "label_raw", "label_norm", "n_points", "invalid_reason", "is_valid_object", "ord"]
    return objects(spark, sf_dir).select(*cols, *[F.round(m, 6).alias(m) for m in _MEASURES])


@query("validity_reasons", f"{objects_sql(min_points_monitor=22)} SELECT invalid_reason, label_norm, count(*) AS n FROM obj GROUP BY ALL")
def validity_reasons(spark, sf_dir):
    return objects(spark, sf_dir, min_points_monitor=22).groupBy("invalid_reason", "label_norm").agg(F.count("*").alias("n"))


_PAIR = "SELECT a.scene_id, a.object_id AS object_a, b.object_id AS object_b"
_AB = "FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.ord < b.ord"


@query("distance_centroid", f"{objects_sql()} {_PAIR}, round({distance_sql('a', 'b')}, 6) AS distance_m {_AB}")
def distance_centroid(spark, sf_dir):
    return S.pairs(valid_objects(spark, sf_dir)).select("scene_id", "object_a", "object_b", F.round(G.distance_3d("a", "b"), 6).alias("distance_m"))


def _surface(strategy):
    def run(spark, sf_dir):
        v = valid_objects(spark, sf_dir)
        d = S.surface_distance(S.pairs(v), clouds(spark, sf_dir, v), strategy, cell=20.0)
        return d.select("scene_id", "object_a", "object_b", F.round("surface_distance", 6).alias("distance_m"))

    return run


_SURF = f"{objects_sql()}{SURFACE_SQL} {_PAIR}, round(s.d, 6) AS distance_m {_AB} JOIN surf s ON s.object_a = a.object_id AND s.object_b = b.object_id"
for _name, _strategy in (("distance_surface", "pruned"), ("distance_surface_exploded", "exploded"), ("distance_surface_arrow", "arrow"), ("distance_surface_grid", "grid"), ("distance_surface_scene", "scene")):
    query(_name, _SURF)(_surface(_strategy))

_BT = "FROM v x JOIN v a ON a.scene_id = x.scene_id JOIN v b ON b.scene_id = a.scene_id AND a.ord < b.ord"
_FURN_SURF = f"WHERE x.label_norm IN {_IN(T.FURNITURE)} AND a.label_norm IN {_IN(T.SURFACES)} AND b.label_norm IN {_IN(T.SURFACES)}"
_SEG = segment_sql("x", "a", "b")
_BET = f"{_SEG['t']} BETWEEN 0 AND 1 AND {_SEG['d']} <= 2.5"


def _between(**options):
    def run(spark, sf_dir):
        v = valid_objects(spark, sf_dir)
        v = S.box_anchor(v) if options.get("tau_mode") else v
        t = S.between_triples(v, F.col("label_norm").isin(T.FURNITURE), F.col("label_norm").isin(T.SURFACES))
        tau = 0.30 if options.get("tau_mode") else 2.5
        return t.select("scene_id", "object_x", "object_a", "object_b", F.round(G.segment_position_xy("x", "a", "b"), 6).alias("t"), F.round(G.segment_distance_xy("x", "a", "b"), 6).alias("d"), G.between_xy("x", "a", "b", tau, **options).alias("is_between"))

    return run


_TRI = "SELECT x.scene_id, x.object_id AS object_x, a.object_id AS object_a, b.object_id AS object_b"
_BOXED = objects_sql() + ", w AS (SELECT * REPLACE (" + ", ".join(f"(aabb_min_{k} + aabb_max_{k}) / 2 AS centroid_{k}" for k in "xyz") + ") FROM v)"
query("between_v1", f"{objects_sql()} {_TRI}, round({_SEG['t']}, 6) AS t, round({_SEG['d']}, 6) AS d, {_BET} AS is_between {_BT} {_FURN_SURF}")(_between())
query("between_degenerate_false", f"{objects_sql()} {_TRI}, round({_SEG['t']}, 6) AS t, round({_SEG['d']}, 6) AS d, {_SEG['len2']} > 1e-12 AND {_BET} AS is_between {_BT} {_FURN_SURF}")(_between(degenerate="false"))
query(
    "between_relative_aabb",
    f"{_BOXED} {_TRI}, round({_SEG['t']}, 6) AS t, round({_SEG['d']}, 6) AS d, sqrt({_SEG['len2']}) >= 1e-6 AND {_SEG['t']} BETWEEN 0 AND 1 AND {_SEG['d']} <= 0.3 * sqrt({_SEG['len2']}) AS is_between {_BT.replace('v ', 'w ')} {_FURN_SURF}",
)(_between(tau_mode="relative"))


def _aligned(tau, **options):
    def run(spark, sf_dir):
        v = valid_objects(spark, sf_dir)
        v = S.box_anchor(v) if options.get("tau_mode") else v
        return S.triples(v).where(G.aligned_xy("a", "b", "c", tau, **options)).select("scene_id", "object_a", "object_b", "object_c", F.round(G.line_distance_xy(*(("c", "a", "b") if options.get("pivot") != "middle" else ("b", "a", "c"))), 6).alias("d"))

    return run


_ABC = "FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.ord < b.ord JOIN v c ON c.scene_id = b.scene_id AND b.ord < c.ord"
_TRIP = "SELECT a.scene_id, a.object_id AS object_a, b.object_id AS object_b, c.object_id AS object_c"
_LAST, _MID = segment_sql("c", "a", "b"), segment_sql("b", "a", "c")
query("aligned_v1", f"{objects_sql()} {_TRIP}, round({_LAST['line']}, 6) AS d {_ABC} WHERE {_LAST['line']} <= 0.25")(_aligned(0.25))
query("aligned_middle", f"{objects_sql()} {_TRIP}, round({_MID['line']}, 6) AS d {_ABC} WHERE {_MID['len2']} > 1e-12 AND {_MID['line']} <= 0.25")(_aligned(0.25, pivot="middle", degenerate="false"))
query("aligned_relative_aabb", f"{_BOXED} {_TRIP}, round({_MID['line']}, 6) AS d {_ABC.replace('v ', 'w ')} WHERE sqrt({_MID['len2']}) >= 1e-6 AND {_MID['line']} <= 0.05 * sqrt({_MID['len2']})")(
    _aligned(0.05, pivot="middle", tau_mode="relative")
)

_SHELVES = objects_sql(SHELF)


@query("above_pairs", f"{_SHELVES} SELECT a.scene_id, a.object_id AS object_a, b.object_id AS object_b, round(a.aabb_min_z - b.aabb_max_z, 6) AS gap_z, a.aabb_min_z >= b.aabb_max_z AS is_above FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.ord <> b.ord")
def above_pairs(spark, sf_dir):
    v = valid_objects(spark, sf_dir, shelf=SHELF)
    return S.above_pairs(v).select("scene_id", "object_a", "object_b", F.round("gap_z", 6).alias("gap_z"), "is_above")


@query("above_missing", f"{_SHELVES} SELECT a.object_id AS object_a, b.object_id AS object_b, va.aabb_min_z >= vb.aabb_max_z AS is_above FROM obj a JOIN obj b ON b.instance_id_raw = a.instance_id_raw + 1 LEFT JOIN v va ON va.object_id = a.object_id LEFT JOIN v vb ON vb.object_id = b.object_id")
def above_missing(spark, sf_dir):
    o = objects(spark, sf_dir, shelf=SHELF)
    a = o.select(F.col("object_id").alias("object_a"), (F.col("instance_id_raw") + 1).alias("i"))
    q = a.join(o.select(F.col("object_id").alias("object_b"), F.col("instance_id_raw").alias("i")), "i").drop("i")
    return S.answer_above(q, O.valid(o)).select("object_a", "object_b", "is_above")


TARGETS = ["chair", "sofa", "bed"]


def _candidates(spark, sf_dir, exclude=True):
    v = valid_objects(spark, sf_dir)
    c = S.reference_candidates(v, F.col("label_norm").isin(REFS), TARGETS, exclude).withColumn("centroid_distance", G.distance_3d("a", "b"))
    return c, clouds(spark, sf_dir, v)


_C = f"FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.object_id <> b.object_id AND a.label_norm IN {_IN(REFS)} AND b.label_norm IN {_IN(TARGETS)}"
_CS = f"{_C} JOIN surf s ON s.object_a = a.object_id AND s.object_b = b.object_id"
_KEY = "a.scene_id, a.object_id AS object_a, b.label_norm AS label_b"


@query("nearest_surface", f"{objects_sql()}{SURFACE_SQL}, r AS (SELECT {_KEY}, b.object_id AS id, s.d, row_number() OVER (PARTITION BY a.object_id, b.label_norm ORDER BY s.d, b.ord) AS rn {_CS}) SELECT scene_id, object_a, label_b, id AS answer_object, round(d, 6) AS answer_distance FROM r WHERE rn = 1")
def nearest_surface(spark, sf_dir):
    """Candidates whose boxes are too far away go before a point is read."""
    v = valid_objects(spark, sf_dir)
    near = S.reachable(S.reference_candidates(v, F.col("label_norm").isin(REFS), TARGETS, extra=("box",)))
    return S.nearest(S.surface_distance(near, clouds(spark, sf_dir, v)), "surface_distance").withColumn("answer_distance", F.round("answer_distance", 6))


@query("nearest_centroid", f"{objects_sql()}, r AS (SELECT {_KEY}, b.object_id AS id, {distance_sql('a', 'b')} AS d, row_number() OVER (PARTITION BY a.object_id, b.label_norm ORDER BY {distance_sql('a', 'b')}, b.ord) AS rn {_C}) SELECT scene_id, object_a, label_b, id AS answer_object, round(d, 6) AS answer_distance FROM r WHERE rn = 1")
def nearest_centroid(spark, sf_dir):
    return S.nearest(_candidates(spark, sf_dir)[0], "centroid_distance").withColumn("answer_distance", F.round("answer_distance", 6))


@query("nearest_same_category", f"{objects_sql()}, r AS (SELECT a.scene_id, a.object_id AS object_a, b.label_norm AS label_b, b.object_id AS id, {distance_sql('a', 'b')} AS d, row_number() OVER (PARTITION BY a.object_id, b.label_norm ORDER BY {distance_sql('a', 'b')}, b.ord) AS rn FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.label_norm IN {_IN(TARGETS)} AND b.label_norm IN {_IN(TARGETS)}) SELECT scene_id, object_a, label_b, id AS answer_object, round(d, 6) AS answer_distance FROM r WHERE rn = 1")
def nearest_same_category(spark, sf_dir):
    """The candidate scope that keeps the reference itself: it is its own nearest in its category."""
    v = valid_objects(spark, sf_dir)
    c = S.reference_candidates(v, F.col("label_norm").isin(TARGETS), TARGETS, exclude_reference=False).withColumn("d", G.distance_3d("a", "b"))
    return S.nearest(c, "d").withColumn("answer_distance", F.round("answer_distance", 6))


@query("nearest_divergence", f"{objects_sql()}{SURFACE_SQL}, r AS (SELECT {_KEY}, list(b.object_id ORDER BY {distance_sql('a', 'b')}, b.ord) AS by_c, list(b.object_id ORDER BY s.d, b.ord) AS by_s {_CS} GROUP BY ALL) SELECT scene_id, object_a, label_b, array_to_string(by_c, ',') AS by_centroid, array_to_string(by_s, ',') AS by_surface, by_c[1] = by_s[1] AS winner_same FROM r")
def nearest_divergence(spark, sf_dir):
    c, p = _candidates(spark, sf_dir)
    out = S.ranking(S.surface_distance(c, p))
    return out.withColumns({k: F.array_join(k, ",") for k in ("by_centroid", "by_surface")})


@query("nearest_margin", f"""{objects_sql()}{SURFACE_SQL}, r AS (SELECT {_KEY}, b.object_id AS id, s.d, row_number() OVER (PARTITION BY a.object_id, b.label_norm ORDER BY s.d, b.ord) AS rn {_CS})
    SELECT f.scene_id, f.object_a, f.label_b, f.id AS answer_object, g.id AS second_object, round(f.d, 6) AS answer_distance, round(g.d - f.d, 6) AS margin
    FROM r f JOIN r g ON f.object_a = g.object_a AND f.label_b = g.label_b AND f.rn = 1 AND g.rn = 2 WHERE g.d - f.d >= 0.05""")
def nearest_margin(spark, sf_dir):
    c, p = _candidates(spark, sf_dir)
    m = S.margins(S.surface_distance(c, p), "surface_distance")
    return m.select("scene_id", "object_a", "label_b", "answer_object", "second_object", F.round("answer_distance", 6).alias("answer_distance"), F.round("margin", 6).alias("margin"))


@query("neighbors_3", f"{objects_sql()}, r AS (SELECT a.scene_id, a.object_id AS object_a, b.object_id AS object_b, {distance_sql('a', 'b')} AS d, row_number() OVER (PARTITION BY a.object_id ORDER BY {distance_sql('a', 'b')}, b.ord) AS rank FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.ord <> b.ord) SELECT scene_id, object_a, rank, object_b, round(d, 6) AS centroid_distance FROM r WHERE rank <= 3")
def neighbors_3(spark, sf_dir):
    return S.neighbours(valid_objects(spark, sf_dir)).withColumn("centroid_distance", F.round("centroid_distance", 6))


def _third(k, names):
    s = f"(centroid_{k} - min(centroid_{k}) OVER w) / nullif(max(centroid_{k}) OVER w - min(centroid_{k}) OVER w, 0)"
    return f"CASE WHEN {s} < 1.0 / 3 THEN '{names[0]}' WHEN {s} < 2.0 / 3 THEN '{names[1]}' WHEN {s} IS NOT NULL THEN '{names[2]}' ELSE '{names[1]}' END"


_X, _Y, _Z = (_third(k, n) for k, n in (("x", ("left", "center", "right")), ("y", ("front", "middle", "back")), ("z", ("low", "mid-height", "high"))))


@query("relative_position", f"""{objects_sql()}, n AS (SELECT a.object_id, b.label_norm AS l, row_number() OVER (PARTITION BY a.object_id ORDER BY {distance_sql('a', 'b')}, b.ord) AS rk FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.ord <> b.ord),
    g AS (SELECT object_id, string_agg(l, ', ' ORDER BY rk) AS near FROM n WHERE rk <= 3 GROUP BY object_id),
    p AS (SELECT object_id, label_norm, instance_id_raw, {_X} AS pos_x, {_Y} AS pos_y, {_Z} AS pos_z FROM v WINDOW w AS (PARTITION BY scene_id))
    SELECT object_id, pos_x, pos_y, pos_z, printf('%s, object %d, %s side, %s area, %s', label_norm, instance_id_raw, pos_x, pos_y, pos_z) || coalesce(', near ' || near, '') AS description FROM p LEFT JOIN g USING (object_id)""")
def relative_position(spark, sf_dir):
    v = valid_objects(spark, sf_dir)
    label = v.select(F.col("object_id").alias("object_b"), F.col("label_norm").alias("l"))
    near = S.neighbours(v).join(label, "object_b").groupBy(F.col("object_a").alias("object_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "l"))), lambda s: s["l"]), ", ").alias("near"))
    text = F.concat(F.format_string("%s, object %d, %s side, %s area, %s", "label_norm", "instance_id_raw", "pos_x", "pos_y", "pos_z"), F.coalesce(F.concat(F.lit(", near "), "near"), F.lit("")))
    return O.relative_position(v).join(near, "object_id", "left").select("object_id", "pos_x", "pos_y", "pos_z", text.alias("description"))


_OBB = """, q AS (SELECT object_id, {q} FROM pts GROUP BY object_id),
    i AS (SELECT p.*, {inside} AS ok FROM pts p JOIN q USING (object_id)), c AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY object_id) AS n FROM i), k AS (SELECT * FROM c WHERE n < 10 OR ok),
    ax AS (SELECT object_id, avg(x) AS cx, avg(y) AS cy, 0.5 * atan2(2 * covar_samp(x, y), covar_samp(x, x) - covar_samp(y, y)) AS angle FROM k GROUP BY object_id),
    uv AS (SELECT k.object_id, cx, cy, angle, z, (x - cx) * cos(angle) + (y - cy) * sin(angle) AS u, -(x - cx) * sin(angle) + (y - cy) * cos(angle) AS vv FROM k JOIN ax USING (object_id))
    SELECT object_id, round(max(cx), 6) AS cx, round(max(cy), 6) AS cy, round(max(angle), 6) AS angle, round(max(u) - min(u), 6) AS length_u, round(max(vv) - min(vv), 6) AS length_v, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max FROM uv GROUP BY object_id""".format(
    q=", ".join(f"quantile_cont({k}, 0.05) AS lo_{k}, quantile_cont({k}, 0.95) AS hi_{k}" for k in "xyz"), inside=" AND ".join(f"{k} BETWEEN lo_{k} AND hi_{k}" for k in "xyz")
)


@query("oriented_boxes", objects_sql() + _OBB)
def oriented_boxes(spark, sf_dir):
    o = O.oriented_box(clouds(spark, sf_dir, objects(spark, sf_dir)), ["object_id"], least=10)
    r = lambda e, n: F.round(e, 6).alias(n)
    return o.select("object_id", r("cx", "cx"), r("cy", "cy"), r("angle", "angle"), r(F.col("u_max") - F.col("u_min"), "length_u"), r(F.col("v_max") - F.col("v_min"), "length_v"), r("z_min", "z_min"), r("z_max", "z_max"))


@query("box_edges", f"""{objects_sql()}, e(edge, i, j) AS (VALUES {', '.join(f'({n}, {i}, {j})' for n, (i, j) in enumerate(G.BOX_EDGES))}),
    k(n, a, b, c) AS (VALUES (0,0,0,0), (1,1,0,0), (2,1,1,0), (3,0,1,0), (4,0,0,1), (5,1,0,1), (6,1,1,1), (7,0,1,1)),
    p AS (SELECT object_id, n, CASE a WHEN 0 THEN aabb_min_x ELSE aabb_max_x END AS x, CASE b WHEN 0 THEN aabb_min_y ELSE aabb_max_y END AS y, CASE c WHEN 0 THEN aabb_min_z ELSE aabb_max_z END AS z FROM v, k)
    SELECT p.object_id, e.edge, {', '.join(f'round(p.{k}, 6) AS {k}0, round(q.{k}, 6) AS {k}1' for k in 'xyz')} FROM e JOIN p ON p.n = e.i JOIN p q ON q.n = e.j AND q.object_id = p.object_id""")
def box_edges(spark, sf_dir):
    edges = F.array(*[F.struct(F.lit(n).alias("edge"), F.lit(i).alias("i"), F.lit(j).alias("j")) for n, (i, j) in enumerate(G.BOX_EDGES)])
    c = valid_objects(spark, sf_dir).select("object_id", G.box_corners("aabb_min", "aabb_max").alias("c"), F.explode(edges).alias("e"))
    end = lambda n, k: F.round(F.get("c", F.col(f"e.{n}"))[k], 6)
    return c.select("object_id", "e.edge", *[end(n, k).alias(f"{k}{m}") for k in "xyz" for m, n in enumerate("ij")])


_SEGS = """WITH seg AS (SELECT c_nationkey AS scene_id, o_custkey AS instance_id_raw, o_orderkey AS seg_id FROM orders JOIN customer ON o_custkey = c_custkey),
    vx AS (SELECT l_orderkey AS seg_id, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem)"""


def _assembly(spark, sf_dir):
    """Lineitems as vertices, orders as segments, customers as instances, nations as scenes."""
    from .adapters import read

    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    groups = o.groupBy(F.col("c_nationkey").alias("scene_id"), F.col("o_custkey").alias("instance_id_raw")).agg(F.collect_list("o_orderkey").alias("segments")).withColumn("label_raw", F.lit("table"))
    of = o.select(F.col("o_orderkey").alias("seg_id"), F.col("c_nationkey").alias("scene_id"))
    line = read(spark, sf_dir, "lineitem").withColumn("vertex_idx", F.monotonically_increasing_id()).select(F.col("l_orderkey").alias("seg_id"), "vertex_idx", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))
    return line.join(of, "seg_id"), groups


@query("object_assembly", f"{_SEGS} SELECT scene_id, instance_id_raw, count(*)::INT AS n_points, round(avg(x), 6) AS centroid_x, round(avg(y), 6) AS centroid_y, round(avg(z), 6) AS centroid_z, round(max(x) - min(x), 6) AS extent_x FROM seg JOIN vx USING (seg_id) GROUP BY scene_id, instance_id_raw")
def object_assembly(spark, sf_dir):
    v, groups = _assembly(spark, sf_dir)
    # vertices carry their segment, so the vertex-to-segment join is the identity here
    listed = groups.select("scene_id", "instance_id_raw", F.explode(F.array_distinct("segments")).alias("seg_id"))
    m = O.measure(v.join(listed, ["scene_id", "seg_id"]), ["scene_id", "instance_id_raw"])
    return m.select("scene_id", "instance_id_raw", "n_points", *[F.round(c, 6).alias(c) for c in ("centroid_x", "centroid_y", "centroid_z", "extent_x")])


@query("segment_points", f"{_SEGS} SELECT scene_id, instance_id_raw, count(vx.seg_id) AS n_points FROM seg LEFT JOIN vx USING (seg_id) GROUP BY scene_id, instance_id_raw")
def segment_points(spark, sf_dir):
    v, groups = _assembly(spark, sf_dir)
    return O.segment_point_counts(v.select("scene_id", "vertex_idx", "seg_id"), groups)


@query("points_per_object", f"{objects_sql()} SELECT object_id, count(*) AS n, round(sum(x + y + z), 4) AS checksum FROM pts GROUP BY object_id")
def points_per_object(spark, sf_dir):
    return clouds(spark, sf_dir, objects(spark, sf_dir)).groupBy("object_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x") + F.col("y") + F.col("z")), 4).alias("checksum"))


