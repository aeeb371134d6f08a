"""Queries that generate benchmark questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates as C
from ..operators import objects as O
from ..operators import questions as Q
from .adapters import SHELF, SURFACE_SQL, clouds, distance_sql, objects_sql, segment_sql, valid_objects

QUERIES: dict = {}
ORACLE_SQL: dict = {}
TAU_BETWEEN, TAU_ALIGN = 2.5, 0.25

_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_F, _S, _R, _ALL = _IN(T.FURNITURE), _IN(T.SURFACES), _IN(T.REFERENCES), _IN(T.CATEGORIES)


def _diverse(scope: str, key: str, order: str, source: str, fill: bool = True) -> str:
    """SQL CTEs: the two passes of the selection, first of each key, then all others in order."""
    return f""", f AS (SELECT *, row_number() OVER (PARTITION BY {scope}, {key} ORDER BY {order}) AS kn FROM {source}),
        g AS (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY (kn > 1)::INT, {order}) AS rank FROM f {'' if fill else 'WHERE kn = 1'}), top AS (SELECT * FROM g WHERE rank <= 3)"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


_USEFUL = f"a.label_norm <> b.label_norm AND ((a.label_norm IN {_F} AND b.label_norm IN {_IN(T.SURFACES + T.REFERENCES)}) OR (b.label_norm IN {_F} AND a.label_norm IN {_IN(T.SURFACES + T.REFERENCES)}) OR (a.label_norm IN {_S} AND b.label_norm IN {_R}) OR (b.label_norm IN {_S} AND a.label_norm IN {_R}))"


@query(
    "candidates_distance",
    f"""{objects_sql()}{SURFACE_SQL}, c AS (SELECT a.scene_id, a.object_id AS object_a, a.label_norm AS label_a, b.object_id AS object_b, b.label_norm AS label_b, a.ord AS oa, b.ord AS ob, round(s.d, 6) AS surface_distance_m, round({distance_sql('a', 'b')}, 6) AS centroid_distance_m
        FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.ord < b.ord JOIN surf s ON s.object_a = a.object_id AND s.object_b = b.object_id WHERE s.d BETWEEN 0.1 AND 5 AND {_USEFUL})
    {_diverse('scene_id', 'least(label_a, label_b), greatest(label_a, label_b)', 'surface_distance_m, oa, ob', 'c')}
    SELECT scene_id, 'distance' AS operator, object_a, label_a, object_b, label_b, surface_distance_m, centroid_distance_m, 'distance("' || object_a || '", "' || object_b || '")' AS structured_query,
           'qual a distância entre ' || object_a || ' e ' || object_b || '?' AS natural_query, 'candidate' AS status, rank FROM top""",
)
def candidates_distance(spark, sf_dir):
    v = valid_objects(spark, sf_dir)
    return C.distance_candidates(v, clouds(spark, sf_dir, v))


@query(
    "candidates_nearest",
    f"""{objects_sql()}{SURFACE_SQL}, r AS (SELECT a.scene_id, a.object_id AS ref, a.label_norm AS rl, a.ord AS oa, b.label_norm AS target, b.object_id AS id, s.d, row_number() OVER (PARTITION BY a.object_id, b.label_norm ORDER BY s.d, b.ord) AS rn
        FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.object_id <> b.object_id JOIN surf s ON s.object_a = a.object_id AND s.object_b = b.object_id WHERE a.label_norm IN {_IN(T.SURFACES + T.REFERENCES)} AND b.label_norm IN {_F}),
    c AS (SELECT f.scene_id, f.ref, f.rl, f.oa, f.target, f.id AS a1, g.id AS a2, f.d AS d1, g.d AS d2, round(g.d - f.d, 6) AS margin, CASE f.target WHEN 'chair' THEN 1 WHEN 'sofa' THEN 2 ELSE 3 END AS t FROM r f JOIN r g ON f.ref = g.ref AND f.target = g.target AND f.rn = 1 AND g.rn = 2 WHERE g.d - f.d >= 0.05)
    {_diverse('scene_id', 'ref, target', 'margin DESC, oa, t', 'c', False)}
    SELECT scene_id, 'nearest' AS operator, ref AS reference_object, rl AS reference_label, target AS target_category, a1 AS answer_object, round(d1, 6) AS answer_distance_m, a2 AS second_best_object, round(d2, 6) AS second_best_distance_m, margin AS margin_to_second_m,
           'nearest("' || ref || '", "' || target || '")' AS structured_query, 'qual objeto da categoria ' || target || ' está mais próximo de ' || ref || '?' AS natural_query, 'candidate' AS status, rank FROM top""",
)
def candidates_nearest(spark, sf_dir):
    v = valid_objects(spark, sf_dir)
    return C.nearest_candidates(v, clouds(spark, sf_dir, v))


_G = segment_sql("x", "a", "b")
_BETWEEN = f""", c AS (SELECT x.scene_id, x.object_id AS object_x, x.label_norm AS label_x, a.object_id AS object_a, a.label_norm AS label_a, b.object_id AS object_b, b.label_norm AS label_b, x.ord AS ox, a.ord AS oa, b.ord AS ob
        FROM v x JOIN v a ON a.scene_id = x.scene_id JOIN v b ON b.scene_id = a.scene_id AND a.ord < b.ord WHERE x.label_norm IN {_F} AND a.label_norm IN {_S} AND b.label_norm IN {_S} AND {_G['t']} BETWEEN 0 AND 1 AND {_G['d']} <= {TAU_BETWEEN})
    {_diverse('scene_id', 'object_x', 'ox, oa, ob', 'c')}"""
_BQ = """'between("' || object_x || '", "' || object_a || '", "' || object_b || '")' AS structured_query, object_x || ' está entre ' || object_a || ' e ' || object_b || '?' AS natural_query"""


@query("candidates_between", f"{objects_sql()}{_BETWEEN} SELECT scene_id, 'between' AS operator, object_x, label_x, object_a, label_a, object_b, label_b, {TAU_BETWEEN}::DOUBLE AS tau_between_m, {_BQ}, 'candidate' AS status, rank FROM top")
def candidates_between(spark, sf_dir):
    return C.between_candidates(valid_objects(spark, sf_dir), TAU_BETWEEN)


_H = segment_sql("c", "a", "b")
_ALIGNED = f""", k AS (SELECT a.scene_id, a.object_id AS object_a, a.label_norm AS label_a, b.object_id AS object_b, b.label_norm AS label_b, c.object_id AS object_c, c.label_norm AS label_c, a.ord AS oa, b.ord AS ob, c.ord AS oc,
        (a.label_norm <> b.label_norm AND a.label_norm <> c.label_norm AND b.label_norm <> c.label_norm)::INT AS mixed_bonus
        FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.ord < b.ord JOIN v c ON c.scene_id = b.scene_id AND b.ord < c.ord WHERE {_H['line']} <= {TAU_ALIGN})
    {_diverse('scene_id', "array_to_string(list_sort([label_a, label_b, label_c]), '|')", 'mixed_bonus DESC, oa, ob, oc', 'k')}"""
_AQ = """'aligned("' || object_a || '", "' || object_b || '", "' || object_c || '")' AS structured_query, object_a || ', ' || object_b || ' e ' || object_c || ' estão alinhados?' AS natural_query"""


@query("candidates_aligned", f"{objects_sql()}{_ALIGNED} SELECT scene_id, 'aligned' AS operator, object_a, label_a, object_b, label_b, object_c, label_c, {TAU_ALIGN}::DOUBLE AS tau_align_m, mixed_bonus, {_AQ}, 'candidate' AS status, rank FROM top")
def candidates_aligned(spark, sf_dir):
    return C.aligned_candidates(valid_objects(spark, sf_dir), TAU_ALIGN)


@query(
    "negatives_between",
    f"""{objects_sql()}{_BETWEEN}, q AS (SELECT t.scene_id, t.object_x AS pos, t.object_a, t.object_b, 'between("' || t.object_x || '", "' || t.object_a || '", "' || t.object_b || '")' AS pairing_group FROM top t),
    n AS (SELECT q.scene_id, q.pairing_group, q.object_a, q.object_b, x.object_id AS object_x, x.label_norm AS label_x, row_number() OVER (PARTITION BY q.pairing_group ORDER BY x.ord) AS rn
        FROM q JOIN v a ON a.object_id = q.object_a JOIN v b ON b.object_id = q.object_b JOIN v x ON x.scene_id = q.scene_id AND x.object_id <> q.pos AND x.label_norm IN {_F} WHERE NOT ({_G['t']} BETWEEN 0 AND 1 AND {_G['d']} <= {TAU_BETWEEN}))
    SELECT scene_id, pairing_group, object_x, label_x, object_a, object_b, {_BQ}, 0 AS binary_label FROM n WHERE rn = 1""",
)
def negatives_between(spark, sf_dir):
    v = valid_objects(spark, sf_dir)
    return C.between_negatives(C.between_candidates(v, TAU_BETWEEN), v)


@query(
    "negatives_aligned",
    f"""{objects_sql()}{_ALIGNED}, q AS (SELECT scene_id, object_a, object_b, object_c AS pos, 'aligned("' || object_a || '", "' || object_b || '", "' || object_c || '")' AS pairing_group FROM top),
    n AS (SELECT q.scene_id, q.pairing_group, q.object_a, q.object_b, c.object_id AS object_c, c.label_norm AS label_c, row_number() OVER (PARTITION BY q.pairing_group ORDER BY c.ord) AS rn
        FROM q JOIN v a ON a.object_id = q.object_a JOIN v b ON b.object_id = q.object_b JOIN v c ON c.scene_id = q.scene_id AND c.object_id NOT IN (q.object_a, q.object_b, q.pos) WHERE NOT ({_H['line']} <= {TAU_ALIGN}))
    SELECT scene_id, pairing_group, object_a, object_b, object_c, label_c, {_AQ}, 0 AS binary_label FROM n WHERE rn = 1""",
)
def negatives_aligned(spark, sf_dir):
    v = valid_objects(spark, sf_dir)
    return C.aligned_negatives(C.aligned_candidates(v, TAU_ALIGN), v)


def _above(pos: bool) -> str:
    u, w, s = ("a", "b", "") if pos else ("b", "a", "-")
    return f"""SELECT scene_id, 'above' AS operator, pairing_group, pairing_group || '__{'pos' if pos else 'neg'}' AS binary_query_id, {u}_id AS object_a, {u}_l AS label_a, {w}_id AS object_b, {w}_l AS label_b, round({s}gap, 4) AS gap_z_m,
        round({u}_min, 4) AS aabb_min_z_a, round({w}_max, 4) AS aabb_max_z_b, 'above("' || {u}_id || '", "' || {w}_id || '")' AS structured_query, {u}_id || ' está acima de ' || {w}_id || '?' AS natural_query, {int(pos)} AS binary_label FROM p"""


@query(
    "above_examples",
    f"""{objects_sql(SHELF)}, r AS (SELECT a.scene_id, a.object_id AS a_id, a.label_norm AS a_l, b.object_id AS b_id, b.label_norm AS b_l, a.aabb_min_z AS a_min, a.aabb_max_z AS a_max, b.aabb_min_z AS b_min, b.aabb_max_z AS b_max, a.aabb_min_z - b.aabb_max_z AS gap,
        row_number() OVER (PARTITION BY a.scene_id ORDER BY a.aabb_min_z - b.aabb_max_z DESC, a.ord, b.ord) AS rk FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.ord <> b.ord WHERE a.aabb_min_z - b.aabb_max_z >= 0.1),
    p AS (SELECT *, printf('above_%s_%04d', scene_id, row_number() OVER (ORDER BY scene_id, rk) - 1) AS pairing_group FROM r WHERE rk <= 5)
    {_above(True)} UNION ALL {_above(False)}""",
)
def above_examples(spark, sf_dir):
    return C.above_examples(valid_objects(spark, sf_dir, shelf=SHELF))


def _aliased(spark, sf_dir):
    return O.aliases(valid_objects(spark, sf_dir))


_ALIAS = f"{objects_sql()}, al AS (SELECT *, label_norm || row_number() OVER (PARTITION BY scene_id, label_norm ORDER BY object_id) AS alias, row_number() OVER (PARTITION BY scene_id ORDER BY label_norm, object_id) AS number, (dense_rank() OVER (PARTITION BY scene_id ORDER BY label_norm) - 1) % 10 AS color_index FROM v)"


@query("alias_map", f"{_ALIAS} SELECT scene_id, alias, object_id, number, color_index FROM al")
def alias_map(spark, sf_dir):
    return _aliased(spark, sf_dir).select("scene_id", "alias", "object_id", "number", "color_index")


def _asked(spark, sf_dir):
    """Six questions an object, about it and the next two of its scene: one of each kind, one with an unknown name, one outside the grammar."""
    a = _aliased(spark, sf_dir)
    nxt = lambda n: a.select("scene_id", (F.col("number") - n).alias("number"), F.col("alias").alias(f"n{n}"))
    q = a.select("scene_id", "number", "alias").join(nxt(1), ["scene_id", "number"]).join(nxt(2), ["scene_id", "number"])
    forms = [
        ("d", F.format_string("  Qual a distância entre %s e %s? obrigado", "alias", "n1")),
        ("n", F.format_string("qual chair está mais próximo de %s?", "alias")),
        ("b", F.format_string("%s está entre %s e %s?", "alias", "n1", "n2")),
        ("a", F.format_string("%s, %s e %s estão alinhados?", "alias", "n1", "n2")),
        ("u", F.format_string("qual a distancia entre %s e ghost1?", "alias")),
        ("x", F.format_string("onde fica %s?", "alias")),
    ]
    each = F.explode(F.array(*[F.struct(F.concat(F.lit(k), F.col("number").cast("string")).alias("question_id"), t.alias("text")) for k, t in forms])).alias("e")
    return q.select("scene_id", each).select("scene_id", "e.*"), a


_NEXT = f"{_ALIAS}, q AS (SELECT x.scene_id, x.number, x.alias, x.object_id AS o0, y.object_id AS o1, z.object_id AS o2, y.alias AS n1, z.alias AS n2 FROM al x JOIN al y ON y.scene_id = x.scene_id AND y.number = x.number + 1 JOIN al z ON z.scene_id = x.scene_id AND z.number = x.number + 2)"


@query(
    "parse_nl_query",
    f"""{_NEXT} SELECT scene_id, 'd' || number AS question_id, 'distance' AS op, NULL AS x, alias AS a, n1 AS b, NULL AS c, NULL AS category FROM q
    UNION ALL SELECT scene_id, 'n' || number, 'nearest', NULL, alias, NULL, NULL, 'chair' FROM q UNION ALL SELECT scene_id, 'b' || number, 'between', alias, n1, n2, NULL, NULL FROM q
    UNION ALL SELECT scene_id, 'a' || number, 'aligned', NULL, alias, n1, n2, NULL FROM q UNION ALL SELECT scene_id, 'u' || number, 'distance', NULL, alias, 'ghost1', NULL, NULL FROM q
    UNION ALL SELECT scene_id, 'x' || number, NULL, NULL, NULL, NULL, NULL, NULL FROM q""",
)
def parse_nl_query(spark, sf_dir):
    return _asked(spark, sf_dir)[0].select("scene_id", "question_id", T.parse_query(F.col("text")).alias("q")).select("scene_id", "question_id", "q.*")


_GB, _GA = segment_sql("o0", "o1", "o2"), segment_sql("o2", "o0", "o1")
_JOIN3 = "JOIN v o0 ON o0.object_id = q.o0 JOIN v o1 ON o1.object_id = q.o1 JOIN v o2 ON o2.object_id = q.o2"


@query(
    "answer_nl_query",
    f"""{_NEXT}{SURFACE_SQL}, near AS (SELECT s.object_a, al.alias, s.d, row_number() OVER (PARTITION BY s.object_a ORDER BY s.d, al.ord) AS rn FROM surf s JOIN al ON al.object_id = s.object_b AND al.label_norm = 'chair')
    SELECT q.scene_id, 'd' || number AS question_id, 'distance' AS op, printf('%.4f m', s.d) AS answer FROM q JOIN surf s ON s.object_a = q.o0 AND s.object_b = q.o1
    UNION ALL SELECT q.scene_id, 'n' || number, 'nearest', CASE WHEN n.alias IS NULL THEN '{Q.NO_CANDIDATE}' ELSE printf('%s, %.4f m', n.alias, n.d) END FROM q LEFT JOIN near n ON n.object_a = q.o0 AND n.rn = 1
    UNION ALL SELECT q.scene_id, 'b' || number, 'between', CASE WHEN {_GB['t']} BETWEEN 0 AND 1 AND {_GB['d']} <= 0.3 THEN 'sim' ELSE 'não' END FROM q {_JOIN3}
    UNION ALL SELECT q.scene_id, 'a' || number, 'aligned', CASE WHEN {_GA['line']} <= 0.25 THEN 'sim' ELSE 'não' END FROM q {_JOIN3}
    UNION ALL SELECT scene_id, 'u' || number, 'distance', '{Q.UNKNOWN}' FROM q UNION ALL SELECT scene_id, 'x' || number, 'none', '{Q.OUTSIDE}' FROM q""",
)
def answer_nl_query(spark, sf_dir):
    q, a = _asked(spark, sf_dir)
    return Q.answer(q, a, clouds(spark, sf_dir, a))
