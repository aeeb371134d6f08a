"""Queries of evaluation: distance and nearest errors, binary metrics, sweeps, agreement, replies, decomposition, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import metrics as M
from ..functions import text as T
from ..operators import bootstrap as B
from ..operators import evaluation as E
from ..operators import objects as O
from ..operators import spatial as S
from .adapters import SURFACE_SQL, clouds, distance_sql, objects_sql, read, segment_sql, valid_objects
from .generating import ORACLE_SQL as ORACLE_CANDIDATES
from .geometry import REFS, TARGETS

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _pairs(spark, sf_dir):
    """Useful pairs with true (surface) and predicted (centroid) distance."""
    v = valid_objects(spark, sf_dir)
    d = S.surface_distance(S.pairs(v), clouds(spark, sf_dir, v))
    return d.withColumns({"truth": F.col("surface_distance"), "pred": G.distance_3d("a", "b")})


_P = f"{objects_sql()}{SURFACE_SQL}, e AS (SELECT a.scene_id, a.object_id AS object_a, b.object_id AS object_b, s.d AS truth, {distance_sql('a', 'b')} AS pred FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.ord < b.ord JOIN surf s ON s.object_a = a.object_id AND s.object_b = b.object_id)"
_ERR = "count(*) AS n, round(avg(abs(pred - truth)), 6) AS mae, round(median(abs(pred - truth)), 6) AS medae, round(sqrt(avg(pow(pred - truth, 2))), 6) AS rmse"
_round = lambda df, cols: df.withColumns({c: F.round(c, 6) for c in cols})


@query("eval_distance", f"{_P} SELECT scene_id, {_ERR} FROM e GROUP BY scene_id")
def eval_distance(spark, sf_dir):
    return _round(E.distance_errors(_pairs(spark, sf_dir), "pred", "truth", ["scene_id"]), ["mae", "medae", "rmse"])


@query("surface_vs_centroid", f"{_P} SELECT count(*) AS n, 0.0::DOUBLE AS mae_a, round(avg(abs(pred - truth)), 6) AS mae_b, 0.0::DOUBLE AS medae_a, round(median(abs(pred - truth)), 6) AS medae_b, round(avg(abs(pred - truth)), 6) AS mean_difference, count(*) FILTER (abs(pred - truth) > 0) AS b_worse FROM e")
def surface_vs_centroid(spark, sf_dir):
    return _round(E.compare(_pairs(spark, sf_dir), "surface_distance", "pred", "truth"), ["mae_a", "mae_b", "medae_a", "medae_b", "mean_difference"])


_RG = "CASE WHEN truth <= 1.5 THEN 'short' WHEN truth <= 3 THEN 'medium' ELSE 'long' END"


@query(
    "error_by_range",
    f"""{_P}, l AS (SELECT 'centroid' AS method, truth, pred FROM e UNION ALL SELECT 'partial', truth, CASE WHEN pred > 20 THEN NULL ELSE pred END FROM e)
    SELECT method, {_RG} AS "range", count(pred) AS n_valid, count(*) - count(pred) AS n_failed, round(avg(abs(pred - truth)), 6) AS mae, round(median(abs(pred - truth)), 6) AS medae, round(sqrt(avg(pow(pred - truth, 2))), 6) AS rmse, round(100 * avg(abs(pred - truth) / nullif(truth, 0)), 6) AS relative_pct FROM l GROUP BY ALL""",
)
def error_by_range(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("truth", "pred")
    both = p.withColumn("method", F.lit("centroid")).unionByName(p.withColumns({"method": F.lit("partial"), "pred": F.when(F.col("pred") <= 20, F.col("pred"))}))
    return _round(E.errors_by_range(both, "pred", "truth"), ["mae", "medae", "rmse", "relative_pct"])


@query(
    "method_summary",
    f"""{_P}, l AS (SELECT 'centroid' AS method, truth, pred FROM e UNION ALL SELECT 'partial', truth, CASE WHEN pred > 20 THEN NULL ELSE pred END FROM e)
    SELECT method, count(*) AS n, count(pred) AS n_valid, count(*) - count(pred) AS n_failed, round(avg(abs(pred - truth)), 6) AS mae, round(median(abs(pred - truth)), 6) AS medae, round(sqrt(avg(pow(pred - truth, 2))), 6) AS rmse FROM l GROUP BY method""",
)
def method_summary(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("truth", "pred")
    both = p.withColumn("method", F.lit("centroid")).unionByName(p.withColumns({"method": F.lit("partial"), "pred": F.when(F.col("pred") <= 20, F.col("pred"))}))
    return _round(E.method_summary(both, "pred", "truth"), ["mae", "medae", "rmse"])


def _nearest(spark, sf_dir):
    v = valid_objects(spark, sf_dir)
    c = S.reference_candidates(v, F.col("label_norm").isin(REFS), TARGETS).withColumn("centroid_distance", G.distance_3d("a", "b"))
    keys = ["scene_id", "object_a", "label_b"]
    s = S.nearest(S.surface_distance(c, clouds(spark, sf_dir, v)), "surface_distance").select(*keys, F.col("answer_object").alias("truth"))
    return s.join(S.nearest(c, "centroid_distance").select(*keys, F.col("answer_object").alias("pred")), keys)


_NR = f"""{objects_sql()}{SURFACE_SQL}, r AS (SELECT a.scene_id, a.object_id AS object_a, b.label_norm AS label_b, b.object_id AS id, row_number() OVER (PARTITION BY a.object_id, b.label_norm ORDER BY s.d, b.ord) AS rs, row_number() OVER (PARTITION BY a.object_id, b.label_norm ORDER BY {distance_sql('a', 'b')}, b.ord) AS rc
        FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.object_id <> b.object_id AND a.label_norm IN {_IN(REFS)} AND b.label_norm IN {_IN(TARGETS)} JOIN surf s ON s.object_a = a.object_id AND s.object_b = b.object_id),
    e AS (SELECT scene_id, object_a, label_b, max(id) FILTER (rs = 1) AS truth, max(id) FILTER (rc = 1) AS pred FROM r GROUP BY ALL)"""


@query("eval_nearest", f"{_NR} SELECT label_b, count(*) AS n, round(avg((pred = truth)::INT), 6) AS top1, 1.0::DOUBLE AS parse_rate FROM e GROUP BY label_b")
def eval_nearest(spark, sf_dir):
    return _nearest(spark, sf_dir).groupBy("label_b").agg(F.count("*").alias("n"), F.round(M.top1(F.col("pred"), F.col("truth")), 6).alias("top1"), M.parse_rate(F.col("pred")).alias("parse_rate"))


@query("nearest_failures", f"{_NR} SELECT * FROM e WHERE pred <> truth")
def nearest_failures(spark, sf_dir):
    return E.failures(_nearest(spark, sf_dir), "pred", "truth")


_SCORES = """round((tp + tn) / nullif(n, 0)::DOUBLE, 6) AS accuracy, coalesce(round(tp / nullif(tp + fp, 0)::DOUBLE, 6), 0) AS precision, coalesce(round(tp / nullif(tp + fn, 0)::DOUBLE, 6), 0) AS recall,
    coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6), 0) AS f1"""
_CELLS = "count(*) AS n, count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 0) AS tn, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p = 0) AS fn"
_SC = ["accuracy", "precision", "recall", "f1"]


@query("eval_binary", f"WITH e AS (SELECT event_type AS operator, (event_id % 3 = 0)::INT AS t, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (value > 20)::INT END AS p FROM events), c AS (SELECT coalesce(operator, 'overall') AS operator, {_CELLS} FROM e GROUP BY GROUPING SETS ((), (operator))) SELECT *, {_SCORES} FROM c")
def eval_binary(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("operator"), (F.col("event_id") % 3 == 0).cast("int").alias("t"), F.when(F.col("event_id") % 11 != 0, (F.col("value") > 20).cast("int")).alias("p"))
    return _round(E.binary_metrics(e, "p", "t"), _SC)


@query("eval_labels", f"WITH e AS (SELECT quality AS t, toxic AS p FROM labels), c AS (SELECT {_CELLS} FROM e) SELECT 'overall' AS operator, *, {_SCORES} FROM c")
def eval_labels(spark, sf_dir):
    e = read(spark, sf_dir, "labels").select(F.lit("labels").alias("operator"), F.col("quality").alias("t"), F.col("toxic").alias("p"))
    return _round(E.binary_metrics(e, "p", "t").where("operator = 'overall'"), _SC)


_TAUS = {"between": [1.0, 2.0, 2.5, 3.0, 4.0, 5.0], "aligned": [0.10, 0.15, 0.20, 0.25, 0.30, 0.40]}
_GX, _GC = segment_sql("x", "a", "b"), segment_sql("c", "a", "b")
_TV = ", ".join(f"('{o}', {t}::DOUBLE)" for o, ts in _TAUS.items() for t in ts)


@query(
    "tau_sweep",
    f"""{objects_sql()}, g AS (SELECT 'between' AS operator, {_GX['t']} AS pos, {_GX['d']} AS d, (x.ord % 2)::INT AS t FROM v x JOIN v a ON a.scene_id = x.scene_id JOIN v b ON b.scene_id = a.scene_id AND a.ord < b.ord WHERE x.label_norm IN {_IN(T.FURNITURE)} AND a.label_norm IN {_IN(T.SURFACES)} AND b.label_norm IN {_IN(T.SURFACES)}
        UNION ALL SELECT 'aligned', 0.0, {_GC['line']}, (c.ord % 2)::INT FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.ord < b.ord JOIN v c ON c.scene_id = b.scene_id AND b.ord < c.ord),
    taus(operator, tau) AS (VALUES {_TV}), e AS (SELECT operator, tau, t, (d <= tau AND pos BETWEEN 0 AND 1)::INT AS p FROM g JOIN taus USING (operator)), c AS (SELECT operator, tau, {_CELLS} FROM e GROUP BY operator, tau) SELECT *, {_SCORES} FROM c""",
)
def tau_sweep(spark, sf_dir):
    v = valid_objects(spark, sf_dir)
    b = S.between_triples(v, F.col("label_norm").isin(T.FURNITURE), F.col("label_norm").isin(T.SURFACES)).select(F.lit("between").alias("operator"), G.segment_position_xy("x", "a", "b").alias("pos"), G.segment_distance_xy("x", "a", "b").alias("d"), (F.col("ord_x") % 2).alias("t"))
    a = S.triples(v).select(F.lit("aligned").alias("operator"), F.lit(0.0).alias("pos"), G.line_distance_xy("c", "a", "b").alias("d"), (F.col("ord_c") % 2).alias("t"))
    return _round(E.threshold_sweep(b.unionByName(a), "d", "t", _TAUS, F.col("pos").between(0, 1)), _SC)


# Three raters: the quality label, the toxic label turned round, and one who misses every seventh item.
_RATERS = "WITH r AS (SELECT doc_id, quality AS a1, 1 - toxic AS a2, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 5 > 0)::INT END AS a3, (doc_id % 3 > 0)::INT AS truth FROM labels), l AS (SELECT doc_id, unnest(['a1', 'a2', 'a3']) AS rater, unnest([a1, a2, a3]) AS vote FROM r), w AS (SELECT * FROM l WHERE vote IS NOT NULL)"


def _raters(spark, sf_dir):
    d = F.col("doc_id")
    return read(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("int").alias("a1"), (1 - F.col("toxic")).cast("int").alias("a2"), F.when(d % 7 != 0, (d % 5 > 0).cast("int")).alias("a3"), (d % 3 > 0).cast("int").alias("truth")
    )


@query(
    "kappa_pairs",
    f"""{_RATERS}, p AS (SELECT x.rater AS rater_a, y.rater AS rater_b, count(*) AS n, avg((x.vote = y.vote)::INT) AS po, avg(x.vote) AS pa, avg(y.vote) AS pb FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.rater < y.rater GROUP BY ALL)
    SELECT rater_a, rater_b, n, round(CASE WHEN pa * pb + (1 - pa) * (1 - pb) >= 1 THEN 1 ELSE (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END, 6) AS kappa FROM p""",
)
def kappa_pairs(spark, sf_dir):
    return _round(E.kappa_pairs(E.long_votes(_raters(spark, sf_dir), "doc_id", ["a1", "a2", "a3"]), "doc_id"), ["kappa"])


@query("rater_accuracy", f"{_RATERS} SELECT rater, count(*) AS n, round(avg((vote = truth)::INT), 6) AS accuracy FROM w JOIN r USING (doc_id) GROUP BY rater")
def rater_accuracy(spark, sf_dir):
    r = _raters(spark, sf_dir)
    return _round(E.rater_accuracy(E.long_votes(r, "doc_id", ["a1", "a2", "a3"]), r.select("doc_id", "truth"), "doc_id"), ["accuracy"])


@query("majority_vote", f"{_RATERS} SELECT doc_id, CASE WHEN a1 + a2 + coalesce(a3, 0) > (2 + (a3 IS NOT NULL)::INT) / 2.0 THEN 1 ELSE 0 END AS majority, -1 AS nobody FROM r")
def majority_vote(spark, sf_dir):
    none = F.lit(None).cast("int")
    return _raters(spark, sf_dir).select("doc_id", M.majority([F.col(c) for c in ("a1", "a2", "a3")]).alias("majority"), M.majority([none, none]).alias("nobody"))


@query(
    "grounding_decomposition",
    f"""{_P}, q AS (SELECT *, (regexp_extract(object_a, '([0-9]+)$', 1)::INT + regexp_extract(object_b, '([0-9]+)$', 1)::INT) % 3 AS k FROM e)
    SELECT count(*) AS n, count(*) FILTER (k <> 1) AS n_computed, round(avg((k = 0)::INT), 6) AS grounding_accuracy, round(avg(CASE k WHEN 0 THEN abs(pred - truth) WHEN 2 THEN abs(pred + 1 - truth) END), 6) AS mae_total, round(avg(abs(pred - truth)), 6) AS mae_geometric,
           round(avg(CASE k WHEN 0 THEN abs(pred - truth) WHEN 2 THEN abs(pred + 1 - truth) END) - avg(abs(pred - truth)), 6) AS delta_grounding FROM q""",
)
def grounding_decomposition(spark, sf_dir):
    """Replies that ground a pair rightly (in either order), not at all, or wrongly with an error of one metre more."""
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("int")
    p = _pairs(spark, sf_dir).withColumn("k", (number("object_a") + number("object_b")) % 3)
    reply = F.when(F.col("k") == 0, F.concat("object_b", F.lit(", "), "object_a")).when(F.col("k") == 1, "I cannot tell").otherwise(F.concat("object_a", F.lit("; "), "object_a"))
    p = p.withColumn("ids", T.extract_ids(reply, F.array("object_a", "object_b"), 2))
    p = p.withColumn("grounded", T.unordered_match(F.col("ids")[0], F.col("ids")[1], F.col("object_a"), F.col("object_b")))
    p = p.withColumn("total", F.when(F.col("grounded"), F.col("pred")).when(F.col("ids")[0].isNotNull(), F.col("pred") + 1))
    return _round(E.decompose(p, "total", "pred", "truth", "grounded"), ["grounding_accuracy", "mae_total", "mae_geometric", "delta_grounding"])


# ---- Bootstrap and draws: random numbers are functions of their place, so SQL repeats them ----

_PAIRS60 = ORACLE_CANDIDATES["candidates_distance"].rpartition("SELECT scene_id, 'distance' AS operator")[0]
_CI = f"""{_PAIRS60}, n AS (SELECT object_id, count(*) AS n FROM pts GROUP BY object_id),
    pw AS (SELECT k, list_reduce(list_transform(range(0, k), lambda z: CAST({B.FACTOR} AS BIGINT)), lambda x, y: (x * y) % {B.MODULUS}) AS w FROM (SELECT unnest(range(1, (SELECT 2 * max(n) FROM n) + 1)) AS k)),
    pr AS (SELECT DISTINCT object_a, object_b, a.n AS na, b.n AS nb FROM top JOIN n a ON a.object_id = object_a JOIN n b ON b.object_id = object_b),
    st AS (SELECT *, CAST('0x' || substr(md5('42|' || object_a || '|' || object_b || '|' || rep), 1, 7) AS BIGINT) + 1 AS start FROM pr, (SELECT unnest(range(0, 1000)) AS rep)),
    da AS (SELECT DISTINCT object_a, object_b, rep, (start * w) % {B.MODULUS} % na AS i FROM st JOIN pw ON k <= na),
    db AS (SELECT DISTINCT object_a, object_b, rep, (start * w) % {B.MODULUS} % nb AS j FROM st JOIN pw ON k > na AND k <= na + nb),
    d AS (SELECT object_a, object_b, p.pt_idx AS i, q.pt_idx AS j, pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) AS d FROM pr JOIN pts p ON p.object_id = object_a JOIN pts q ON q.object_id = object_b),
    lo AS (SELECT object_a, object_b, rep, sqrt(min(d)) AS low FROM da JOIN db USING (object_a, object_b, rep) JOIN d USING (object_a, object_b, i, j) GROUP BY ALL),
    pt AS (SELECT object_a, object_b, sqrt(min(d)) AS point FROM d GROUP BY ALL),
    ci AS (SELECT object_a, object_b, point, avg(low) AS mean, stddev_pop(low) AS std, quantile_cont(low, 0.025) AS ci_low, quantile_cont(low, 0.975) AS ci_high FROM lo JOIN pt USING (object_a, object_b) GROUP BY ALL),
    w AS (SELECT *, ci_high - ci_low AS ci_width, CASE WHEN point > 0 THEN (ci_high - ci_low) / point * 100 END AS ci_width_pct FROM ci)"""
_CI_COLS = ["point", "mean", "std", "ci_low", "ci_high", "ci_width", "ci_width_pct"]


def _intervals(spark, sf_dir):
    from ..operators.candidates import distance_candidates

    v = valid_objects(spark, sf_dir)
    p = clouds(spark, sf_dir, v)
    return B.distance_ci(distance_candidates(v, p), p)


@query("bootstrap_distance", f"{_CI} SELECT object_a, object_b, {', '.join(f'round({c}, 6) AS {c}' for c in _CI_COLS)} FROM w")
def bootstrap_distance(spark, sf_dir):
    """Clouds have 21 points, under the cap of 2000, so whole clouds are resampled."""
    return _round(_intervals(spark, sf_dir), _CI_COLS)


@query("bootstrap_summary", f"{_CI} SELECT count(*) AS n, round(avg(ci_width), 6) AS mean_width, round(median(ci_width), 6) AS median_width, round(max(ci_width), 6) AS max_width, round(avg(ci_width_pct), 6) AS mean_width_pct FROM w")
def bootstrap_summary(spark, sf_dir):
    return _round(B.summarise(_intervals(spark, sf_dir)), ["mean_width", "median_width", "max_width", "mean_width_pct"])


_ASKED = f"""{objects_sql()}, cd AS (SELECT a.object_id AS object_a, b.label_norm AS label_b, b.object_id AS object_b, b.ord AS ord_b, {distance_sql('a', 'b')} AS cd
        FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.object_id <> b.object_id WHERE a.label_norm IN {_IN(REFS)} AND b.label_norm IN {_IN(TARGETS)})"""
_NEAR = f"""{_ASKED}, np AS (SELECT object_a, label_b, object_b, ord_b, p.pt_idx AS pt_a, q.pt_idx AS pt_b, pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) AS d2 FROM cd JOIN pts p ON p.object_id = object_a JOIN pts q ON q.object_id = object_b)"""
_STABILITY = f"""{_NEAR}, least AS (SELECT object_a, label_b, pt_a, object_b, ord_b, d2 FROM np QUALIFY row_number() OVER (PARTITION BY object_a, label_b, pt_a ORDER BY d2, ord_b, pt_b) = 1),
    pl AS (SELECT *, row_number() OVER (PARTITION BY object_a, label_b ORDER BY d2, ord_b, pt_a) AS i, CAST(count(*) OVER (PARTITION BY object_a, label_b) AS DOUBLE) AS n FROM least),
    sh AS (SELECT object_a, label_b, object_b, round(sum(pow((n - i + 1) / n, n) - pow((n - i) / n, n)), 12) AS share, min(i) = 1 AS first FROM pl GROUP BY ALL),
    al AS (SELECT cd.*, coalesce(share, 0) AS share, coalesce(first, false) AS first FROM cd LEFT JOIN sh USING (object_a, label_b, object_b)),
    sb AS (SELECT object_a, label_b, count(*) AS n_candidates, max(object_b) FILTER (first) AS point_winner, first(object_b ORDER BY cd, ord_b) AS gt_winner, first(share ORDER BY cd, ord_b) AS gt_stability,
           first(object_b ORDER BY share DESC, ord_b) AS boot_winner, max(share) AS boot_winner_stability FROM al GROUP BY object_a, label_b)"""


def _stability(spark, sf_dir):
    v = valid_objects(spark, sf_dir)
    c = S.reference_candidates(v, F.col("label_norm").isin(REFS), TARGETS)
    answers = S.nearest(c.withColumn("d", G.distance_3d("a", "b")), "d").select("object_a", "label_b", F.col("answer_object").alias("gt_winner"))
    return B.nearest_stability(c, clouds(spark, sf_dir, v), answers)


@query("bootstrap_nearest", f"{_STABILITY} SELECT object_a, label_b, n_candidates, point_winner, gt_winner, point_winner = gt_winner AS gt_correct_point, round(gt_stability, 6) AS gt_stability, boot_winner, round(boot_winner_stability, 6) AS boot_winner_stability FROM sb")
def bootstrap_nearest(spark, sf_dir):
    """The given answers are those by centroid distance, so that some are not the nearest by surface."""
    return _round(_stability(spark, sf_dir), ["gt_stability", "boot_winner_stability"])


@query("bootstrap_nearest_summary", f"{_STABILITY} SELECT count(*) AS n, round(avg(gt_stability), 6) AS mean_stability, round(median(gt_stability), 6) AS median_stability, round(min(gt_stability), 6) AS min_stability, count(*) FILTER (gt_stability >= 0.95) AS n_stable, count(*) FILTER (point_winner = gt_winner) AS n_correct FROM sb")
def bootstrap_nearest_summary(spark, sf_dir):
    return _round(B.summarise_nearest(_stability(spark, sf_dir)), ["mean_stability", "median_stability", "min_stability"])


@query("point_neighbours", f"{_NEAR} SELECT object_a, object_b, pt_a, pt_b, round(sqrt(d2), 6) AS distance_m FROM np QUALIFY row_number() OVER (PARTITION BY object_a, object_b, pt_a ORDER BY d2, pt_b) = 1")
def point_neighbours(spark, sf_dir):
    """For each point of a reference its nearest point of each candidate."""
    from ..operators.neighbours import point_neighbours as run

    v = valid_objects(spark, sf_dir)
    near = run(S.reference_candidates(v, F.col("label_norm").isin(REFS), TARGETS), clouds(spark, sf_dir, v))
    return near.select("object_a", "object_b", "pt_a", "pt_b", F.round(F.sqrt("d2"), 6).alias("distance_m"))


@query("stratified_sample", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_type || '|' || event_id), event_id) <= 10")
def stratified_sample(spark, sf_dir):
    """Ten events of each type, drawn by md5."""
    return O.stratified_sample(read(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], "event_id", 10)


@query("downsampled_points", f"{objects_sql()} SELECT object_id, pt_idx, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pts QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY md5('42|' || object_id || '|' || pt_idx), pt_idx) <= 8")
def downsampled_points(spark, sf_dir):
    """Which eight points of each cloud are drawn."""
    from .adapters import objects

    return _round(O.downsample(clouds(spark, sf_dir, objects(spark, sf_dir)), ["object_id"], "pt_idx", 8).drop("scene_id"), list("xyz"))
