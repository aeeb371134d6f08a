"""Edge cases with values by hand, properties, and plans."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import metrics as M
from plumbline.functions import text as T
from plumbline.operators import bootstrap as B
from plumbline.operators import candidates as C
from plumbline.operators import evaluation as E
from plumbline.operators import frames as R
from plumbline.operators import objects as O
from plumbline.operators import relational as L
from plumbline.operators import scenes as S
from plumbline.operators import spatial as P

XY = "x_x double, x_y double, a_x double, a_y double, b_x double, b_y double"


@pytest.mark.parametrize(
    ("points", "t", "d", "line", "between", "never"),
    [
        ((0, 0, 0, 0, 4, 0), 0.0, 0.0, 0.0, True, True),  # at an end
        ((4, 0, 0, 0, 4, 0), 1.0, 0.0, 0.0, True, True),  # at the other
        ((2, 1, 0, 0, 4, 0), 0.5, 1.0, 1.0, True, True),  # exactly tau away
        ((2, 1.0001, 0, 0, 4, 0), 0.5, 1.0001, 1.0001, False, False),
        ((5, 0, 0, 0, 4, 0), 1.25, 1.0, 0.0, False, False),  # beyond an end, though near it
        ((1, 0, 1, 1, 1, 1), 0.0, 1.0, 1.0, True, False),  # coinciding ends
        ((3, 1, 1, 1, 1, 1), 0.0, 2.0, 2.0, False, False),
    ],
)
def test_segment_edges(spark, points, t, d, line, between, never):
    row = spark.createDataFrame([tuple(map(float, points))], XY).select(
        G.segment_position_xy("x", "a", "b"), G.segment_distance_xy("x", "a", "b"), G.line_distance_xy("x", "a", "b"), G.between_xy("x", "a", "b", 1.0), G.between_xy("x", "a", "b", 1.0, degenerate="false")
    ).first()
    assert [pytest.approx(v) for v in row[:3]] == [t, d, line] and (row[3], row[4]) == (between, never)


def test_alignment_is_not_symmetric_and_relative_tau(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, 10.0, 1.0)], "a_x double, a_y double, b_x double, b_y double, c_x double, c_y double")
    r = df.select(G.aligned_xy("a", "b", "c", 0.25), G.aligned_xy("a", "b", "c", 0.25, pivot="middle"), G.aligned_xy("a", "b", "c", 0.02, pivot="middle", tau_mode="relative")).first()
    assert tuple(r) == (False, True, True)
    assert spark.range(1).select(G.above(F.lit(1.0), F.lit(1.0)), G.above(F.lit(None).cast("double"), F.lit(1.0))).first()[:] == (True, None)


def scene(spark, seed=1, n=9, k=12):
    rng = random.Random(seed)
    labels = ["chair", "table", "sofa", "door", "desk"]
    rows = []
    for i in range(n):
        c = [rng.uniform(0, 6) for _ in range(3)]
        rows += [("s1_00", i, labels[i % 5], j, *[x + rng.uniform(-1, 1) for x in c]) for j in range(k)]
    points = spark.createDataFrame(rows, "scene_id string, instance_id_raw int, label_raw string, pt_idx int, x double, y double, z double")
    objects = O.manifest(points, 3, 3)
    cloud = points.join(objects.select("instance_id_raw", "object_id"), "instance_id_raw").select("object_id", "pt_idx", "x", "y", "z")
    return objects, cloud


def test_surface_distance_strategies_and_properties(spark):
    objects, cloud = scene(spark)
    pts = {}
    for r in cloud.collect():
        pts.setdefault(r.object_id, []).append((r.x, r.y, r.z))
    brute = lambda a, b: min(sum((u - v) ** 2 for u, v in zip(p, q, strict=True)) ** 0.5 for p in pts[a] for q in pts[b])
    pairs = P.pairs(objects, ordered=True)
    got = {}
    for strategy, options in (("exploded", {}), ("pruned", {}), ("pruned", {"prune_above": 0}), ("inplace", {}), ("inplace", {"prune_above": 0}), ("arrow", {}), ("grid", {}), ("scene", {})):
        got[strategy] = {(r.object_a, r.object_b): r.surface_distance for r in P.surface_distance(pairs, cloud, strategy, **options).collect()}
        assert len(got[strategy]) == 72 and all(abs(d - brute(*k)) < 1e-9 for k, d in got[strategy].items())
    assert all(abs(d - got["pruned"][b, a]) < 1e-12 for (a, b), d in got["pruned"].items())
    gap = P.pairs(objects, ordered=True, extra=("box",)).select("object_a", "object_b", G.box_gap("a", "b").alias("g")).collect()
    assert all(r.g <= got["pruned"][r.object_a, r.object_b] + 1e-12 for r in gap)


def test_ties_go_to_the_first_in_order(spark):
    c = spark.createDataFrame([("s", "r", "chair", 3, "c3", 1.0), ("s", "r", "chair", 2, "c2", 1.0), ("s", "r", "chair", 4, "c4", 0.5 + 0.5)], "scene_id string, object_a string, label_b string, ord_b int, object_b string, d double")
    assert P.nearest(c, "d").first().answer_object == "c2"


def test_diverse_top_k_equals_two_passes(spark):
    rng = random.Random(3)
    rows = [(s, rng.choice("abcde"), i, rng.random()) for s in range(30) for i in range(rng.randint(0, 9))]
    top = C.diverse_top_k(spark.createDataFrame(rows, "s int, k string, i int, v double"), ["s"], ["k"], [F.col("v"), F.col("i")], 3)
    got = sorted((r.s, r.rank, r.i) for r in top.collect())
    want = []
    for s in range(30):
        mine, used, picked = sorted((v, i, k) for t, k, i, v in rows if t == s), set(), []
        for row in mine:
            if row[2] not in used and len(picked) < 3:
                used.add(row[2])
                picked.append(row)
        picked += [row for row in mine if row not in picked][: 3 - len(picked)]
        want += [(s, n + 1, row[1]) for n, row in enumerate(picked)]
    assert got == sorted(want)


def test_null_contract(spark):
    df = spark.createDataFrame([("a", "a"), (None, "b"), ("c", "d")], "p string, t string")
    assert df.agg(M.top1(F.col("p"), F.col("t"))).first()[0] == pytest.approx(1 / 3)
    assert E.failures(df, "p", "t").count() == 2
    cells = E.binary_metrics(spark.createDataFrame([("o", 0, 0)], "operator string, p int, t int"), "p", "t").collect()
    assert {(r.operator, r.precision, r.recall, r.f1, r.accuracy) for r in cells} == {("o", 0.0, 0.0, 0.0, 1.0), ("overall", 0.0, 0.0, 0.0, 1.0)}
    q = spark.createDataFrame([("s1_00", "x", "a", "b", None)], "scene_id string, object_x string, object_a string, object_b string, tau_between_m double")
    assert "tau_between_m" in q.columns


def test_review_ids_and_lookups(spark):
    q = spark.createDataFrame([("b", 2), ("a", 1), ("a", 0)], "scene_id string, k int")
    assert sorted((r.scene_id, r.k, r.query_id) for r in L.with_row_id(q, "q_", ["k"]).collect()) == [("a", 0, "q_0000"), ("a", 1, "q_0001"), ("b", 2, "q_0002")]
    assert L.require_unique(q, ["k"]).count() == 3 and L.require_unique(q, ["scene_id", "k"]).columns == q.columns
    with pytest.raises(Exception, match='duplicate key {"scene_id":"a"}'):
        L.require_unique(q, ["scene_id"]).count()
    other = q.where("k = 2").select("scene_id", (F.col("k") * 10).alias("v"))
    assert [r.v for r in L.lookup(q.where("k = 2"), other, ["scene_id"]).collect()] == [20]
    assert L.lookup(q, other, ["scene_id"], strict=False).count() == 1
    with pytest.raises(Exception, match='missing key {"scene_id":"a"}'):
        L.lookup(q, other, ["scene_id"]).count()
    schema = spark.createDataFrame([], "k double, extra string").schema
    assert L.to_schema(q, schema).columns == ["k", "extra"] and L.present(q, ["z", "k"]).columns == ["k"]


def test_label_rules(spark):
    cases = {"Office Chair": "chair", "bed": "bed", "big coffee table top": "table", "tv stand": "monitor", "wardrobe": None, "chair desk": "chair", None: None}
    got = spark.createDataFrame([(k,) for k in cases], "r string").select("r", T.normalize_label(F.col("r")).alias("n")).collect()
    assert {r.r: r.n for r in got} == cases


def test_reply_rules(spark):
    num = {"0.0": None, "about 2,5 m": 2.5, "30 then 7": 7.0, "none": None}
    assert {r.s: r.v for r in spark.createDataFrame([(k,) for k in num], "s string").select("s", T.parse_number(F.col("s")).alias("v")).collect()} == num
    ids = F.array(F.lit("s__chair_001"), F.lit("s__desk_002"))
    replies = {"s__desk_002": "s__desk_002", "": "s__chair_001", "the desk_002": "s__desk_002", "zzz": None}
    assert {r.s: r.v for r in spark.createDataFrame([(k,) for k in replies], "s string").select("s", T.match_id(F.col("s"), ids).alias("v")).collect()} == replies


def test_stratified_pick_is_sequential(spark):
    rows = [("f1_0", "f1", "bedroom", 9.0), ("f1_1", "f1", "living_room", 9.5), ("f2_0", "f2", "living_room", 1.0), ("f3_0", "f3", "bedroom", 2.0), ("f4_0", "f4", "mixed_other", 5.0)]
    pool = spark.createDataFrame([(*r, 1, 1) for r in rows], "scene_id string, family_id string, room_group string, selection_score double, n_valid_objects int, n_valid_categories int")
    picked = S.stratified_pick(pool, {"bedroom": 1, "living_room": 2})
    assert sorted(r.scene_id for r in picked.collect()) == ["f1_0", "f2_0"]
    assert sorted(r.scene_id for r in S.backfill(picked, pool, 3).collect()) == ["f1_0", "f2_0", "f4_0"]


def test_bootstrap_brackets_the_estimate(spark):
    objects, cloud = scene(spark, 5)
    ci = B.distance_ci(P.pairs(objects).limit(5), cloud, replicates=200).collect()
    assert all(r.point <= r.ci_low + 1e-12 <= r.ci_high + 1e-9 and r.point <= r["mean"] for r in ci)
    again = B.distance_ci(P.pairs(objects).limit(5), cloud.repartition(5), replicates=200).collect()
    assert sorted(map(tuple, ci)) == sorted(map(tuple, again))
    near = B.nearest_stability(P.reference_candidates(objects, F.col("label_norm") == "door", ["chair", "sofa"]), cloud).collect()
    assert near and all(0 < r.boot_winner_stability <= 1 for r in near)


def test_kappa_and_majority(spark):
    votes = spark.createDataFrame([(1, 1, 1, None), (2, 0, 0, 1), (3, 1, 0, 1), (4, 1, 1, 1)], "item int, a int, b int, c int")
    k = {(r.rater_a, r.rater_b): (r.n, r.kappa) for r in E.kappa_pairs(E.long_votes(votes, "item", ["a", "b", "c"]), "item").collect()}
    assert k["a", "b"] == (4, pytest.approx(0.5)) and k["a", "c"][0] == 3
    assert [r[0] for r in votes.orderBy("item").select(M.majority([F.col(x) for x in "abc"])).collect()] == [1, 0, 1, 1]


def test_window_and_smoothing(spark):
    s = spark.createDataFrame([("s", i * 3, v) for i, v in enumerate([1.0, 2.0, 2.0, 1.0, 3.0])], "scene_id string, frame_idx int, score double")
    assert tuple(R.best_window(s, 6).first()) == ("s", 3, 4.0)


def test_no_nested_loops_or_python_in_scene_operators(spark):
    objects, cloud = scene(spark)
    plans = [
        P.pairs(objects), P.triples(objects), P.above_pairs(objects), P.neighbours(objects), C.between_candidates(objects, 0.3), C.aligned_candidates(objects, 0.25), P.surface_distance(P.pairs(objects), cloud),
        C.distance_candidates(objects, cloud), C.nearest_candidates(objects, cloud),
    ]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan and "Pandas" not in plan
