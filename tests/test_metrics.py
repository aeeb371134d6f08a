import math

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from plumbline.functions import metrics as M
from plumbline.operators import bootstrap as B
from plumbline.operators import frames as R
from plumbline.operators import smoothing as S


def test_a_missing_prediction_is_not_accurate(spark):
    rows = [(1, 1), (1, None), (0, 0), (0, 1), (0, None), (1, 0)]
    e = spark.createDataFrame(rows, "t int, p int")
    r = e.agg(*M.confusion(F.col("p"), F.col("t"))).select("*", *M.binary_scores()).first()
    assert (r.n, r.tp, r.tn, r.fp, r.fn) == (6, 1, 1, 1, 1) and math.isclose(r.accuracy, 2 / 6) and r.precision == r.recall == r.f1 == 0.5


def test_boxes_and_points_are_smoothed_by_shape(spark):
    rows = [("a", 0, None), ("a", 1, [0.0, 10.0]), ("a", 2, [10.0, 20.0]), ("a", 3, None), ("a", 4, [1.0, 2.0, 3.0]), ("a", 5, [2.0, 2.0, 2.0]), ("a", 6, []), ("b", 0, [5.0])]
    got = {(r.k, r.i): r.smoothed for r in S.smooth_shapes(spark.createDataFrame(rows, "k string, i int, v array<double>").repartition(3), "k", ["i"], "v", 0.5).collect()}
    assert got == {("a", 0): None, ("a", 1): [0, 10], ("a", 2): [5, 15], ("a", 3): [5, 15], ("a", 4): [1, 2, 3], ("a", 5): [1.5, 2, 2.5], ("a", 6): [], ("b", 0): [5]}


def _questions(spark):
    cloud = [("r", n, 0.1 * n, 0.0, 0.0) for n in range(20)] + [("near", 0, 0.0, 1.0, 0.0), ("far", 0, 0.0, 9.0, 0.0)] + [("left", 0, -1.0, 0.0, 0.0), ("right", 0, 2.95, 0.0, 0.0)]
    points = spark.createDataFrame(cloud, "object_id string, pt_idx int, x double, y double, z double")
    asked = spark.createDataFrame([("r", "clear", "near", 1), ("r", "clear", "far", 2), ("r", "open", "left", 1), ("r", "open", "right", 2)], "object_a string, label_b string, object_b string, ord_b int")
    return asked, points, cloud


def test_stability_of_given_answers(spark):
    asked, points, cloud = _questions(spark)
    answers = spark.createDataFrame([("r", "clear", "far"), ("r", "open", "right")], "object_a string, label_b string, gt_winner string")
    got = {r.label_b: r for r in B.nearest_stability(asked, points, answers).collect()}
    clear, either = got["clear"], got["open"]
    assert (clear.n_candidates, clear.point_winner, clear.gt_winner, clear.gt_correct_point, clear.gt_stability, clear.boot_winner, clear.boot_winner_stability) == (2, "near", "far", False, 0.0, "near", 1.0)
    # replicates agree with the closed form within their sampling error
    rng, xs = np.random.default_rng(1), 0.1 * np.arange(20)
    left = [np.abs(xs[k] + 1).min() <= np.abs(xs[k] - 2.95).min() for k in rng.integers(0, 20, (40_000, 20))]
    share = {"left": np.mean(left), "right": 1 - np.mean(left)}
    assert (either.point_winner, either.gt_winner, either.gt_correct_point) == ("left", "right", False)
    assert abs(either.gt_stability - share["right"]) < 0.01 and abs(either.boot_winner_stability - max(share.values())) < 0.01 and either.boot_winner == max(share, key=share.get)
    total = B.summarise_nearest(spark.createDataFrame(list(got.values()))).first()
    assert (total.n, total.n_stable, total.n_correct, total.min_stability, total.median_stability) == (2, 0, 0, 0.0, either.gt_stability / 2)


def test_stability_without_answers_and_with_ties(spark):
    asked, points, _ = _questions(spark)
    got = B.nearest_stability(asked, points).collect()
    assert {(r.gt_winner, r.gt_correct_point, r.gt_stability) for r in got} == {(None, False, 0.0)}
    twins = spark.createDataFrame([("r", "t", "near", 2), ("r", "t", "twin", 1)], asked.schema)
    same = points.union(spark.createDataFrame([("twin", 0, 0.0, 1.0, 0.0)], points.schema))
    one = B.nearest_stability(twins, same).first()
    assert (one.point_winner, one.boot_winner, one.boot_winner_stability) == ("twin", "twin", 1.0)
    assert B.summarise_nearest(B.nearest_stability(asked, points)).first().n == 0


def test_replicates_are_functions_of_their_place():
    rng = np.random.default_rng(2)
    u, v = rng.normal(size=(30, 3)), rng.normal(size=(17, 3)) + 2
    whole = B.lows(u, v, ("a", "b"), 200, 42)
    d = ((u[:, None] - v[None]) ** 2).sum(axis=2)
    plain = []
    for r in range(200):
        x = B.draws(42, ("a", "b"), r, 47)
        plain.append(d[np.ix_(np.unique(x[:30] % 30), np.unique(x[30:] % 17))].min())
    assert np.allclose(whole, plain) and np.allclose(whole, B.lows(u, v, ("a", "b"), 200, 42, nearest=3, block=7))
    x = B.draws(1, ("a",), 0, 20_000) % 20
    assert abs(np.bincount(x) / 1000 - 1).max() < 0.15


def test_boxes_out_of_view_are_left_out(spark):
    pose = [float(v) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)]
    frames = spark.createDataFrame([("s", 0, pose, 100.0, 100.0, 50.0, 50.0)], "scene_id string, frame_idx int, pose array<double>, fx double, fy double, cx double, cy double")
    corners = lambda x, y, z: (x, y, z, x + 1, y + 1, z + 1)
    boxes = [("seen", *corners(0, 0, 5)), ("edge", *corners(2.4, 0, 5)), ("behind", *corners(0, 0, -5)), ("left", *corners(-9, 0, 5)), ("below", *corners(0, 9, 5)), ("around", -9.0, -9.0, -9.0, 9.0, 9.0, 9.0)]
    b = spark.createDataFrame([("s", *[float(v) if not isinstance(v, str) else v for v in x]) for x in boxes], "scene_id string, object_id string, aabb_min_x double, aabb_min_y double, aabb_min_z double, aabb_max_x double, aabb_max_y double, aabb_max_z double")
    assert {r.object_id for r in R.in_view(frames, b, 100, 100).collect()} == {"seen", "edge", "around"}


def test_answers_need_few_scans(spark):
    plan = __spark_entry__.queries()["answer_nl_query"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 15
