import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import frames as R
from plumbline.operators import objects as O
from plumbline.operators import relational as L
from plumbline.operators import spatial as S


def scene(spark, n, spread, seed=1):
    rng = np.random.default_rng(seed)
    rows = [("s", i, ["desk", "chair", "sofa"][i % 3], j, *map(float, rng.uniform(0, spread, 3) * 0 + c + rng.normal(size=3))) for i in range(n) for c in [rng.uniform(0, spread, 3)] for j in range(12)]
    p = spark.createDataFrame(rows, "scene_id string, instance_id_raw int, label_raw string, pt_idx int, x double, y double, z double")
    m = O.manifest(p, 3, 3).where("is_valid_object")
    return m, p.join(m.select("instance_id_raw", "object_id"), "instance_id_raw")


def test_bounds_lose_no_nearest_and_save_clouds(spark):
    for spread, share in ((4, 1.0), (60, 0.4)):
        objects, points = scene(spark, 30, spread)
        asked = S.reference_candidates(objects, F.col("label_norm") == "desk", ["chair", "sofa"], extra=("box",))
        some = S.reachable(asked)
        assert some.columns == S.reference_candidates(objects, F.col("label_norm") == "desk", ["chair", "sofa"]).columns
        best = lambda c: sorted(map(tuple, S.nearest(S.surface_distance(c, points), "surface_distance").collect()))  # noqa: E731,B023
        assert best(some) == best(asked) and 0 < some.count() <= share * asked.count()


def test_bounds_hold_for_every_pair(spark):
    objects, points = scene(spark, 14, 5, 3)
    pairs = S.surface_distance(S.pairs(objects), points).select("object_a", "object_b", "surface_distance")
    box = lambda s: objects.select(F.col("object_id").alias(f"object_{s}"), *[F.col(f"aabb_{m}_{k}").alias(f"{s}_{m}_{k}") for m in ("min", "max") for k in "xyz"])
    rows = pairs.join(box("a"), "object_a").join(box("b"), "object_b").select("surface_distance", F.sqrt(S._face_bound("a", "b")).alias("high")).collect()
    assert len(rows) == 91 and all(r.surface_distance <= r.high + 1e-9 for r in rows)


def test_scenes_too_large_for_triples_stop(spark):
    objects, _ = scene(spark, 9, 5)
    assert S.triples(objects, 9).count() == 84
    with pytest.raises(Exception, match="too many for triples"):
        S.triples(objects, 8).count()


def test_numbers_are_joined_within_a_tolerance(spark):
    rng = random.Random(5)
    value = lambda: rng.choice([None, math.nan, 0.0, -0.0, math.inf, -math.inf, 1e300, rng.randint(-40, 40) * 0.01, rng.uniform(-0.3, 0.3)])
    left, right = [[(i, rng.choice("ab"), value()) for i in range(120)] for _ in range(2)]
    a, b = spark.createDataFrame(left, "i int, k string, v double"), spark.createDataFrame(right, "j int, k string, v double")
    missing = lambda x: x is None or math.isnan(x)
    for tolerance in (0.0, 0.01, 0.004):
        same = lambda x, y: missing(x) and missing(y) or not missing(x) and not missing(y) and (x == y or abs(x - y) <= tolerance)  # noqa: E731,B023
        want = [(i, j) for i, k, x in left for j, m, y in right if k == m and same(x, y)]
        lone = [(i, None) for i, *_ in left if i not in {p[0] for p in want}]
        got = L.join_near(a, b, ["k"], ["v"], tolerance)
        assert got.columns == ["i", "k", "v", "j"]
        assert sorted(((r.i, r.j) for r in got.collect()), key=str) == sorted(want + lone, key=str)
        assert sorted((r.i, r.j) for r in L.join_near(a, b, ["k"], ["v"], tolerance, "inner").collect()) == sorted(want)
    two = L.join_near(spark.createDataFrame([(1, 0.5, 2.0)], "i int, v double, w double"), spark.createDataFrame([(7, 0.5, 2.0 + 1e-12), (8, 0.5, 2.1)], "j int, v double, w double"), [], ["v", "w"])
    assert [r.j for r in two.collect()] == [7]
    assert "CartesianProduct" not in two._jdf.queryExecution().executedPlan().toString()


def test_packed_boxes_equal_exploded_ones(spark):
    rng = np.random.default_rng(2)
    pose = [float(v) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)]
    frames = spark.createDataFrame([("s", f, pose[:3] + [0.3 * f] + pose[4:], 100.0, 100.0, 50.0, 50.0) for f in range(4)], "scene_id string, frame_idx int, pose array<double>, fx double, fy double, cx double, cy double")
    points = spark.createDataFrame([("s", f"o{i % 5}", *map(float, rng.normal(size=3) + [0, 0, i % 5])) for i in range(300)], "scene_id string, object_id string, x double, y double, z double")
    seen = frames.crossJoin(points.select("object_id").distinct())
    keys = ["scene_id", "frame_idx", "object_id"]
    old = R.image_boxes(R.project(seen.join(points, ["scene_id", "object_id"])), keys, 100, 100, 5)
    new = R.cloud_boxes(seen, points, 100, 100, 5)
    assert new.columns == old.columns and sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect())) and new.count() > 8


def test_slugs_need_only_a_head(spark):
    plain = lambda t: (__import__("re").sub("^_+|_+$", "", __import__("re").sub("[^a-z0-9]+", "_", t.lower()))[:80] or "query")
    rng = random.Random(4)
    texts = ["", "___", "é" * 300, "--A--" * 60, "x" * 79 + "!!y", "x" * 80 + "!", "a!" * 200, " lead and trail ", "KK9 ok"] + ["".join(rng.choices("aB1 é-_\n", k=rng.randint(0, 400))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.slugify(F.col("t")).alias("s")).collect()
    assert all(r.s == plain(r.t) for r in got)


def test_answers_with_a_comma_and_lists(spark):
    row = spark.sql("SELECT 3.14159D AS d, array('a', NULL, 'b\"c') AS l, CAST(array() AS ARRAY<INT>) AS e").select(T.decimal_comma(F.col("d")), T.json_list(F.col("l")), T.json_list(F.col("e"))).first()
    assert tuple(row) == ("3,14 m", '["a",null,"b\\"c"]', "[]")
