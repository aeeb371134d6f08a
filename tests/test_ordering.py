import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import neighbours as N
from plumbline.operators import ordering as O
from plumbline.operators import relational as R


def test_null_scopes_keep_their_rows(spark):
    q = spark.createDataFrame([(None, 1), (None, 0), ("b", 5), ("a", None), ("a", 3)], "scene_id string, k int")
    got = sorted((r.query_id, r.scene_id, r.k) for r in R.with_row_id(q, "q_", ["k"]).collect())
    assert got == [("q_0000", "a", 3), ("q_0001", "a", None), ("q_0002", "b", 5), ("q_0003", None, 0), ("q_0004", None, 1)]
    assert R.with_row_id(q.limit(0), "q_", ["k"]).collect() == []


def test_numbers_beyond_an_int_are_written(spark):
    assert O.numbered(spark.range(3), ["id"], "n", first=1 << 31).withColumn("s", F.format_string("q_%04d", "n")).agg(F.max("s")).first()[0] == "q_2147483650"


def test_one_scope_is_spread_over_tasks(spark):
    """All rows of one scope, most of them equal in order: several ranges hold them, and no window runs over rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        q = spark.range(20_000).select(F.lit("one").alias("scene_id"), F.when(F.col("id") < 15_000, 7).otherwise(F.col("id") % 11).alias("k"), "id")
        parts = O.sorted_ranges(q, ["scene_id", "k"]).groupBy("_part").count().collect()
        assert len(parts) >= 3 and max(r["count"] for r in parts) < 12_000
        out = R.with_row_id(q, "q_", ["k"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window") <= 2 and "Window [sum(_n" in plan  # over a row a range
        ordered = [r.k for r in out.orderBy(F.substring("query_id", 3, 9).cast("long")).collect()]
        assert ordered == sorted(ordered) and out.select("query_id").distinct().count() == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("blocks", [200_000, 1])
def test_lines_of_split_files_have_their_numbers(spark, tmp_path, monkeypatch, blocks):
    monkeypatch.setattr(O, "BROADCAST_BLOCKS", blocks)
    for name, n in (("a", 5000), ("b", 10), ("c", 0)):
        (tmp_path / f"{name}.csv").write_text("k,v\n" + "".join(f"{i},{name}{'x' * (i % 37)}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = spark.read.csv(str(tmp_path), header=True, schema="k int, v string")
        got = O.with_file_row(df, "line", "file")
        assert df.rdd.getNumPartitions() > 4 and got.columns == ["k", "v", "line", "file"] or got.columns == ["k", "v", "file", "line"]
        rows = got.collect()
        assert len(rows) == 5010 and all(r.k == r.line for r in rows) and {r.file[-5] for r in rows} == {"a", "b"}
        assert O.with_file_row(df, "k_").select("k_").agg(F.max("k_")).first()[0] == 4999
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    for n, m, shape in ((1, 1, 1), (300, 500, 3), (200, 1000, 0.01), (50, 2000, 1)):
        u, v = rng.normal(size=(n, 3)) * [1, 1, shape] + 2, np.round(rng.normal(size=(m, 3)), 1 if m == 1000 else 9)
        d = ((u[:, None] - v[None]) ** 2)
        d = d[..., 0] + d[..., 1] + d[..., 2]
        at, d2 = N.nearest_points(u, v, block=64)
        assert (at == d.argmin(axis=1)).all() and (d2 == d.min(axis=1)).all()
    assert sorted(i for g in N.leaves(v, 45) for i in g) == list(range(len(v))) and max(map(len, N.leaves(v, 45))) <= 45


def test_few_points_are_met(monkeypatch):
    """No all-pairs step: on clouds that lie apart a point meets a small share of the others."""
    rng = np.random.default_rng(3)
    u, v, met = rng.random((2000, 3)), rng.random((2000, 3)), 0
    real = np.where

    def counted(*a):
        nonlocal met
        met += a[0].size if len(a) == 3 and a[0].ndim == 2 else 0
        return real(*a)

    monkeypatch.setattr(N.np, "where", counted)
    N.nearest_points(u, v)
    assert 0 < met < 0.2 * 2000 * 2000


def test_point_rows(spark):
    rng = random.Random(1)
    cloud = {o: [tuple(rng.random() for _ in range(3)) for _ in range(n)] for o, n in (("a", 9), ("b", 30), ("c", 1))}
    points = spark.createDataFrame([(o, i * 2, *p) for o, ps in cloud.items() for i, p in enumerate(ps)], "object_id string, pt_idx int, x double, y double, z double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("a", "c"), ("a", "none")], "object_a string, object_b string")
    got = sorted((r.object_a, r.object_b, r.pt_a, r.pt_b) for r in N.point_neighbours(pairs, points).collect())
    far = lambda p, q: sum((x - y) ** 2 for x, y in zip(p, q))
    want = [(a, b, 2 * i, 2 * min(range(len(cloud[b])), key=lambda j: far(p, cloud[b][j]))) for a, b in (("a", "b"), ("b", "a"), ("a", "c")) for i, p in enumerate(cloud[a])]
    assert got == sorted(want)


def test_numbers_and_no_objects_reach_a_task(spark):
    """A row holds its clouds as plain numbers: no dict a point is made of an Arrow batch, and rows leave a task in bounded batches."""
    points = spark.createDataFrame([("a", i, float(i), 0.0, 0.0) for i in range(300)] + [("b", i, float(i), 1.0, 0.0) for i in range(5)], "object_id string, pt_idx int, x double, y double, z double")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "object_a string, object_b string")
    assert dict(N.paired(pairs, points).dtypes) == {"object_a": "string", "object_b": "string", "pt_a": "array<int>", "xyz_a": "array<double>", "pt_b": "array<int>", "xyz_b": "array<double>"}
    near = N.point_neighbours(pairs, points)
    assert near.count() == 305
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_stability_summary_reads_numbers(spark):
    """The summary of nearest winners goes through the same step: its plan holds no pandas rows."""
    from plumbline.operators import bootstrap as B

    points = spark.createDataFrame([(o, i, float(i), float(k), 0.0) for k, o in enumerate("abc") for i in range(4)], "object_id string, pt_idx int, x double, y double, z double")
    candidates = spark.createDataFrame([("a", "l", "b", 0), ("a", "l", "c", 1)], "object_a string, label_b string, object_b string, ord_b int")
    answers = spark.createDataFrame([("a", "l", "b")], "object_a string, label_b string, gt_winner string")
    out = B.summarise_nearest(B.nearest_stability(candidates, points, answers))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert tuple(out.first()) == (1, 1.0, 1.0, 1.0, 1, 1)
