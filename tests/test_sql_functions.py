"""SQL functions against the Column expressions of the same names."""

import itertools

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import sql

SPOTS = [(0.0, 0.0, 0.0), (2.0, 0.0, 1.0), (1.0, 0.25, 3.0), (-1.0, 0.1, 0.5), (2.0, 2.0, -1.0)]


def test_sql_functions_equal_the_columns(spark):
    sql.register(spark)
    df = spark.createDataFrame([(*x, *y, *z) for x, y, z in itertools.product(SPOTS, repeat=3)], ", ".join(f"{p}_{k} double" for p in "pab" for k in "xyz"))
    df = df.select("*", *[F.struct(*[F.col(f"{p}_{k}").alias(k) for k in "xyz"]).alias(p) for p in "pab"])
    df.createOrReplaceTempView("spots")
    pairs = {
        "centroid_distance(p, a)": G.distance_3d("p", "a"),
        "segment_position_xy(p, a, b)": G.segment_position_xy("p", "a", "b"),
        "segment_distance_xy(p, a, b)": G.segment_distance_xy("p", "a", "b"),
        "line_distance_xy(p, a, b)": G.line_distance_xy("p", "a", "b"),
        "between_xy(p, a, b, 0.3)": G.between_xy("p", "a", "b", 0.3),
        "aligned_xy(a, b, p, 0.25)": G.aligned_xy("a", "b", "p", 0.25),
        "above(p_z, a_z, 0.1)": G.above("p_z", "a_z", 0.1),
    }
    got = spark.sql("SELECT " + ", ".join(f"{call} AS c{i}" for i, call in enumerate(pairs)) + " FROM spots")
    want = df.select(*[c.alias(f"c{i}") for i, c in enumerate(pairs.values())])
    as_rows = lambda d: sorted(tuple(round(float(v), 9) for v in r) for r in d.collect())
    assert as_rows(got) == as_rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_missing_points_give_null(spark):
    sql.register(spark)
    point = "named_struct('x', 1D, 'y', 1D, 'z', 0D)"
    r = spark.sql(f"SELECT between_xy(NULL, {point}, {point}, 0.3) AS b, aligned_xy({point}, {point}, NULL, 0.3) AS l, above(NULL, 1D, 0D) AS u, segment_distance_xy({point}, NULL, {point}) AS d, line_distance_xy({point}, {point}, NULL) AS g").first()
    assert tuple(r) == (None,) * 5
