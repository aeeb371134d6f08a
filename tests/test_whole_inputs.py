"""Registered queries on inputs whose far parts count."""

from plumbline.operators import candidates as C
from plumbline.operators import objects as O
from plumbline.operators import spatial as S
from plumbline.plans import registry


def test_slugs_read_whole_texts(spark, tmp_path):
    texts = [" " * 400 + "Late Title", "\u4e2d" * 350 + " end", "*" * 290 + "abcdefgh " * 40, None, "?" * 500]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.slug for r in registry.QUERIES["slugs"](spark, str(tmp_path)).collect()}
    assert got == {0: "late_title", 1: "end", 2: ("abcdefgh_" * 40)[:80], 3: "query", 4: "query"}


def test_master_queries_take_every_row(spark, tmp_path):
    spark.createDataFrame([(i, float(i)) for i in range(1, 8)], "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i, "M") for i in range(1, 5)], "c_custkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    rows = registry.QUERIES["master_queries"](spark, str(tmp_path)).collect()
    want = [("distance", i) for i in range(1, 8)] + [("nearest", i) for i in range(1, 5)]
    assert sorted((r.query_id, r.operator, r.k) for r in rows) == [(f"dev_q_{n:04d}", *x) for n, x in enumerate(want)]


def test_above_on_whole_clouds(spark):
    grid = [(i % 3 * 0.2, i // 3 % 3 * 0.2, i // 9 * 0.2) for i in range(27)]
    raw = [("s_00", n, label, i, x, y, z + up) for n, label, up in ((1, "desk", 0.0), (2, "chair", 0.6)) for i, (x, y, z) in enumerate(grid)]
    v = O.valid(O.manifest(spark.createDataFrame(raw, "scene_id string, instance_id_raw int, label_raw string, pt_idx int, x double, y double, z double"), 20, 15))
    got = {(r.object_a[6:], r.object_b[6:]): (round(r.gap_z, 6), r.is_above) for r in S.above_pairs(v).collect()}
    assert got == {("chair_002", "desk_001"): (0.2, True), ("desk_001", "chair_002"): (-1.0, False)}
    assert sorted((r.binary_label, r.object_a[6:]) for r in C.above_examples(v).collect()) == [(0, "desk_001"), (1, "chair_002")]
