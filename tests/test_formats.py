import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.sources import formats as M


def ply(n, order="<", extra=True):
    kind = np.dtype([("x", order + "f4"), ("y", order + "f4"), ("z", order + "f4")] + [("red", "u1"), ("alpha", order + "i2")] * extra)
    rows = np.zeros(n, kind)
    rows["x"], rows["y"] = np.arange(n), np.arange(n) % 7
    if extra:
        rows["red"], rows["alpha"] = np.arange(n) % 251, -np.arange(n) % 1000
    names = {"f4": "float", "u1": "uchar", "i2": "short"}
    head = f"ply\nformat binary_{'little' if order == '<' else 'big'}_endian 1.0\nelement vertex {n}\n" + "".join(f"property {names[kind[c].str[1:]]} {c}\n" for c in kind.names)
    face = struct.pack(order + "B3i", 3, 0, 1, 2)
    return (head + "element face 1\nproperty list uchar int vertex_indices\nend_header\n").encode() + rows.tobytes() + face


@pytest.mark.parametrize("order", ["<", ">"])
def test_one_mesh_is_read_by_several_tasks(spark, tmp_path, order):
    (tmp_path / "a.ply").write_bytes(ply(5000, order))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.ply").write_bytes(ply(3, order, extra=False))
    (tmp_path / "c.ply").write_bytes(ply(0, order))
    (tmp_path / "notes.txt").write_text("no mesh")
    df = M.read_ply_vertices(spark, str(tmp_path), bytes_per_partition=10_007)
    assert df.rdd.getNumPartitions() == -(-len(ply(5000, order)) // 10_007)  # the small files share the last one
    rows = df.collect()
    a = sorted((r.vertex_idx, r.x, r.y, r.red, r.blue) for r in rows if r.path.endswith("a.ply"))
    assert a == [(i, float(i), float(i % 7), i % 251, None) for i in range(5000)]
    assert sorted((r.vertex_idx, r.x, r.red) for r in rows if r.path.endswith("b.ply")) == [(i, float(i), None) for i in range(3)] and len(rows) == 5003


def test_only_the_asked_columns_are_read(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(ply(100))
    df = M.read_ply_vertices(spark, str(tmp_path / "a.ply"), bytes_per_partition=300, columns="vertex_idx long, alpha int")
    assert df.columns == ["vertex_idx", "alpha"] and sorted(map(tuple, df.collect())) == [(i, -i % 1000) for i in range(100)]


def test_broken_meshes(spark, tmp_path):
    (tmp_path / "short.ply").write_bytes(ply(100)[:-600])
    with pytest.raises(Exception, match="ends within"):
        M.read_ply_vertices(spark, str(tmp_path)).count()
    (tmp_path / "short.ply").write_bytes(b"something else")
    with pytest.raises(Exception, match="not a PLY"):
        M.read_ply_vertices(spark, str(tmp_path)).count()
    os.remove(tmp_path / "short.ply")
    assert M.read_ply_vertices(spark, str(tmp_path)).collect() == []


def points_of(spark, n):
    return spark.range(n).select(F.format_string("s__chair_%03d", F.col("id") % 5).alias("object_id"), F.expr("CAST(id div 5 AS INT)").alias("pt_idx"), *[(F.col("id") * k).cast("float").alias(c) for k, c in enumerate("xyz", 1)])


@pytest.mark.parametrize("compressed", [True, False])
def test_points_are_written_and_read_again(spark, tmp_path, compressed):
    df, to = points_of(spark, 4003).repartition(7), str(tmp_path / "out")
    M.write_npz_points(df, to, compressed=compressed)
    assert sorted(os.listdir(to)) == [f"s__chair_{i:03d}.npz" for i in range(5)]
    assert np.load(f"{to}/s__chair_002.npz")["points"][3].tolist() == [17.0, 34.0, 51.0]
    again = M.read_npz_points(spark, to, bytes_per_partition=3000)
    assert again.rdd.getNumPartitions() > 5
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    M.write_npz_points(df.where("object_id = 's__chair_001' AND pt_idx < 2"), to)
    assert M.read_npz_points(spark, to).where("object_id = 's__chair_001'").count() == 2 and len(os.listdir(to)) == 5
    M.write_npz_points(df.where("object_id = 's__chair_001'"), to, mode="overwrite")
    assert os.listdir(to) == ["s__chair_001.npz"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    to = str(tmp_path / "out")
    M.write_npz_points(points_of(spark, 50), to)
    before = {f: os.path.getmtime(f"{to}/{f}") for f in os.listdir(to)}
    bad = points_of(spark, 500).withColumn("x", F.when((F.col("object_id") == "s__chair_004") & (F.col("pt_idx") == 77), F.raise_error(F.lit("broken point")).cast("float")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="broken point"):
        M.write_npz_points(bad, to)
    assert {f: os.path.getmtime(f"{to}/{f}") for f in os.listdir(to)} == before
    with pytest.raises(Exception, match="came to several tasks|don't stand together"):
        points_of(spark, 60).repartition(6).write.format("npz").option("path", to).mode("append").save()
    with pytest.raises(Exception, match="are missing"):
        points_of(spark, 60).drop("z").write.format("npz").option("path", to).mode("append").save()
    assert {f: os.path.getmtime(f"{to}/{f}") for f in os.listdir(to)} == before
