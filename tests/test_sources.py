import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.objects import assemble, manifest
from plumbline.sources import binary as B
from plumbline.sources import files as R
from plumbline.sources import formats as M


def test_csv_variants(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;name;\n1;x;\n2;;\n")
    assert [tuple(r) for r in R.read_csv_sniffed(spark, str(tmp_path / "a.csv"), "id int, name string").orderBy("id").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "mixed").mkdir()
    for name, text in (("a", "id;name;\n1;x,y;\n"), ("b", "id,name\n2,u;v\n3,w\n"), ("c", "id,name\n"), ("d", "")):
        (tmp_path / "mixed" / f"{name}.csv").write_text(text)
    assert sorted(tuple(r) for r in R.read_csv_sniffed(spark, str(tmp_path / "mixed"), "id int, name string").collect()) == [(1, "x,y"), (2, "u;v"), (3, "w")]
    (tmp_path / "b.csv").write_text("a,b,c\n1,2\n3,4,5,6,7\n8,9,10\n")
    schema = spark.createDataFrame([], "a int, b int, c int").schema
    rows = R.read_csv_ragged(spark, str(tmp_path / "b.csv"), schema).select("a", "b", "c", F.col("_corrupt_record").isNotNull().alias("odd"))
    assert sorted(map(tuple, rows.collect())) == [(1, 2, None, True), (3, 4, 5, True), (8, 9, 10, False)]


def test_text_sources_and_config(spark, tmp_path):
    (tmp_path / "list.txt").write_text(" scene0001_00 \n\n scene0002_00\n")
    assert [r.value for r in R.read_list(spark, str(tmp_path / "list.txt")).collect()] == ["scene0001_00", "scene0002_00"]
    (tmp_path / "s.txt").write_text("axis = 1\n  sceneType = Living room = big\n")
    (tmp_path / "t.txt").write_text("axis = 1\n")
    got = {r.path.rsplit("/", 1)[-1]: r.value for r in R.read_key_value(spark, str(tmp_path / "[st].txt"), "scenetype").collect()}
    assert got == {"s.txt": "living room = big", "t.txt": "unknown"}
    assert R.parse_config("ops:\n  - a\n  - b c\nnear:\n  tau: 0.30\n  on: true\n  deep:\n    k: 'x'\nn: 3 # note\n") == {"ops": ["a", "b c"], "near": {"tau": 0.3, "on": True, "deep": {"k": "x"}}, "n": 3}


def test_scene_from_documents_and_mesh(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"sceneId": "s1_00", "segGroups": [{"id": 0, "objectId": 4, "label": "Desk", "segments": [7, 7, 9]}, {"id": 1, "label": "door", "segments": [8]}]}')
    (tmp_path / "v.json").write_text('{"sceneId": "s1_00", "segIndices": [7, 8, 9, 7]}')
    (tmp_path / "m.ply").write_bytes(b"ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n5 5 5\n1 0 0\n1 2 3\n4 0 1 2 3\n")
    v = M.read_ply_vertices(spark, str(tmp_path)).withColumn("scene_id", F.lit("s1_00"))
    objects = manifest(assemble(v, R.read_vertex_segments(spark, str(tmp_path / "v.json")), R.read_segment_groups(spark, str(tmp_path / "g.json"))), 3, 3)
    rows = {r.object_id: r for r in objects.collect()}
    assert rows["s1_00__desk_004"].n_points == 3 and rows["s1_00__desk_004"].is_valid_object and rows["s1_00__door_001"].invalid_reason == "too_few_points"
    t = B.triangles(B.read_ply_faces(spark, str(tmp_path)), v).orderBy("part").collect()
    assert [r.corners for r in t] == [[0, 1, 2], [0, 2, 3]] and t[0].red is None


@pytest.mark.parametrize("sizes", [[3] * 50, [3, 4, 3], [4], [], [0, 0]])
@pytest.mark.parametrize("order", ["little", "big"])
def test_ply_faces_of_equal_and_mixed_sizes(sizes, order):
    e = "<" if order == "little" else ">"
    want = [list(range(i, i + n)) for i, n in enumerate(sizes)]
    head = f"ply\nformat binary_{order}_endian 1.0\nelement vertex 1\nproperty float x\nelement edge 2\nproperty list uchar short v\nelement face {len(sizes)}\nproperty list uchar int vertex_indices\nend_header\n"
    body = struct.pack(e + "f", 2.5) + struct.pack(e + "B2hB1h", 2, 7, 8, 1, 9) + b"".join(struct.pack(f"{e}B{len(f)}i", len(f), *f) for f in want)
    v, f = B.parse_ply(head.encode() + body)
    assert v["x"].tolist() == [2.5] and f == want
    assert B.parse_ply(head.encode() + body, with_faces=False)[1] == []


def test_binary_ply_equals_ascii(spark):
    dt = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])
    rows = np.array([(1, 2, 3, 9, 8, 7), (4, 5, 6, 1, 2, 3)], dt)
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 2\n" + "".join(f"property {'float' if n in 'xyz' else 'uchar'} {n}\n" for n in dt.names) + "element face 1\nproperty list uchar int vertex_indices\nend_header\n"
    v, f = B.parse_ply(head.encode() + rows.tobytes() + struct.pack("<B3i", 3, 0, 1, 1))
    assert v["z"].tolist() == [3, 6] and v["red"].tolist() == [9, 1] and f == [[0, 1, 1]]
    with pytest.raises(ValueError):
        B.parse_ply(b"not a mesh")


def test_npz(spark, tmp_path):
    np.savez_compressed(tmp_path / "s__chair_001.npz", points=np.arange(6).reshape(2, 3))
    assert sorted(map(tuple, M.read_npz_points(spark, str(tmp_path)).collect())) == [("s__chair_001", 0, 0.0, 1.0, 2.0), ("s__chair_001", 1, 3.0, 4.0, 5.0)]


def sens(frames):
    out = io.BytesIO()
    out.write(struct.pack("<IQ", 4, 5) + b"depth" + struct.pack("<64f", *[float(i % 17) for i in range(64)]) + struct.pack("<2i4IfQ", 2, 1, 8, 6, 3, 2, 1000.0, frames))
    for i in range(frames):
        depth = zlib.compress(np.arange(i, i + 6, dtype="<u2").tobytes())
        color = b"jpg" * i
        out.write(struct.pack("<16f4Q", *[float(i + k) for k in range(16)], 10 * i, 20 * i, len(color), len(depth)) + color + depth)
    return out.getvalue()


def test_sens(spark, tmp_path):
    (tmp_path / "a.sens").write_bytes(sens(7))
    path = str(tmp_path / "a.sens")
    full = B.read_sens(spark, [path], frames_per_partition=3)
    assert full.rdd.getNumPartitions() == 3
    assert sorted((r.first, r["count"]) for r in B.sens_ranges(spark.read.format("sens").option("path", path).load(), 3).collect()) == [(0, 3), (3, 3), (6, 1)]
    rows = full.orderBy("frame_idx").collect()
    assert [len(r.color) for r in rows] == [3 * i for i in range(7)] and rows[2].pose[3] == 5.0 and rows[3].ts_depth == 60
    stats = {r.frame_idx: (r.n_valid, r.min_depth, r.max_depth) for r in B.depth_statistics(full).collect()}
    assert stats[0] == (5, 1, 5) and stats[6] == (6, 6, 11)
    index = B.frame_index(B.read_sens(spark, [path], index_only=True)).orderBy("frame_idx").collect()
    assert [r.cam_x for r in index] == [3.0 + i for i in range(7)]
    with pytest.raises(ValueError):
        B.decode_depth(b"", "occi_ushort", 1, 1)


def test_sinks_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1), ("s2", 2)], "scene_id string, query_id int")
    R.write_by_scene(df, str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"scene_id=s1", "scene_id=s2"}
    R.write_jsonl(df, str(tmp_path / "j")), R.write_csv(df, str(tmp_path / "c"), one_file=True), R.write_parquet(df, str(tmp_path / "p"), ["scene_id"])
    assert R.read_jsonl(spark, str(tmp_path / "j"), "scene_id string, query_id int").count() == 2
    done = str(tmp_path / "done")
    assert R.append_responses(df.where("query_id = 1"), done, F.lit("first")).count() == 1
    assert sorted((r.query_id, r.answer) for r in R.append_responses(df, done, F.lit("second")).collect()) == [(1, "first"), (2, "second")]
    assert [r.value for r in R.metrics_text(df.agg(F.count("*").alias("n"))).collect()] == ["n = 2"]


def test_the_driver_opens_no_frame(monkeypatch):
    def refused(path):
        raise AssertionError(path)

    monkeypatch.setattr(B, "_open", refused)
    assert [p.path for p in B.SensReader({"path": "a.sens,b.sens"}).partitions()] == ["a.sens", "b.sens"]
