from pyspark.sql import functions as F

from plumbline.operators.objects import aliases, manifest
from plumbline.operators.questions import answer
from plumbline.streaming.queries import answer_stream, once, windowed_counts

def test_once_and_windows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:01:00"), (1, "2024-01-01 00:02:00"), (2, "2024-01-01 00:12:00")], "query_id int, s string").select("query_id", F.to_timestamp("s").alias("ts"))
    rows.write.parquet(str(tmp_path / "q"))
    read = lambda: spark.readStream.schema("query_id int, ts timestamp").parquet(str(tmp_path / "q"))
    for name, df, mode, n in (("once_a", once(read()), "append", 2), ("once_b", once(read(), event_time="ts"), "append", 2), ("counts", windowed_counts(read(), "ts", "query_id"), "complete", 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable(), q.stop()
        assert spark.table(name).count() == n


def test_question_stream(spark, tmp_path):
    pts = [("s0_00", i, lab, j, float(10 * i + j), float(j % 2), float(j)) for i, lab in enumerate(["chair", "table", "chair"]) for j in range(3)]
    points = spark.createDataFrame(pts, "scene_id string, instance_id_raw int, label_raw string, pt_idx int, x double, y double, z double")
    objects = aliases(manifest(points, 3, 3).where("is_valid_object"))
    cloud = points.join(objects.select("instance_id_raw", "object_id"), "instance_id_raw").select("object_id", "x", "y", "z")
    asked = spark.createDataFrame([("s0_00", "1", "qual a distância entre chair1 e table1?"), ("s0_00", "2", "qual chair está mais próximo de table1?"), ("s0_00", "3", "table1 está entre chair1 e chair2?"), ("s0_00", "4", "hm")], "scene_id string, question_id string, text string")
    asked.write.parquet(str(tmp_path / "asked"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "asked"))
    answer_stream(stream, lambda q: answer(q, objects, cloud), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.question_id: r.answer for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["1"] == "8.2462 m" and got["2"].startswith("chair") and got["3"] == "sim" and got["4"] == "Consulta fora do padrão esperado."
