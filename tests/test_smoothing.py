import math
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from plumbline.operators import smoothing as S
from plumbline.streaming import smoothing as stream

SCHEMA = "k string, i long, v array<double>"


def brute(rows, alpha=0.8):
    """Row by row: rows (k, i, v) in any order."""
    out, was = {}, defaultdict(lambda: None)
    bad = lambda v: any(x is None or math.isnan(x) for x in v)
    for k, i, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1])):
        s = was[k]
        if v is not None:
            s = list(v) if s is None or len(s) != len(v) or bad(v) or bad(s) else [alpha * a + (1 - alpha) * b for a, b in zip(s, v)]
        was[k] = out[k, i] = s
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k] is None) == (w is None) and (w is None or got[k] == pytest.approx([math.nan if x is None else x for x in w], rel=1e-9, nan_ok=True)), (k, got[k], w)


def made(seed, keys, n):
    rng = random.Random(seed)
    one = lambda: rng.choice([None, [rng.uniform(-9, 9) for _ in range(rng.choice([4, 4, 4, 4, 2, 0]))], [1.0, rng.choice([math.nan, 5.0]), 2.0, 3.0], [rng.uniform(0, 1) for _ in range(4)]])
    return [(rng.choice(keys), i, one()) for i in range(n)]


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("keys", [["a"], ["a", "b", None], [str(i) for i in range(60)] + ["a"] * 90])
def test_scan_equals_a_loop(spark, many_ranges, keys):
    rows = made(len(keys), keys, 900)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    same({(r.k, r.i): r.smoothed for r in S.smooth_shapes(df, "k", ["i"], "v").collect()}, brute(rows))
    numbers = [(k, i, None if v is None or not v or math.isnan(v[-1]) else v[-1:]) for k, i, v in rows]
    got = S.smooth(df.withColumn("v", F.try_element_at("v", F.lit(-1))), "k", ["i"], "v").collect()
    same({(r.k, r.i): None if r.smoothed is None else [r.smoothed] for r in got}, brute(numbers))


def test_one_key_is_spread_over_tasks(spark, many_ranges):
    df = spark.range(40_000).select(F.lit("one").alias("k"), "id", F.array(F.sin("id"), F.cos("id")).alias("v"))
    maps = S._maps(df, "k", ["id"], "v", 0.9)
    sizes = [r["count"] for r in maps.groupBy("_part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 25_000
    got = {r.id: r.smoothed for r in S.smooth_shapes(df, "k", ["id"], "v", 0.9).where("id % 997 = 3").collect()}
    want = brute([("one", i, [math.sin(i), math.cos(i)]) for i in range(40_000)], 0.9)
    same({("one", i): v for i, v in got.items()}, {k: v for k, v in want.items() if k[1] % 997 == 3})


def test_empty_and_missing(spark):
    assert S.smooth_shapes(spark.createDataFrame([], SCHEMA), "k", ["i"], "v").collect() == []
    rows = [("a", 0, None), ("a", 1, None)]
    assert [r.smoothed for r in S.smooth_shapes(spark.createDataFrame(rows, SCHEMA), "k", ["i"], "v").collect()] == [None, None]


def test_stream_in_event_time_order(spark, tmp_path):
    """Rows shuffled over micro-batches, no later than the watermark allows, give the batch's result."""
    start, rng = datetime(2024, 1, 1, tzinfo=timezone.utc), random.Random(3)
    rows = [(k, i, v) for k, i, v in made(8, ["a", "b"], 120)]
    timed = [(k, start + timedelta(seconds=10 * (i // 2)), i, v) for k, i, v in rows]
    near = sorted(timed, key=lambda r: r[2] + rng.uniform(0, 25))
    schema = "k string, ts timestamp, i long, v array<double>"
    for n in range(0, 120, 40):
        spark.createDataFrame(near[n : n + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = [("z", start + timedelta(hours=9), 0, None)]
    spark.createDataFrame(end, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("z", start + timedelta(hours=10), 1, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream.smooth_shapes(read, "k", "ts", "v", ("i",), late="5 minutes")
    q = out.writeStream.format("memory").queryName("in_order").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = [r for r in spark.table("in_order").collect() if r.k != "z"]
    same({(r.k, r.i): r.smoothed for r in got}, brute(rows))
    assert {(r.k, r.i): r.ts.replace(tzinfo=None) if r.ts.tzinfo is None else r.ts for r in got}.keys() == {(k, i) for k, i, _ in rows} and len(got) == 120


def test_an_idle_key_is_forgotten(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    schema = "k string, ts timestamp, v double"
    for k, hours, v in [("a", 0, 1.0), ("z", 3, 0.0), ("z", 3.5, 0.0), ("a", 4, 9.0), ("z", 8, 0.0), ("z", 9, 0.0)]:
        spark.createDataFrame([(k, start + timedelta(hours=hours), v)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, idle, want in (("forgotten", timedelta(hours=1), 9.0), ("kept", timedelta(days=3), 0.8 * 1.0 + (1 - 0.8) * 9.0)):
        q = stream.smooth(read, "k", "ts", "v", late="1 minute", idle=idle).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        assert sorted(r.smoothed for r in spark.table(name).collect() if r.k == "a") == [1.0, pytest.approx(want)]
