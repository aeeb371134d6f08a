import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import common


def test_group_lookup_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "b", None, f"u{i}"])) for i in range(500)] + [(None, "hot"), (7, "hot"), (7, "hot")]
    df = common.materialize(spark.createDataFrame(rows, "id long, k string"), "t")
    got = sorted((r.id or -1, r.k or "", r.top or -1, r.n) for r in common.group_lookup(df, ["k"], [("top", "max", "id"), ("n", "count", "k")], spread="id", salts=8).collect())
    ids = lambda k: [i for i, x in rows if x == k]
    want = [(i or -1, k or "", max((x for x in ids(k) if x is not None), default=None) or -1, 0 if k is None else len(ids(k))) for i, k in rows]
    assert got == sorted(want)


def test_table_lookup_keeps_rows_without_a_match(spark):
    df = common.materialize(spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (3, None)], "id long, k string"), "t")
    table = spark.createDataFrame([("a", 5), (None, 9)], "k string, v int")
    assert sorted((r.id, r.v or 0) for r in common.table_lookup(df, table, ["k"], spread="id").collect()) == [(1, 5), (2, 0), (3, 9), (3, 9)]


def test_attach_by_broadcast_and_by_slots(spark, frame, monkeypatch):
    docs = frame([(1, "a"), (2, "b"), (None, "c"), (2, "d"), (2, "b"), (3, None)])
    table = common.materialize(spark.createDataFrame([(2, "b", 7), (None, "c", 8), (9, "z", 9), (3, None, 5)], "_i long, _t string, _v int"), "t")
    for limit in (10, 1):
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        out = common.attach(docs, {"_i": F.col("doc_id"), "_t": F.col("text")}, table)
        assert out.columns == [*docs.columns, "_i", "_t", "_v"]
        assert sorted((r.doc_id or 0, r.text or "", r._v or 0) for r in out.collect()) == [(0, "c", 8), (1, "a", 0), (2, "b", 7), (2, "b", 7), (2, "d", 0), (3, "", 5)]


def test_only_rows_in_slots_are_shuffled(spark, frame, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    docs = common.materialize(frame([(i, f"t{i}") for i in range(2000)]), "docs")
    table = common.materialize(spark.createDataFrame([(i, 1) for i in range(0, 2000, 100)], "_i long, _v int"), "t")
    out = common.attach(docs, {"_i": F.col("doc_id")}, table)
    near, far = out.where("_v IS NULL").count(), out.where("_v = 1").count()
    assert (near, far) == (1980, 20)
    flagged = common.flag_slots(docs, common.materialize(common.slots(table.select(F.xxhash64("_i").alias("h")), common.slot_count(20)), "s"), F.xxhash64("doc_id"), "_mark", common.slot_count(20))
    assert 20 <= flagged.where("_mark").count() < 60


def test_may_hold_keeps_all_that_match(spark, frame, monkeypatch):
    docs, ids = frame([(i, "x") for i in range(50)] + [(None, "y")]), common.materialize(spark.createDataFrame([(3,), (7,), (3,), (None,)], "k long"), "ids")
    for limit in (10, 1):
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        out = common.may_hold(docs, F.col("doc_id"), ids)
        assert out.columns == docs.columns and {3, 7} <= {r.doc_id for r in out.collect()} and out.count() < 20


def test_slot_counts():
    assert common.slot_count(0) == common.slot_count(100_000) == 1 << 20 and common.slot_count(1_000_000) == 1 << 23 and common.slot_count(10**10) == common.MOST_BITS


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_ascii_lower_leaves_other_letters(spark):
    text = ["ÀBC", "ABC", "İK", None, ""]
    got = spark.createDataFrame([(t,) for t in text], "t string").select(common.ascii_lower(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == ["Àbc", "abc", "İk", "", ""]
