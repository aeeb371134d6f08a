"""Queries that write what they derive from the tables and read it back, so that sinks and sources are checked on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import new_path
from ..sources import files as R
from ..sources import formats as M
from .adapters import clouds, objects, objects_sql, read

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


@query("csv_round_trip", "SELECT event_id, user_id, event_type, value, props FROM events")
def csv_round_trip(spark, sf_dir):
    """Events, with JSON texts full of quotes and commas, through a folder of CSV."""
    path = new_path(spark, "csv")
    R.write_csv(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props"), path)
    return R.read_csv_sniffed(spark, path, "event_id long, user_id long, event_type string, value double, props string")


@query("jsonl_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, sf_dir):
    path = new_path(spark, "jsonl")
    R.write_jsonl(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path)
    return R.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query("scene_folders", f"{objects_sql()} SELECT scene_id, object_id, label_norm, n_points FROM obj")
def scene_folders(spark, sf_dir):
    """Objects in a folder a scene; the scene comes back from the folders' names."""
    path = new_path(spark, "scenes")
    R.write_by_scene(objects(spark, sf_dir).select("scene_id", "object_id", "label_norm", "n_points"), path)
    return R.read_csv(spark, path, "object_id string, label_norm string, n_points int, scene_id string").select("scene_id", "object_id", "label_norm", "n_points")


@query("npz_round_trip", f"{objects_sql()} SELECT object_id, pt_idx, {', '.join(f'round({k}::FLOAT::DOUBLE, 4) AS {k}' for k in 'xyz')} FROM pts")
def npz_round_trip(spark, sf_dir):
    """Clouds through a file an object, in 32-bit numbers."""
    path = new_path(spark, "npz")
    M.write_npz_points(clouds(spark, sf_dir, objects(spark, sf_dir)), path, compressed=False)
    return M.read_npz_points(spark, path).select("object_id", "pt_idx", *[F.round(F.col(k).cast("double"), 4).alias(k) for k in "xyz"])


@query("resumed_responses", "SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN 'first run' ELSE 'second run' END AS answer FROM orders")
def resumed_responses(spark, sf_dir):
    """A run that answered a third of the questions, and one that took it up again."""
    path, asked = new_path(spark, "responses"), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"))
    R.append_responses(asked.where("query_id % 3 = 0"), path, F.lit("first run"))
    return R.append_responses(asked, path, F.lit("second run"))
