"""Readers and writers of the pipeline's tables: CSV, JSON lines, JSON documents, lists, key-value files, Parquet."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .formats import opened


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """CSV with a header and a declared schema; empty fields are null. Nothing is inferred, so no extra pass."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, nullValue="", multiLine=False, escape='"')


def separators(spark: SparkSession, path: str) -> DataFrame:
    """(path, separator) of each file: ";" if its first line has one, else ",". Tasks read the heads of the files, which Spark lists without their content."""

    def heads(batches: Iterator[pd.DataFrame], most: int = 1 << 16) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = []
            for p in x["path"]:
                with opened(p) as f:
                    found.append(";" if b";" in f.read(most).split(b"\n", 1)[0] else ",")
            yield pd.DataFrame({"path": x["path"], "separator": found})

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(spark.sparkContext.defaultParallelism).mapInPandas(heads, "path string, separator string")


def read_csv_sniffed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV files of either separator, each by its own. A trailing separator on each line (an unnamed last column) does no harm. A path a file reaches the driver, as in any listing."""
    found = separators(spark, path).collect()
    parts = [read_csv(spark, sorted(r["path"] for r in found if r["separator"] == sep), schema, sep) for sep in sorted({r["separator"] for r in found})]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def read_csv_ragged(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose lines may have fewer or more fields than the schema: missing ones are null, the line is kept.

    _corrupt_record holds the raw text of lines that don't fit, short ones included, so it is a remark, not a filter.
    """
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", nullValue="", enforceSchema=True, escape='"')


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: Segment groups of a scene, and segment numbers by vertex.
GROUPS = "sceneId string, segGroups array<struct<id: int, objectId: int, label: string, segments: array<int>>>"
SEGMENTS = "sceneId string, segIndices array<int>"


def read_segment_groups(spark: SparkSession, path: str) -> DataFrame:
    """groups(scene_id, instance_id_raw, label_raw, segments) from one JSON document a scene."""
    d = spark.read.schema(GROUPS).json(path, multiLine=True)
    g = d.select(F.col("sceneId").alias("scene_id"), F.explode("segGroups").alias("g"))
    return g.select("scene_id", F.coalesce("g.objectId", "g.id").alias("instance_id_raw"), F.col("g.label").alias("label_raw"), F.col("g.segments").alias("segments"))


def read_vertex_segments(spark: SparkSession, path: str) -> DataFrame:
    """vertex_segments(scene_id, vertex_idx, seg_id) from one JSON document a scene."""
    d = spark.read.schema(SEGMENTS).json(path, multiLine=True)
    return d.select(F.col("sceneId").alias("scene_id"), F.posexplode("segIndices").alias("vertex_idx", "seg_id"))


def read_list(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """Non-blank lines, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.length(name) > 0)


def read_key_value(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(path, value): of each text file the value after the first "=" on the first line that begins with the key, lower-cased; "unknown" without one."""
    value = F.regexp_extract("value", rf"(?im)^[ \t]*{key}[^=\n]*=([^\n]*)$", 1)
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.lower(F.trim(F.regexp_replace(value, r"\r", ""))).alias("value"))
    return text.withColumn("value", F.when(F.col("value") == "", "unknown").otherwise(F.col("value")))


def read_config(spark: SparkSession, path: str) -> dict:
    """A small YAML file of nested maps, lists and scalars (two-space steps), read on the driver through Spark's file systems."""
    rows = spark.read.text(path, wholetext=True).first()
    return parse_config(rows["value"] if rows else "")


def parse_config(text: str) -> dict:
    root: dict = {}
    stack: list[tuple[int, dict | list]] = [(-1, root)]
    lines = [ln.split(" #")[0].rstrip() for ln in text.splitlines()]
    lines = [ln for ln in lines if ln.strip() and not ln.lstrip().startswith("#")]
    for n, line in enumerate(lines):
        depth, body = len(line) - len(line.lstrip()), line.strip()
        while stack[-1][0] >= depth:
            stack.pop()
        at = stack[-1][1]
        if body.startswith("- "):
            at.append(_scalar(body[2:]))
            continue
        key, _, value = body.partition(":")
        key = str(_scalar(key))
        if value.strip():
            at[key] = _scalar(value)
        else:
            inner = lines[n + 1].strip() if n + 1 < len(lines) else ""
            at[key] = [] if inner.startswith("- ") else {}
            stack.append((depth, at[key]))
    return root


def _scalar(text: str):
    s = text.strip()
    if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"":
        return s[1:-1]
    if s.lower() in ("true", "false"):
        return s.lower() == "true"
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return None if s in ("null", "~") else s


# ---- Sinks ----


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header, quotes doubled as read_csv reads them. one_file gathers all rows in one task: for small reports only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, in a folder a key if ``by`` is given."""
    out = df.write.mode(mode)
    (out.partitionBy(*by) if by else out).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_by_scene(df: DataFrame, path: str) -> None:
    """One folder of CSV a scene; rows of a scene go to few files."""
    df.repartition("scene_id").write.mode("overwrite").partitionBy("scene_id").csv(path, header=True, escape='"')


def append_responses(requests: DataFrame, done_path: str, answer: Column, key: str = "query_id") -> DataFrame:
    """Answers the requests that have no stored answer yet and appends them as Parquet; returns all stored answers.

    A run that stops half-way is taken up again: what was committed isn't asked twice.
    """
    spark = requests.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(done_path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        requests = requests.join(spark.read.parquet(done_path).select(key), key, "left_anti")
    requests.withColumn("answer", answer).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)


def metrics_text(metrics: DataFrame) -> DataFrame:
    """A one-row table of metrics as "name = value" lines."""
    cols = metrics.columns
    return metrics.select(F.explode(F.array(*[F.concat(F.lit(f"{c} = "), F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in cols])).alias("value"))
