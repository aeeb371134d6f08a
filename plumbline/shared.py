"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder in local mode and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the application's own folder, which may be removed when the application has ended."""
    return f"{shared_dir(spark)}/plumbline-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to a fresh path and reads it back, so that a lost executor costs a re-read only."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front, so that it clashes with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def named(df: DataFrame) -> list:
    """All columns of df, whatever characters their names hold."""
    from pyspark.sql import functions as F

    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
