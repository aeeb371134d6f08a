"""Running numbers over a total order, and over the rows of files in the order in which they stand there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import free_name, materialize, named

#: Blocks whose starts are broadcast (paths of some hundred bytes: tens of megabytes); beyond it rows meet them by a shuffle.
BROADCAST_BLOCKS = 200_000

#: The lower 33 bits of monotonically_increasing_id count the rows of a task.
_ROW = (1 << 33) - 1


def sorted_ranges(df: DataFrame, order: list[Column | str], part: str = "_part", at: str = "_at") -> DataFrame:
    """df sorted by ``order`` (names: ascending, nulls last), written as ranges of that order, with each row's range and its place there from 0.

    Ranges are cut at sampled bounds, so no task sorts all rows; rows that are equal in order come as they were read, and a
    number of their own as the last key lets even equal rows be cut apart.
    """
    keys = [F.asc_nulls_last(o) if isinstance(o, str) else o for o in order]
    own = free_name(df, "_own")
    ranged = df.withColumn(own, F.monotonically_increasing_id()).orderBy(*keys, own)
    return materialize(ranged.select(*named(df), F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(_ROW).alias(at)), "ranges")


def _starts(sizes: DataFrame, keys: list[str], n: str, name: str) -> DataFrame:
    """Prefix sums of n over the rows of sizes in the order of keys: a row a range or block, so one task has them all."""
    return sizes.withColumn(name, F.sum(n).over(Window.orderBy(*keys)) - F.col(n))


def numbered(df: DataFrame, order: list[Column | str], name: str, first: int = 0) -> DataFrame:
    """df plus running numbers from ``first`` in the given order (see sorted_ranges).

    The rows of each range are counted (a number a range), counts are summed up, and a row's number is the start of its range
    plus its place: two passes over a sorted table, no window over rows.
    """
    part, at, start = free_name(df, "_part"), free_name(df, "_at"), free_name(df, "_start")
    ranges = sorted_ranges(df, order, part, at)
    starts = _starts(ranges.groupBy(part).agg(F.count("*").alias("_n")), [part], "_n", start).drop("_n")
    met = ranges.join(F.broadcast(starts.withColumnRenamed(part, "_of")), F.col(part) == F.col("_of"))
    return met.select(*named(df), (F.col(start) + F.col(at) + first).alias(name))


def with_file_row(df: DataFrame, name: str = "file_row", path: str | None = None) -> DataFrame:
    """df, read from files and not yet filtered or shuffled, plus each row's number in its file from 0; ``path`` names a further column for the file.

    The scan tells a row's file and the start of the block it was read with, and a task reads a block's rows in order. Blocks are
    counted (a row a block), counts are summed up within a file, and a row's number is its block's start plus its place there. The
    files are read twice: once to count, for which no column is needed, once for the rows. Files must not change between.
    Lines that the reader drops don't count, and it must drop the same ones whatever columns it is asked for.
    """
    at, file, block = (free_name(df, c) for c in ("_at", "_file", "_block"))
    placed = df.select(*named(df), F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().bitwiseAND(_ROW).alias(at))
    blocks = placed.groupBy(file, block).agg(F.count("*").alias("_n"), F.min(at).alias("_low"))
    starts = blocks.withColumn("_start", F.sum("_n").over(Window.partitionBy(file).orderBy(block)) - F.col("_n"))
    side = materialize(starts.select(F.col(file).alias("_f"), F.col(block).alias("_b"), (F.col("_start") - F.col("_low")).alias("_shift")), "blocks")
    side = F.broadcast(side) if side.count() <= BROADCAST_BLOCKS else side
    met = placed.join(side, (F.col(file) == F.col("_f")) & (F.col(block) == F.col("_b")))
    return met.select(*named(df), *([F.col(file).alias(path)] if path else []), (F.col(at) + F.col("_shift")).alias(name))
