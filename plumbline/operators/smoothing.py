"""Exponential smoothing of keyed series as a scan of affine maps.

What a row does to the smoothed value s is a map s -> a s + b: a new value v gives (alpha, (1 - alpha) v), a missing one (1, 0), and a
fresh start (0, v). Maps compose to maps. So rows are sorted by key and order into ranges; each range works out, row by row,
the map from the state that comes into it; the ranges' last maps are chained (a row a range); and each row's map is then
applied to the state that came in. A key of any length is spread over the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isnan

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import free_name, materialize, named


class Run:
    """The map of a key's rows so far, from the state that came into its range: a, b, the number of values n, and c, the result if no such state
    of n values came. a is 0 once nothing of that state is left; then b alone is the state (null if there was no value yet)."""

    def __init__(self, alpha: float, open_: bool):
        self.alpha, self.a, self.b, self.c, self.n = alpha, float(open_), None, None, None

    def add(self, v: list[float] | None) -> None:
        if v is None:
            return
        missing = any(x is None or isnan(x) for x in v)
        mix = lambda s: [self.alpha * x + (1 - self.alpha) * y for x, y in zip(s, v, strict=True)]
        if self.a and self.n is None and not missing:
            self.a, self.b, self.c, self.n = self.alpha, [(1 - self.alpha) * y for y in v], v, len(v)
        elif self.a and self.n == len(v) and not missing:
            self.a, self.b, self.c = self.a * self.alpha, mix(self.b), mix(self.c)
        elif self.a:
            self.a, self.b, self.c, self.n = 0.0, v, None, None
        else:
            fresh = missing or self.b is None or len(self.b) != len(v) or any(x is None or isnan(x) for x in self.b)
            self.b = v if fresh else mix(self.b)


def applied(s: list[float] | None, a: float, b: list[float] | None, c: list[float] | None, n: int | None) -> list[float] | None:
    """The state after a run that came upon state s."""
    if not a:
        return b
    if n is None:
        return s
    if s is None or len(s) != n or any(x is None or isnan(x) for x in s):
        return c
    return [a * x + y for x, y in zip(s, b, strict=True)]


def _maps(rows: DataFrame, key: str, order: list[str], value: str, alpha: float) -> DataFrame:
    """rows, sorted into ranges and written, with the range (_part), the place (_at), whether the row's key is the range's first, and the map (_a, _b, _c, _n)."""
    wide = rows.select(*named(rows), F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")).alias("_key"))
    ranged = wide.orderBy(F.asc_nulls_last("_key"), *[F.asc_nulls_last(o) for o in order])
    added = T.StructType.fromDDL("_part int, _at long, _first boolean, _a double, _b array<double>, _c array<double>, _n int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, first, now, state = TaskContext.get().partitionId(), 0, None, None, None
        for x in batches:
            out: dict[str, list] = {c: [] for c in ("_at", "_first", "_a", "_b", "_c", "_n")}
            for k, v in zip(x.column("_key").to_pylist(), x.column(value).to_pylist(), strict=True):
                first = k if first is None else first
                if k != now:
                    now, state = k, Run(alpha, k == first)
                state.add(v)
                for c, one in zip(out, (at, k == first, state.a, state.b, state.c, state.n), strict=True):
                    out[c].append(one)
                at += 1
            kinds = [pa.int64(), pa.bool_(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32()]
            made = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array([part] * x.num_rows, pa.int32()), *made], [*x.schema.names, "_part", *out])

    return materialize(ranged.mapInArrow(run, T.StructType([*wide.schema.fields, *added.fields])), "maps")


def _carried(maps: DataFrame) -> DataFrame:
    """_of (a range) and _s, the state of its first key that comes into it: last maps chained in the order of the ranges, a row a range."""
    last = F.max_by(F.struct("_key", "_first", "_a", "_b", "_c", "_n"), "_at")
    ends = maps.groupBy("_part").agg(F.min_by("_key", "_at").alias("first"), last.alias("last"))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        plain = lambda v: None if v is None else list(v)
        for x in batches:
            out = []
            for first, r in zip(x["first"], x["last"], strict=True):
                came = state if key == first else None
                out.append(came)
                n = None if r["_n"] is None or r["_n"] != r["_n"] else int(r["_n"])
                key, state = r["_key"], applied(came if r["_first"] else None, r["_a"], plain(r["_b"]), plain(r["_c"]), n)
            yield pd.DataFrame({"_of": x["_part"], "_s": out})

    return ends.repartition(1).sortWithinPartitions("_part").mapInPandas(chain, "_of int, _s array<double>")


def numbers(v: Column | str) -> Column:
    """An array whose missing numbers are NaN."""
    return F.transform(v, lambda x: F.coalesce(x, F.lit(float("nan"))))


def smooth_shapes(rows: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.8) -> DataFrame:
    """Exponential smoothing of boxes or points (arrays of numbers) of each key in order, number by number: key, order, value, smoothed.

    alpha of what was and 1 - alpha of what comes; a missing array carries on what was, and until the first array comes the result is null.
    An array of another length than what was starts anew, as does one with a missing number (NaN in the result) or after one. Rows with a null key form a
    key; rows that are equal in key and order are taken in any order. No task needs more than its range of the sorted rows.
    """
    part, s = "_of", "_s"
    shaped = rows.select(key, *order, F.col(value).cast("array<double>").alias(value))
    maps = _maps(shaped, key, order, value, alpha)
    met = maps.join(F.broadcast(_carried(maps)), F.col("_part") == F.col(part), "left")
    usable = F.col(s).isNotNull() & (F.size(s) == F.col("_n")) & ~F.exists(F.coalesce(s, F.array().cast("array<double>")), lambda x: x.isNull() | F.isnan(x))
    mixed = F.zip_with(s, "_b", lambda x, y: F.col("_a") * x + y)
    out = F.when(F.col("_a") == 0, F.col("_b")).when(F.col("_n").isNull(), F.col(s)).when(usable, mixed).otherwise(F.col("_c"))
    return met.select(*named(shaped), numbers(out).alias("smoothed"))


def smooth(rows: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.8) -> DataFrame:
    """Exponential smoothing of each key's numbers in order (see smooth_shapes): key, order, value, smoothed. NaN counts as missing."""
    box = free_name(rows, "_box")
    number = F.col(value).cast("double")
    one = rows.select(key, *order, F.when(number.isNotNull() & ~F.isnan(number), F.array(number)).alias(box))
    out = smooth_shapes(one, key, order, box, alpha)
    return out.select(key, *order, F.get(box, F.lit(0)).alias(value), F.get("smoothed", F.lit(0)).alias("smoothed"))
