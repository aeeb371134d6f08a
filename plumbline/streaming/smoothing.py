"""Exponential smoothing of a stream in event-time order: rows wait until the watermark has passed them, so late and shuffled rows find their place."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.smoothing import Run, numbers

#: The state store that timers and lists of rows need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Smoother(StatefulProcessor):
    """Per key: the rows that the watermark hasn't passed, and the state smoothed so far. A timer behind each row's time lets due rows out, in order of
    time and the further columns; one ``idle`` milliseconds after the last row forgets the key."""

    def __init__(self, key: str, time: str, order: list[str], kinds: dict[str, str], alpha: float, idle: int):
        self.key, self.time, self.order, self.alpha, self.idle = key, time, order, alpha, idle
        self.row = ", ".join(["us long", *[f"o{i} {kinds[o]}" for i, o in enumerate(order)], "v array<double>"])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.so_far = handle.getValueState("so_far", "v array<double>, us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # columns by place: key, time, order, microseconds, value (Spark renames some columns on the way here)
        for x in rows:
            values = [None if v is None else [None if y is None else float(y) for y in v] for v in x.iloc[:, -1]]
            orders = [x.iloc[:, 2 + i].tolist() for i in range(len(self.order))]
            us = x.iloc[:, -2].astype("int64").tolist()
            self.waiting.appendList(list(zip(us, *orders, values, strict=True)))
            for ms in {u // 1000 + 1 for u in us}:  # the first millisecond behind the row, which the watermark can't have passed
                self.handle.registerTimer(ms)
                self.handle.registerTimer(ms + self.idle)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the watermark has reached the timer, so no row before it can come any more
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000 - 1
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in waiting if r[0] <= passed), key=lambda r: tuple((v is None, 0 if v is None else v) for v in r[:-1]))
        was, last = self.so_far.get() if self.so_far.exists() else (None, None)
        if not due:
            if last is not None and not waiting and last <= passed - self.idle * 1000:
                self.so_far.clear()
            return iter([])
        state, out = Run(self.alpha, False), []
        state.b = None if was is None else list(was)
        for r in due:
            state.add(None if r[-1] is None else list(r[-1]))
            out.append(state.b)
        self.so_far.update((state.b, due[-1][0]))
        if left := [r for r in waiting if r[0] > passed]:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        made = {self.key: [key[0]] * len(due), self.time: pd.to_datetime([r[0] for r in due], unit="us", utc=True)}
        made |= {o: [r[1 + i] for r in due] for i, o in enumerate(self.order)}
        yield pd.DataFrame(made | {"value": [r[-1] for r in due], "smoothed": out})

    def close(self) -> None:
        pass


def smooth_shapes(rows: DataFrame, key: str, time: str, value: str, order: tuple[str, ...] = (), alpha: float = 0.8, late: str = "10 minutes", idle: timedelta = timedelta(days=1)) -> DataFrame:
    """A stream's boxes or points smoothed as by operators.smoothing.smooth_shapes, in order of time and ``order``: key, time, order, value, smoothed.

    A row leaves once the watermark (``late`` behind the newest time) has passed it; rows that come later than that are dropped, as are
    rows without a time. So the result is that of a batch over the same rows, however they are dealt over micro-batches. State is the rows
    that wait and one array a key, which is forgotten when the watermark is ``idle`` past its last row. Needs the RocksDB state store, which
    is set on the session.
    """
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = rows.where(F.col(time).isNotNull()).withWatermark(time, late)
    given = timed.select(key, time, *order, F.unix_micros(F.col(time).cast("timestamp")).alias("_us"), F.col(value).cast("array<double>").alias("_v"))
    shape = f"{key} {kinds[key]}, {time} timestamp, " + "".join(f"{o} {kinds[o]}, " for o in order) + "value array<double>, smoothed array<double>"
    smoother = Smoother(key, time, list(order), kinds, alpha, int(idle.total_seconds() * 1000))
    out = given.groupBy(key).transformWithStateInPandas(smoother, shape, "Append", "EventTime")
    return out.withColumn("smoothed", numbers("smoothed")).withColumnRenamed("value", value)


def smooth(rows: DataFrame, key: str, time: str, value: str, order: tuple[str, ...] = (), alpha: float = 0.8, late: str = "10 minutes", idle: timedelta = timedelta(days=1)) -> DataFrame:
    """A stream's numbers smoothed in event-time order (see smooth_shapes): key, time, order, value, smoothed. NaN counts as missing."""
    number = F.col(value).cast("double")
    boxed = rows.withColumn(value, F.when(number.isNotNull() & ~F.isnan(number), F.array(number)))
    out = smooth_shapes(boxed, key, time, value, order, alpha, late, idle)
    return out.withColumns({value: F.get(value, F.lit(0)), "smoothed": F.get("smoothed", F.lit(0))})
