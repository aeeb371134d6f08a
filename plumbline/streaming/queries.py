"""Streaming twins: resume without repeats, windowed counts, answers to a stream of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(requests: DataFrame, key: str = "query_id", event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each key of a stream once. With an event time, state older than the watermark is dropped."""
    if event_time:
        return requests.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])
    return requests.dropDuplicates([key])


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Answers each micro-batch of questions with the batch operators and appends to ``sink`` (Parquet, a folder a batch id, so a repeated
    batch overwrites itself). Returns the running query."""

    def run(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
