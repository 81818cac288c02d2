"""Incremental work: cancelling by generation, progress, and files as they arrive.

The engine has no event-time streams. Work is lazy: a window or a first hit stops as soon
as it is found, a newer request cancels the jobs of older ones, and a folder of
growing line files can be followed as a stream of records.
"""

from __future__ import annotations

import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Generations:
    """Requests of one document: a new one cancels the jobs of those before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.now, self.lock = spark, name, 0, threading.Lock()

    def _tag(self, generation: int) -> str:
        return f"rowatlas-{self.name}-{generation}"

    @contextmanager
    def newest(self):
        """Jobs inside belong to a new generation."""
        with self.lock:
            self.now += 1
            mine = self.now
        if mine > 1:
            self.spark.interruptTag(self._tag(mine - 1))
        self.spark.addTag(self._tag(mine))
        try:
            yield mine
        finally:
            self.spark.removeTag(self._tag(mine))

    def cancelled(self, observed: int) -> bool:
        return observed != self.now

    def cancel(self) -> int:
        with self.lock:
            self.spark.interruptTag(self._tag(self.now))
            self.now += 1
            return self.now


def progress(spark: SparkSession) -> list[tuple[int, int, int]]:
    """(stage, tasks done, tasks) of the stages that run."""
    tracker = spark.sparkContext.statusTracker()
    found = [(s, tracker.getStageInfo(s)) for s in tracker.getActiveStageIds()]
    return [(s, i.numCompletedTasks, i.numTasks) for s, i in found if i]


def follow_lines(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Lines of files that appear under a folder, with file, size and time of change."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("changed"))


def counted(lines: DataFrame) -> DataFrame:
    """Records and bytes so far, by file: a running summary of a stream or a table."""
    return lines.groupBy("path").agg(F.count("*").alias("records"), F.sum(F.octet_length("value")).cast("long").alias("payload_bytes"))
