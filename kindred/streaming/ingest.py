"""Ingest as a stream: idempotent staging, superseding versions and windowed counts.

State is kept in tables that each micro-batch replaces or adds to; nothing is left out for being late.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kindred.operators.store import latest, upsert


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class CountedWindows:
    """Events of each kind by window, once each, however late they come: a part for each micro-batch, added up when read.

    A batch counts the events that no earlier batch has, and keeps them; a batch that is repeated replaces its part.
    ``path`` must be in a folder that driver and executors share.
    """

    def __init__(self, spark: SparkSession, path: str, id: str, time: str, kind: str, window: str = "day"):
        self.spark, self.path, self.id, self.time, self.kind, self.window = spark, path.rstrip("/"), id, time, kind, window
        self.parts: list[int] = []

    def _read(self, what: str, parts: list[int]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{what}-{k}" for k in parts))

    def apply(self, batch: DataFrame, number: int) -> None:
        # of copies in a batch the least stands for all, whatever the order they are read in
        once = batch.groupBy(self.id).agg(F.min(F.struct(self.time, self.kind, "value")).alias("e"))
        if earlier := [k for k in self.parts if k < number]:
            once = once.join(self._read("events", earlier).select(self.id), self.id, "left_anti")
        once.select(self.id, "e.*").write.mode("overwrite").parquet(f"{self.path}/events-{number}")
        cents = F.sum(F.round(F.col("value") * 100).cast("long"))
        counts = self._read("events", [number]).groupBy(F.date_trunc(self.window, self.time).alias("window"), self.kind).agg(F.count("*").alias("n"), cents.alias("cents"))
        counts.write.mode("overwrite").parquet(f"{self.path}/counts-{number}")
        self.parts = [*earlier, number]

    def read(self) -> DataFrame:
        return self._read("counts", self.parts).groupBy("window", self.kind).agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


class StagedTable:
    """A table that micro-batches upsert: a version a batch, the newest readable, a batch that is repeated changes nothing.

    ``path`` must be in a folder that driver and executors share. The batch that a version comes from is in the name of
    its folder, and counts once its writer has marked it as whole: a driver that starts again goes on from there.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, version: str, tie: str):
        self.spark, self.path, self.key, self.version, self.tie = spark, path.rstrip("/"), key, version, tie
        whole = [(int(name[1:].split("-")[0]), name) for name in self._folders()]
        self.done, name = max(whole, default=(-1, ""))
        self.current: str | None = f"{self.path}/{name}" if name else None

    def _folders(self) -> list[str]:
        """Versions that were written to the end."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        pattern = hadoop(f"{self.path}/v*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return [f.getPath().getParent().getName() for f in found]

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(self.current) if self.current else None

    def apply(self, batch: DataFrame, number: int) -> None:
        if number <= self.done:
            return
        new = latest(batch, self.key, self.version, self.tie)
        if (old := self.read()) is not None:
            touched = old.join(new.select(self.key).distinct(), self.key, "left_semi")
            new = upsert(old, latest(touched.unionByName(new.select(*touched.columns)), self.key, self.version, self.tie).select(*old.columns), self.key)
        target = f"{self.path}/v{number}-{uuid.uuid4().hex[:8]}"
        new.write.parquet(target)
        self.current, self.done = target, number


def run_to_end(stream: DataFrame, checkpoint: str, **sink) -> None:
    """Run a stream over all that is there. ``sink``: ``batch`` (a function of a frame and a number), or ``table`` and ``mode`` for memory."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if "batch" in sink:
        query = writer.foreachBatch(sink["batch"]).outputMode(sink.get("mode", "append")).start()
    else:
        query = writer.format("memory").queryName(sink["table"]).outputMode(sink.get("mode", "append")).start()
    query.awaitTermination()
