"""Streams: upserts by key, windows with late data, duplicates within a watermark, a custom stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidex.operators.merge import upsert


class VersionedTable:
    """A table of Parquet versions with a pointer to the current one, replaced by one rename.

    Readers see the old version until the new one is complete. The pointer names the stream's batch
    that made it, so that a batch run again after a failure is not merged twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> tuple[int, str] | None:
        """(batch, folder) of the current version."""
        names = []
        if self._fs.exists(self._path(self.path)):
            names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        done = sorted(int(n[5:]) for n in names if n.startswith("done-"))
        return (done[-1], f"{self.path}/v-{done[-1]}") if done else None

    def read(self) -> DataFrame | None:
        now = self.current()
        return self.spark.read.parquet(now[1]) if now else None

    def commit(self, df: DataFrame, batch: int) -> None:
        folder = f"{self.path}/v-{batch}"
        df.write.mode("overwrite").parquet(folder)
        self._fs.create(self._path(f"{self.path}/done-{batch}")).close()
        for status in self._fs.listStatus(self._path(self.path)):  # the version before stays for its readers
            name = status.getPath().getName()
            number = name.rpartition("-")[2]
            if name.startswith(("v-", "done-")) and int(number) < batch - 1:
                self._fs.delete(status.getPath(), True)


def upsert_stream(stream: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Merges a stream into the versioned table at ``path`` by key, greatest ``order`` last; takes what is there, then ends.

    A batch that was merged already is skipped, so that a replay leaves the same state.
    """
    table = VersionedTable(stream.sparkSession, path)

    def merge(batch: DataFrame, number: int) -> None:
        now = table.current()
        if now and now[0] >= number:
            return
        old = table.read()
        rows = batch if old is None else old.unionByName(batch)
        table.commit(upsert(rows.limit(0), rows, key, order), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str | None = "2 hours", slide: str | None = None) -> DataFrame:
    """Count and sum of ``events`` (ts, event_type, value) per window and type; rows later than ``late`` are left out.

    None for ``late`` keeps the watermark that ``events`` already have.
    """
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    events = events.withWatermark("ts", late) if late else events
    found = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users, by a gap in event time."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return found.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "user_id", "n")


def once_by_id(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Events without repeats of an id within the watermark: the state of a seen id expires with it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) after each batch, by a custom stateful operator over Arrow batches."""

    def add(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in parts:
            n += len(pdf)
            total += float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    schema = "user_id long, n long, total double"
    return events.groupBy("user_id").applyInPandasWithState(add, schema, "n long, total double", "update", GroupStateTimeout.NoTimeout)
