"""Streams over the event log: latest state, counts, duplicates, windows, sessions, stuck runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspark.session import shared

#: The state store of the keyed streams.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(spark: SparkSession, sf_dir: str, name: str = "events", files_a_trigger: int = 64) -> DataFrame:
    """A table's Parquet files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # as a pattern, so that a table of one file is as good as a folder
    path = f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def drain(df: DataFrame, mode: str, name: str) -> DataFrame:
    """All that is available now, in a memory table: for small results. Where the session has a checkpoint folder, the stream's state lies there."""
    spark = df.sparkSession
    w = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if mode == "complete" and (shared := spark.conf.get("spark.checkpoint.dir", None)):  # a memory table can recover in this mode only
        w = w.option("checkpointLocation", f"{shared}/stream-{name}")
    w.start().awaitTermination()
    return spark.table(name)


def drain_to(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that is available now, appended to a Parquet table at ``path``; both folders are shared, so a lost executor costs nothing."""
    df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """All that is available now, as a new table below the shared folder: for results of any size."""
    path = f"{shared(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    return drain_to(df, f"{path}/table", f"{path}/state")


def latest(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The latest values of each key (update or complete mode)."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_r")).select(key, "_r.*")


def counts(events: DataFrame, by: list[str], done: Column) -> DataFrame:
    """n and done of each group, and whether all are done."""
    n = events.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(done, 1).otherwise(0)).alias("done"))
    return n.withColumn("complete", F.col("n") == F.col("done"))


def distinct(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Retried entries once, within the watermark: state stays bounded."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, ts: str, width: str, late: str, *by: str) -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str = "1 day") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def _keyed(df: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    """``processor`` by key over a stream with column ``at``: its state lies in RocksDB, so it is bounded by disk and not by memory."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df.withWatermark("at", "1 minute").groupBy("key").transformWithStateInPandas(processor, schema, "append", "eventTime")


class _Timed(StatefulProcessor):
    """One typed value a key, which is dropped ``minutes`` of event time after the key's last news."""

    state: str

    def __init__(self, minutes: int):
        self.wait = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", self.state)

    def keep(self, value: tuple, at) -> None:
        """Holds ``value`` until ``wait`` after ``at``; there is one timer a key."""
        self.drop()
        self.value.update(value)
        self.handle.registerTimer(int(at.timestamp() * 1000) + self.wait)

    def drop(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.value.clear()

    def close(self) -> None:
        pass


class _Stuck(_Timed):
    state = "status string"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        b = pd.concat(list(rows)).sort_values("at", kind="stable")
        status = b["status"].iloc[-1]
        if status == "running":
            self.keep((status,), b["at"].iloc[-1])
        else:
            self.drop()
            yield pd.DataFrame({"key": [key[0]], "status": [status]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.value.clear()
        yield pd.DataFrame({"key": [key[0]], "status": ["failed"]})


class _Live(_Timed):
    state = "n long, until long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        b = pd.concat(list(rows)).sort_values("at", kind="stable")
        n, until = self.value.get() if self.value.exists() else (0, 0)
        told = []
        for at in b["at"]:
            now = int(at.timestamp() * 1000)
            n = 1 if now > until else n + 1  # by event time, whenever the timer comes
            until = now + self.wait
            told.append(n)
        self.keep((n, until), b["at"].iloc[-1])
        yield pd.DataFrame({"key": key[0], "status": b["status"].to_numpy(), "n": told})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.value.clear()
        return iter([])


def stuck(runs: DataFrame, minutes: int = 60) -> DataFrame:
    """(key, status): runs (key, status, at) as they end, and "failed" for those without news for ``minutes`` of event time; state goes with them."""
    return _keyed(runs, _Stuck(minutes), "key string, status string")


def stuck_batch(runs: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """The same over a table: a latest status of running that is too old counts as failed."""
    last = runs.groupBy("key").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))
    old = (F.col("status") == "running") & (F.col("at") < now - F.expr(f"interval {minutes} minutes"))
    return last.withColumn("status", F.when(old, "failed").otherwise(F.col("status")))


def live(jobs: DataFrame, hours: int = 24) -> DataFrame:
    """(key, status, n): each news of a job with how many it has had; a job without news for ``hours`` of event time is forgotten, and begins anew."""
    return _keyed(jobs, _Live(60 * hours), "key string, status string, n long")


def evict(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Jobs but those that ended more than ``hours`` ago."""
    ended = F.col("status").isin("done", "failed", "skipped")
    return jobs.filter(~ended | (F.col("at") >= now - F.expr(f"interval {hours} hours")))
