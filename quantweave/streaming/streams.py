"""Event streams: bars, duplicates, scores, states and late rows, with the meaning of their batch operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..scratch import new_path


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream, read as they come."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def ohlcv(ticks: DataFrame, interval: str, watermark: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    out = ticks.withWatermark("ts", watermark).groupBy(F.window("ts", interval), F.col("user_id").alias("symbol")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return out.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("bar"), "open", "high", "low", "close", "volume")


def dedupe(rows: DataFrame, watermark: str) -> DataFrame:
    rows = rows.select("user_id", "event_type", F.to_date("ts").alias("day"), "ts").withWatermark("ts", watermark)
    return rows.dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]).select("user_id", "event_type", "day")


def score(rows: DataFrame, span: str, decay: float, watermark: str = "2 days") -> DataFrame:
    """symbol, day, score: events weighed by their age at the end of the window."""
    s = F.when(F.col("event_type") == "error", -0.3).when(F.col("event_type") == "purchase", 0.3).otherwise(0.0)
    w = F.window("ts", span)
    x = rows.withWatermark("ts", watermark).select("user_id", "ts", s.alias("s"), w.alias("w"))
    age = (F.unix_micros(F.col("w.end")) - F.unix_micros(F.col("ts"))) / 86_400e6
    return x.withColumn("x", F.col("s") * F.exp(-decay * age)).groupBy("w", F.col("user_id").alias("symbol")).agg(F.sum("x").alias("score")).select("symbol", F.col("w.start").cast("timestamp_ntz").alias("day"), "score")


def regime(rows: DataFrame, enter: float, exit_: float) -> DataFrame:
    """user_id, state, n: a 0/1 state per key that turns on at enter and off at exit_: the last decisive value decides.

    Late rows take their place by event time, whatever micro-batch brings them.
    """
    if exit_ >= enter:
        raise ValueError("the exit threshold must be below the enter threshold")
    decisive = F.when(F.col("value") >= enter, 1).when(F.col("value") <= exit_, 0)
    at = F.when(decisive.isNotNull(), F.struct("ts", "event_id"))  # rows without an order don't count
    return rows.groupBy("user_id").agg(F.coalesce(F.max_by(decisive, at), F.lit(0)).alias("state"), F.count(F.lit(1)).alias("n"))


class RegimeMachine(StatefulProcessor):
    """One key's state: off or on, since when, the event that decided it, and how many events there were.

    A value at `enter` or above turns it on, one at `exit_` or below turns it off, others leave it. Events of a batch are
    taken in order of time; one that is older than the deciding event counts, but changes nothing. After `idle` seconds without an
    event a key begins anew; a timer takes it out of the store then, with a last row that says so.
    """

    def __init__(self, enter: float, exit_: float, idle: float) -> None:
        self.enter, self.exit, self.idle = enter, exit_, int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state int, since_us long, at_us long, event_id long, n long, last_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.held.get() if self.held.exists() else None
        state, since, at, event, n, last = held or (0, None, None, None, 0, None)
        for part in rows:
            part = part.dropna(subset=["ts"])
            us = part["ts"].astype("datetime64[us]").astype("int64")
            for t, e, v in sorted(zip(us.tolist(), part["event_id"].tolist(), part["value"].tolist())):
                if last is not None and t - last > 1000 * self.idle:  # idle before this event, whether a timer has said so or not
                    state, since, at, event, n = 0, None, None, None, 0
                n, last = n + 1, max(t, last) if last is not None else t
                new = 1 if v >= self.enter else 0 if v <= self.exit else None
                if new is not None and (at is None or (t, e) > (at, event)):
                    since = t if new != state or since is None else since
                    state, at, event = new, t, e
        if last is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + self.idle)
            self.held.update((state, since, at, event, n, last))
            yield self._row(key, state, since, n, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.held.exists():
            state, since, _, _, n, _ = self.held.get()
            self.held.clear()
            yield self._row(key, state, since, n, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, state, since, n, lapsed) -> pd.DataFrame:
        at = pd.Series([pd.NaT if since is None else pd.Timestamp(since, unit="us")], dtype="datetime64[us]")
        return pd.DataFrame({"user_id": [key[0]], "state": [state], "since": at, "n": [n], "lapsed": [lapsed]})


def regime_machine(rows: DataFrame, enter: float, exit_: float, watermark: str = "40 days", idle: float = 90 * 86_400) -> DataFrame:
    """user_id, state, since, n, lapsed: each key's state after a batch in which it had events, or when it lapses (see RegimeMachine).

    The store holds one small row a key that is not idle. Rows that come later than the watermark are dropped. The state is
    kept by RocksDB: run it by run_to_end(), or set that provider.
    """
    if exit_ >= enter:
        raise ValueError("the exit threshold must be below the enter threshold")
    kind = dict(rows.dtypes)["user_id"]
    x = rows.select("user_id", "event_id", "ts", F.col("value").cast("double").alias("value")).withWatermark("ts", watermark)
    machine = RegimeMachine(enter, exit_, idle)
    return x.groupBy("user_id").transformWithStateInPandas(machine, f"user_id {kind}, state int, since timestamp, n long, lapsed boolean", "update", "eventTime")


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """Streams that begin within keep their state in RocksDB, as keyed machines need it."""
    name, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, own)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def keep_batch(batch: DataFrame, number: int, folder: str) -> None:
    """Write a micro-batch to a folder of its own number: a batch that is run again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def run_to_end(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run what is there through the stream and read the result back from the shared folder.

    Of complete output the last batch counts; of update output the last row of each key (`keys`).
    """
    spark = stream.sparkSession
    if mode == "update" and not keys:
        raise ValueError("update output needs the keys of its rows")
    out, check = new_path(spark, "stream"), new_path(spark, "stream-checkpoint")
    stream.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(lambda batch, number: keep_batch(batch, number, out)).start().awaitTermination()
    got = spark.read.schema(f"{_ddl(stream)}, batch long").parquet(out)
    if mode == "complete":
        got = got.join(F.broadcast(got.agg(F.max("batch").alias("batch"))), "batch", "left_semi")
    elif mode == "update":
        last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
        got = got.withColumn("_r", F.row_number().over(last)).filter("_r = 1")
    return got.select(*stream.columns)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def split_late(rows: DataFrame, cut: datetime) -> tuple[DataFrame, DataFrame]:
    """(on time, late): rows after the cut go to a sink of their own."""
    spark = rows.sparkSession
    good, late, check = new_path(spark, "on-time"), new_path(spark, "late"), new_path(spark, "late-checkpoint")

    def keep(batch: DataFrame, number: int) -> None:
        is_late = F.coalesce(F.col("ts") > F.lit(cut), F.lit(False))
        keep_batch(batch.filter(~is_late), number, good)
        keep_batch(batch.filter(is_late), number, late)

    rows.writeStream.option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    read = spark.read.schema(f"{_ddl(rows)}, batch long")
    return read.parquet(good).select(*rows.columns), read.parquet(late).select(*rows.columns)
