"""The keyed state machine: batches, restarts from a checkpoint, late rows, and keys that lapse."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantweave.streaming import streams

SCHEMA = "event_id long, user_id long, ts timestamp, value double"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, **options):
    """Whatever is new, with the same checkpoint; the last row of each key of all runs."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with streams.keyed_store(spark):
        query = streams.regime_machine(stream, 300.0, 20.0, **options).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check"))
        query.trigger(availableNow=True).foreachBatch(lambda b, i: streams.keep_batch(b, i, str(tmp_path / "out"))).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    last = Window.partitionBy("user_id").orderBy(F.desc("batch"), F.desc("n"))
    return {r.user_id: (r.state, r.since, r.n, r.lapsed) for r in got.withColumn("r", F.row_number().over(last)).filter("r = 1").collect()}


def test_restarts_and_late_rows_give_the_batch_result(spark, tmp_path):
    parts = [
        [(1, 1, at(1), 400.0), (2, 2, at(2), 50.0), (3, 3, at(5), 10.0), (9, None, at(5), 500.0)],
        [(4, 1, at(3), 10.0), (5, 2, at(0), 500.0), (6, 3, None, 900.0), (7, 3, at(6), None)],
        [(8, 1, at(2), 600.0), (10, 2, at(9), 20.0), (11, 2, at(9), 300.0)],
    ]
    put(spark, str(tmp_path / "in"), parts[0])
    run(spark, tmp_path)
    for part in parts[1:]:
        put(spark, str(tmp_path / "in"), part)
        got = run(spark, tmp_path)  # a new query each time, from what the last one left
    rows = [r for part in parts for r in part if r[2] is not None]
    for user in (1, 2, 3, None):
        own = sorted((t, e, v) for e, u, t, v in rows if u == user)
        decided = [(1 if v >= 300 else 0, t) for t, _, v in own if v is not None and (v >= 300 or v <= 20)]
        assert got[user][0] == decided[-1][0] and got[user][2] == len(own) and not got[user][3]
    assert got[1] == (0, at(3), 3, False) and got[2][1] == at(9)
    with pytest.raises(ValueError):
        streams.regime_machine(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 1.0, 2.0)


def test_idle_keys_leave_the_store_and_begin_anew(spark, tmp_path):
    for part in ([(1, 1, at(0), 400.0), (2, 2, at(0), 400.0)], [(3, 2, at(60), 1.0)], [(4, 2, at(200), 50.0)], [(5, 1, at(210), 50.0), (6, 2, at(211), 50.0)]):
        put(spark, str(tmp_path / "in"), part)
        got = run(spark, tmp_path, watermark="1 minute", idle=90 * 60)
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("user_id", "state", "n", "lapsed").collect()]
    assert (1, 1, 1, True) in rows  # it was on when it lapsed
    assert got[1][0] == 0 and got[1][2] == 1 and not got[1][3]
    assert got[2][2] == 2  # it lapsed after an hour, and came back with two events
