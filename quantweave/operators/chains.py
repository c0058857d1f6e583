"""Contiguous runs, states and spans along a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hysteresis(rows: DataFrame, value: str, enter: float, exit_: float, keys: list[str], at: str = "date", state: str = "state") -> DataFrame:
    """rows with a 0/1 state that turns on at `enter` and off at `exit_`: the last value that was decisive decides."""
    if exit_ >= enter:
        raise ValueError("the exit threshold must be below the enter threshold")
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    decisive = F.when(F.col(value) >= enter, 1).when(F.col(value) <= exit_, 0)
    return rows.withColumn(state, F.coalesce(F.last(decisive, ignorenulls=True).over(w), F.lit(0)))


def runs(rows: DataFrame, state: Column, keys: list[str], at: str = "date") -> DataFrame:
    """keys, run, state, start, stop (start of the next run, null for the last), n of contiguous equal states."""
    w = Window.partitionBy(*keys).orderBy(at)
    marked = rows.withColumn("_s", state)
    marked = marked.withColumn("_new", F.coalesce((~F.col("_s").eqNullSafe(F.lag("_s").over(w))).cast("int"), F.lit(1)))
    marked = marked.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("_new"))).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*keys, "run").agg(F.first("_s").alias("state"), F.min(at).alias("start"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("stop", F.lead("start").over(Window.partitionBy(*keys).orderBy("run")))
