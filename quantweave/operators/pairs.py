"""Pairs of series: correlation by a self-join on dates, so that work is dates x pairs and no matrix is held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_rows(rows: DataFrame, key: str, value: str = "r", most: int = 5000) -> DataFrame:
    """a, b, date, x, y for all pairs of keys a < b that share a date. For keys of a bounded number (sectors, a book): more than `most` are refused."""
    # the bound holds for each date's keys, where the pairs are made
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    rows = rows.select("*", n.alias("_n")).filter(F.when(F.col("_n") > most, F.raise_error(F.lit(f"more than {most} series on a date"))).otherwise(F.lit(True)))
    left = rows.select(F.col(key).alias("a"), "date", F.col(value).alias("x"))
    right = rows.select(F.col(key).alias("b"), "date", F.col(value).alias("y"))
    return left.join(right, "date").filter("a < b")


def safe_corr(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; null where a side doesn't move."""
    moves = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(moves, F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)))


def correlations(rows: DataFrame, key: str, value: str = "r") -> DataFrame:
    return pair_rows(rows, key, value).groupBy("a", "b").agg(safe_corr(F.col("x"), F.col("y")).alias("corr"), F.count(F.lit(1)).alias("n"))


def rolling_correlations(rows: DataFrame, key: str, n: int, value: str = "r") -> DataFrame:
    """a, b, date, corr over the last n shared dates; null until there are n."""
    w = Window.partitionBy("a", "b").orderBy("date").rowsBetween(-(n - 1), 0)
    x, y = F.col("x"), F.col("y")
    moves = (F.min(x).over(w) < F.max(x).over(w)) & (F.min(y).over(w) < F.max(y).over(w)) & (F.count(x).over(w) == n)
    spread = F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)
    return pair_rows(rows, key, value).select("a", "b", "date", F.when(moves, F.try_divide(F.covar_samp(x, y).over(w), spread)).alias("corr"))
