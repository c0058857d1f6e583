"""From signals to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..data import densify


def align(bars: DataFrame, signals: DataFrame, limit: int = 5) -> DataFrame:
    """symbol, date, weight on the shared calendar.

    A signal acts one bar later on its symbol's own calendar, is carried over at most `limit` missing dates,
    clipped to [-1, 1]; weights of a date are scaled down where their absolute sum is over 1.
    """
    own = Window.partitionBy("symbol").orderBy("date")
    late = bars.select("symbol", "date").join(signals, ["symbol", "date"], "left").select("symbol", "date", F.lag("signal").over(own).alias("s"))
    carried = F.last("s", ignorenulls=True).over(own.rowsBetween(-limit, 0))
    w = densify(late).select("symbol", "date", F.coalesce(F.least(F.greatest(carried, F.lit(-1.0)), F.lit(1.0)), F.lit(0.0)).alias("w"))
    gross = F.sum(F.abs("w")).over(Window.partitionBy("date"))
    return w.select("symbol", "date", (F.col("w") / F.greatest(gross, F.lit(1.0))).alias("weight"))


def top_n_equal(scores: DataFrame, n: int) -> DataFrame:
    """symbol, date, weight: 1/k for the k <= n best scores of a date, else 0."""
    w = Window.partitionBy("date")
    k = F.when(F.col("score").isNotNull(), F.row_number().over(w.orderBy(F.col("score").desc_nulls_last(), "symbol")))
    picked = scores.select("symbol", "date", F.coalesce((k <= n).cast("double"), F.lit(0.0)).alias("p"))
    total = F.sum("p").over(w)
    return picked.select("symbol", "date", F.when(total > 0, F.col("p") / total).otherwise(0.0).alias("weight"))
