"""How well a factor orders the next returns: rank correlation, groups, categories, controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _mean_rank(x: str, keys: list[str]) -> Column:
    low = F.rank().over(Window.partitionBy("date", *keys).orderBy(x))
    return low + (F.count(F.lit(1)).over(Window.partitionBy("date", *keys, x)) - 1) / 2


def ic_series(pairs: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """keys, date, ic: Spearman correlation of f and y over the rows that have both; dates with fewer than `least` are left out."""
    both = pairs.filter("f is not null and y is not null")
    ranked = both.select(*keys, "date", _mean_rank("f", keys).alias("rf"), _mean_rank("y", keys).alias("ry"))
    moves = (F.min("rf") < F.max("rf")) & (F.min("ry") < F.max("ry"))
    out = ranked.groupBy(*keys, "date").agg(F.when(moves, F.try_divide(F.covar_samp("rf", "ry"), F.stddev_samp("rf") * F.stddev_samp("ry"))).alias("ic"), F.count(F.lit(1)).alias("n"))
    return out.filter((F.col("n") >= least) & F.col("ic").isNotNull()).select(*keys, "date", "ic")


def summary(ic: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ic_mean, ic_std, ir, positive (share of dates above 0), n."""
    return ic.groupBy(*keys).agg(
        F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("ir"),
        F.avg((F.col("ic") > 0).cast("double")).alias("positive"), F.count("ic").alias("n"),
    )


def group_equity(pairs: DataFrame, groups: int) -> DataFrame:
    """date, g, nav: symbols are placed by their factor (ties by symbol) into groups of equal size; a group's mean returns are chained.

    A group without a member on a date has return 0; dates with fewer pairs than groups are left out. A symbol of
    place r of m belongs to group max(1, ceil((r - 1) groups / (m - 1))).
    """
    both = pairs.filter("f is not null and y is not null")
    w = Window.partitionBy("date")
    m, r = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("f", "symbol"))
    placed = both.select("date", "y", m.alias("m"), r.alias("r")).filter(F.col("m") >= groups)
    place = F.greatest(F.ceil(F.try_divide((F.col("r") - 1) * float(groups), F.col("m") - 1)).cast("int"), F.lit(1))
    means = placed.withColumn("g", F.coalesce(place, F.lit(1))).groupBy("date").agg(*[F.coalesce(F.avg(F.when(F.col("g") == k, F.col("y"))), F.lit(0.0)).alias(str(k)) for k in range(1, groups + 1)])
    long = means.unpivot("date", [str(k) for k in range(1, groups + 1)], "g", "r").withColumn("g", F.col("g").cast("int"))
    # one row a date and group by now
    return long.withColumn("nav", F.exp(F.sum(F.log(1 + F.col("r"))).over(Window.partitionBy("g").orderBy("date"))))


def t_stat(mean: Column, std: Column, n: Column) -> Column:
    """mean / (std / sqrt n); 0 where that isn't defined."""
    return F.when((n > 1) & (std > 0), F.try_divide(mean, std / F.sqrt(n))).otherwise(0.0)


def category(ic_mean: Column, t: Column, ic: float = 0.02, significant: float = 2.0) -> Column:
    """alive, reversed or dead by the sign of a mean that is large and significant."""
    sure = (F.abs(ic_mean) >= ic) & (F.abs(t) >= significant)
    return F.when(sure & (ic_mean > 0), "alive").when(sure, "reversed").otherwise("dead")
