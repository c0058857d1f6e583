"""Habits in a trade journal, books and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def disposition(trips: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ratio (mean days losers over winners are held), severity."""
    days = F.datediff("sell_ts", "buy_ts").cast("double")
    out = trips.groupBy(*keys).agg(F.avg(F.when(F.col("pnl") < 0, days)).alias("losers"), F.avg(F.when(F.col("pnl") > 0, days)).alias("winners"))
    ratio = F.try_divide("losers", "winners")
    return out.select(*keys, ratio.alias("ratio"), F.when(ratio > 1.5, "high").when(ratio > 1.2, "medium").when(ratio.isNotNull(), "low").alias("severity"))


def overtrading(trades: DataFrame, pnl_by_day: DataFrame) -> DataFrame:
    """busy, quiet: the mean profit of days with at least the third, at most the first quartile of trades a day."""
    daily = trades.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    cuts = daily.agg(F.percentile("n", F.lit(0.75)).alias("hi"), F.percentile("n", F.lit(0.25)).alias("lo"))
    # one row of cuts
    joined = daily.join(F.broadcast(cuts)).join(pnl_by_day, "day", "left")
    return joined.agg(F.avg(F.when(F.col("n") >= F.col("hi"), F.coalesce("pnl", F.lit(0.0)))).alias("busy"), F.avg(F.when(F.col("n") <= F.col("lo"), F.coalesce("pnl", F.lit(0.0)))).alias("quiet"))


def chasing(trades: DataFrame, jump: float = 0.03, back: int = 3) -> DataFrame:
    """share of buys at more than `jump` over the buy three before, of buys that have one."""
    w = Window.partitionBy("symbol").orderBy("seq")
    buys = trades.filter("side = 'buy'").withColumn("before", F.lag("price", back).over(w)).filter("before > 0")
    return buys.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("price") / F.col("before") - 1 > jump).cast("double")).alias("share"))


def anchoring(trades: DataFrame, least: int = 5, cv: float = 0.05) -> DataFrame:
    """symbol, n, cv of symbols that are traded at much the same price."""
    out = trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.stddev_samp("price"), F.avg("price")).alias("cv"))
    return out.filter((F.col("n") >= least) & (F.col("cv") < cv))


def benford(values: DataFrame, value: str) -> DataFrame:
    """digit, n, share, expected of first digits."""
    from ..functions.scalar import first_digit

    n = values.select(first_digit(F.col(value)).alias("digit")).filter("digit between 1 and 9").groupBy("digit").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).withColumn("expected", F.log10(1 + 1 / F.col("digit")))


def benford_verdict(digits: DataFrame) -> DataFrame:
    """mad, chi2, verdict from benford(); bands after Nigrini."""
    total = F.sum("n")
    mad = F.sum(F.abs(F.col("share") - F.col("expected"))) / 9
    out = digits.agg(mad.alias("mad"), (total * F.sum(F.pow(F.col("share") - F.col("expected"), F.lit(2.0)) / F.col("expected"))).alias("chi2"))
    m = F.col("mad")
    return out.withColumn("verdict", F.when(m < 0.006, "close").when(m < 0.012, "acceptable").when(m < 0.015, "marginal").otherwise("nonconforming"))


def cross_validate(values: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """values with the median of their keys, deviation in percent, consistent."""
    mid = values.groupBy(*keys).agg(F.percentile("value", F.lit(0.5)).alias("median"))
    dev = 100 * F.try_divide(F.col("value") - F.col("median"), F.abs("median"))
    return values.join(mid, keys).withColumn("deviation", dev).withColumn("consistent", F.coalesce(F.abs(dev) <= tolerance, F.lit(False)))


def walk_book(levels: DataFrame, target: float, keys: list[str]) -> DataFrame:
    """keys, filled, avg_price of filling a size through price levels from the cheapest."""
    w = Window.partitionBy(*keys).orderBy("price").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("amount").over(w), F.lit(0.0))
    take = F.greatest(F.least("amount", F.lit(target) - before), F.lit(0.0))
    taken = levels.withColumn("take", take)
    return taken.groupBy(*keys).agg(F.sum("take").alias("filled"), F.try_divide(F.sum(F.col("take") * F.col("price")), F.sum("take")).alias("avg_price"))


def quality(trades: Column, days: Column) -> Column:
    return F.when((trades < 10) | (days < 60), "insufficient").when((trades < 30) | (days < 252), "marginal").otherwise("adequate")


def breakeven_bps(gross: Column, trades: Column, size: float) -> Column:
    """Fee in basis points at which a return is 0: ln(1 + r) / (2 n size) 10^4."""
    return F.when((trades > 0) & (gross > -1), F.try_divide(F.log(1 + gross), 2 * trades * size) * 10_000)


def decay_metrics(history: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """keys, baseline (first n), rolling (last n), ratio, positive share of an IC history."""
    w = Window.partitionBy(*keys)
    rows = history.withColumn("_f", F.row_number().over(w.orderBy("date"))).withColumn("_l", F.row_number().over(w.orderBy(F.desc("date"))))
    out = rows.groupBy(*keys).agg(F.avg(F.when(F.col("_f") <= n, F.col("ic"))).alias("baseline"), F.avg(F.when(F.col("_l") <= n, F.col("ic"))).alias("rolling"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"))
    return out.withColumn("ratio", F.try_divide("rolling", "baseline"))
