"""Holdings: comparing, merging and completing filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff_positions(now: DataFrame, before: DataFrame) -> DataFrame:
    """cusip, put_call, now, before, change of two quarters' (cusip, put_call, shares)."""
    keys = ["cusip", "put_call"]
    both = now.withColumnRenamed("shares", "now").join(before.withColumnRenamed("shares", "before"), keys, "full_outer")
    a, b = F.col("now"), F.col("before")
    change = F.when(b.isNull(), "new").when(a.isNull(), "closed").when(a > b, "increased").when(a < b, "reduced").otherwise("unchanged")
    return both.select(*keys, "now", "before", change.alias("change"))


def fourth_quarters(annual: DataFrame, quarters: DataFrame) -> DataFrame:
    """entity, start, end, val: a year less its quarters, where exactly three lie inside it."""
    q = quarters.select("entity", F.year("end").alias("y"), F.col("start").alias("qs"), F.col("end").alias("qe"), F.col("val").alias("qv"))
    # a quarter inside a fiscal year ends in the year's first or last calendar year
    a = annual.withColumn("y", F.explode(F.array_distinct(F.array(F.year("start"), F.year("end")))))
    inside = a.join(q, ["entity", "y"]).filter("qs >= start and qe <= end")
    sums = inside.groupBy("entity", "start", "end", "val").agg(F.count(F.lit(1)).alias("n"), F.sum("qv").alias("s"), F.max("qe").alias("last")).filter("n = 3")
    return sums.select("entity", F.date_add("last", 1).alias("start"), "end", (F.col("val") - F.col("s")).alias("val"))


def merge_positions(base: DataFrame, extra: DataFrame) -> DataFrame:
    """cusip, put_call, shares, value, sources: sums of both sets and in how many of them a position is."""
    both = base.withColumn("src", F.lit(1)).unionByName(extra.withColumn("src", F.lit(2)))
    return both.groupBy("cusip", "put_call").agg(F.sum("shares").alias("shares"), F.sum("value").alias("value"), F.count_distinct("src").alias("sources"))


def aggregate_positions(rows: DataFrame, keys: list[str], multiplier: float = 1.0) -> DataFrame:
    """keys, value, shares, pct: filing rows as positions with their share of the filer's total (first key)."""
    out = rows.groupBy(*keys).agg((F.sum("value") * multiplier).alias("value"), F.sum("shares").alias("shares"))
    return out.withColumn("pct", 100 * F.try_divide("value", F.sum("value").over(Window.partitionBy(keys[0]))))


def walk_chain(filings: DataFrame) -> DataFrame:
    """filer, cusip, shares after amendments: rows (filer, seq, type, cusip, shares), type `original`, `restatement` or `new holdings`.

    The last original or restatement replaces all before it; new holdings after it are added; other types aren't applied.
    """
    base = F.col("type").isin("original", "restatement")
    w = Window.partitionBy("filer")
    rows = filings.withColumn("start", F.max(F.when(base, F.col("seq"))).over(w))
    kept = rows.filter((F.col("seq") == F.col("start")) | ((F.col("type") == "new holdings") & (F.col("seq") > F.coalesce("start", F.lit(-1)))))
    return kept.groupBy("filer", "cusip").agg(F.sum("shares").alias("shares"))
