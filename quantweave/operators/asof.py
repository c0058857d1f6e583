"""As-of and range joins without non-equi joins: both sides are one sorted stream per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, strict: bool = False, prefix: str = "") -> DataFrame:
    """left with the columns of the latest right row at or before (strict: before) its time, null if there is none.

    One shuffle by the key and one sort; each left row gives one row, whatever the right side holds. Among right
    rows of one time the greatest by its columns' order counts.
    """
    values = [c for c in right.columns if c not in by]
    body = F.struct(*[F.col(c).alias(c) for c in values])
    a = left.select(*by, F.col(left_at).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*[c for c in left.columns]).alias("_l"), F.lit(None).cast(right.select(body.alias("x")).schema["x"].dataType).alias("_r"))
    b = right.filter(F.col(right_at).isNotNull()).select(*by, F.col(right_at).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_l"), body.alias("_r"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).filter("_l is not null")
    return both.select("_l.*", *[F.col("_m")[c].alias(prefix + c) for c in values])


def no_regress(statements: DataFrame, by: Sequence[str], period: str, filed: str) -> DataFrame:
    """Statements less restatements of periods that are older than one already filed."""
    w = Window.partitionBy(*by).orderBy(filed, period).rowsBetween(Window.unboundedPreceding, 0)
    return statements.withColumn("_top", F.max(period).over(w)).filter(F.col(period) == F.col("_top")).drop("_top")


def window_sum(points: DataFrame, events: DataFrame, by: Sequence[str], point_at: str, event_at: str, days: int, weight: Column) -> DataFrame:
    """points with score and count of the events in (t - days, t]: an equi join on day buckets as wide as the range.

    weight is a Column of _age (days from event to point) and the event's columns.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    p = points.withColumn("_id", F.struct(*by, point_at)).withColumn("_b", F.explode(F.array(F.floor(day(point_at) / days), F.floor(day(point_at) / days) - 1)))
    e = events.select(*by, F.col(event_at).alias("_e"), *[c for c in events.columns if c not in (*by, event_at)]).withColumn("_b", F.floor(day("_e") / days))
    hit = p.select("_id", *by, point_at, "_b").join(e, [*by, "_b"]).withColumn("_age", F.datediff(point_at, "_e")).filter((F.col("_age") >= 0) & (F.col("_age") < days))
    sums = hit.groupBy("_id").agg(F.sum(weight).alias("score"), F.count(F.lit(1)).alias("n_events"))
    return points.withColumn("_id", F.struct(*by, point_at)).join(sums, "_id", "left").drop("_id").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("n_events", F.coalesce("n_events", F.lit(0)))
