"""Trade journals: filters, first-in-first-out matching, habits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def apply_filter(rows: DataFrame, text: str, at: str = "ts") -> DataFrame:
    """`lo to hi` (days or months, the end included) on the time, or `column=value` without regard to case."""
    m = re.fullmatch(r"\s*(\d{4}-\d{2}(?:-\d{2})?)\s+to\s+(\d{4}-\d{2}(?:-\d{2})?)\s*", text)
    if m:
        if m[1][:10] > m[2]:
            raise ValueError(f"inverted range: {text}")
        lo = F.lit(m[1] if len(m[1]) == 10 else f"{m[1]}-01").cast("timestamp")
        hi = F.date_add(F.lit(m[2]).cast("date"), 1) if len(m[2]) == 10 else F.add_months(F.lit(f"{m[2]}-01").cast("date"), 1)
        return rows.filter((F.col(at) >= lo) & (F.col(at) < hi.cast("timestamp")))
    name, sep, value = text.partition("=")
    column = {c.lower(): c for c in rows.columns}.get(name.strip().lower())
    if not sep or column is None:
        raise ValueError(f"not a filter: {text}")
    return rows.filter(F.upper(F.col(column).cast("string")) == value.strip().upper())


def pair_fifo(trades: DataFrame) -> DataFrame:
    """symbol, buy_seq, sell_seq, quantity, buy_ts, sell_ts, pnl (after fees, pro rata) of sales matched to the oldest lots.

    In running quantities a lot is an interval, and so is the part of a sale that finds stock: with B bought and S
    sold so far, max(0, max(S - B)) could not be delivered. Lots lie end to end and so do sales, hence a match begins
    where a lot or a sale begins and ends where the next one does: in the order of starts it is one row with the
    last lot and the last sale so far. Rows are as many as trades, whatever their sizes.
    """
    w = Window.partitionBy("symbol").orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    buy, sell = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(0.0), F.when(F.col("side") == "sell", F.col("quantity")).otherwise(0.0)
    t = trades.withColumn("B", F.sum(buy).over(so_far)).withColumn("S", F.sum(sell).over(so_far))
    t = t.withColumn("U", F.greatest(F.max(F.col("S") - F.col("B")).over(so_far), F.lit(0.0))).withColumn("M", F.col("S") - F.col("U"))
    t = t.withColumn("M0", F.coalesce(F.lag("M").over(w), F.lit(0.0)))
    is_lot = F.col("side") == "buy"
    t = t.filter(F.when(is_lot, F.col("quantity") > 0).otherwise((F.col("side") == "sell") & (F.col("M") > F.col("M0"))))
    t = t.withColumn("start", F.when(is_lot, F.col("B") - F.col("quantity")).otherwise(F.col("M0")))
    own = F.struct("seq", "ts", "price", (F.col("fee") / F.col("quantity")).alias("fee"), F.when(is_lot, F.col("B")).otherwise(F.col("M")).alias("end"))
    by_start = Window.partitionBy("symbol").orderBy("start", "seq")
    last = lambda cond: F.last(F.when(cond, own), ignorenulls=True).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    t = t.select("symbol", "start", last(is_lot).alias("lot"), last(~is_lot).alias("sale"), F.lead("start").over(by_start).alias("next"))
    quantity = F.least("next", "lot.end", "sale.end") - F.col("start")
    t = t.filter("lot is not null and sale is not null").withColumn("quantity", quantity).filter(F.col("quantity") > 1e-9)
    pnl = F.col("quantity") * (F.col("sale.price") - F.col("lot.price") - F.col("lot.fee") - F.col("sale.fee"))
    return t.select("symbol", F.col("lot.seq").alias("buy_seq"), F.col("sale.seq").alias("sell_seq"), "quantity", F.col("lot.ts").alias("buy_ts"), F.col("sale.ts").alias("sell_ts"), pnl.alias("pnl"))
