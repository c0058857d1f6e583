"""Technical indicators and chart patterns per symbol."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ts
from .ewm import Ewm, ewm


def last_rsi(rows: DataFrame, n: int) -> DataFrame:
    """Wilder's index of the last bar, by averages that weigh by what has been seen: symbol, rsi.

    50 where nothing moved, 100 where nothing fell; null with fewer than n moves.
    """
    move = ts.delta(F.col("close"), 1)
    rows = rows.select("symbol", "date", move.alias("d")).filter("d is not null")
    rows = rows.select("symbol", "date", F.greatest("d", F.lit(0.0)).alias("up"), F.greatest(-F.col("d"), F.lit(0.0)).alias("down"))
    rows = ewm(rows, {"gain": Ewm("up", 1 / n, True, n), "loss": Ewm("down", 1 / n, True, n)})
    last = rows.groupBy("symbol").agg(F.max_by("gain", "date").alias("gain"), F.max_by("loss", "date").alias("loss"))
    value = F.when((F.col("loss") == 0) & (F.col("gain") == 0), 50.0).when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("gain", "loss")))
    return last.select("symbol", F.when(F.col("gain").isNotNull(), value).alias("rsi"))


def last_macd(rows: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """symbol, macd, signal, histogram of the last bar."""
    rows = ewm(rows.select("symbol", "date", "close"), {"f": Ewm.span("close", fast), "s": Ewm.span("close", slow)})
    rows = ewm(rows.select("symbol", "date", (F.col("f") - F.col("s")).alias("macd")), {"signal": Ewm.span("macd", signal)})
    last = rows.groupBy("symbol").agg(F.max_by("macd", "date").alias("macd"), F.max_by("signal", "date").alias("signal"))
    return last.withColumn("histogram", F.col("macd") - F.col("signal"))


def bollinger(x: Column, n: int, k: float) -> tuple[Column, Column, Column]:
    mid, spread = ts.ts_mean(x, n), ts.ts_std(x, n)
    return mid + k * spread, mid, mid - k * spread


def adx(rows: DataFrame, n: int) -> DataFrame:
    """symbol, date, adx, plus_di, minus_di by averages with weight 1/n, first value first."""
    high, low, close = F.col("high"), F.col("low"), F.col("close")
    up, down = ts.delta(high, 1), ts.delay(low, 1) - low
    before = ts.delay(close, 1)
    rows = rows.select(
        "symbol", "date", F.greatest(high - low, F.abs(high - before), F.abs(low - before)).alias("tr"),
        F.coalesce(F.when((up > down) & (up > 0), up), F.lit(0.0)).alias("plus"), F.coalesce(F.when((down > up) & (down > 0), down), F.lit(0.0)).alias("minus"),
    )
    rows = ewm(rows, {"atr": Ewm("tr", 1 / n), "p": Ewm("plus", 1 / n), "m": Ewm("minus", 1 / n)})
    rows = rows.select("symbol", "date", (100 * F.try_divide("p", "atr")).alias("plus_di"), (100 * F.try_divide("m", "atr")).alias("minus_di"))
    dx = 100 * F.try_divide(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di"))
    return ewm(rows.withColumn("dx", dx), {"adx": Ewm("dx", 1 / n)})


def obv(close: Column, volume: Column) -> Column:
    """Running volume signed by the bar's move; expects the move in column _d, so that windows don't nest."""
    return F.sum(F.coalesce(volume * F.signum(F.col("_d")), F.lit(0.0))).over(ts.so_far())


def historical_vol(returns: Column, n: int, per_year: int) -> Column:
    return ts.ts_std(returns, n) * per_year**0.5


def cumulative_vwap(high: Column, low: Column, close: Column, volume: Column) -> Column:
    w = ts.so_far()
    return F.try_divide(F.sum((high + low + close) / 3 * volume).over(w), F.sum(F.when(close.isNotNull(), volume)).over(w))


def donchian_mid(high: Column, low: Column, n: int) -> Column:
    return (ts.ts_max(high, n) + ts.ts_min(low, n)) / 2


def candle_code(open_: Column, high: Column, low: Column, close: Column) -> Column:
    """-1 bearish engulfing, 1 bullish engulfing or hammer, else 0; the first of these that holds."""
    body, up, down = F.abs(close - open_), high - F.greatest(open_, close), F.least(open_, close) - low
    pc, po = ts.delay(close, 1), ts.delay(open_, 1)
    larger = body > F.abs(pc - po)
    no = F.lit(False)
    bear = F.coalesce((pc > po) & (close < open_) & (open_ >= pc) & (close <= po) & larger, no)
    bull = F.coalesce((pc < po) & (close > open_) & (open_ <= pc) & (close >= po) & larger, no)
    doji = F.coalesce(F.try_divide(body, high - low) < 0.1, no)
    hammer = F.coalesce((down > 2 * body) & (up < body), no) & ~doji
    return F.when(bear, -1).when(bull | hammer, 1).otherwise(0)


def head_and_shoulders(rows: DataFrame, w: int) -> DataFrame:
    """symbol, date of a peak above both neighbouring peaks, which lie within 5% of each other."""
    tops = rows.select("symbol", "date", "close", ts.peaks(F.col("close"), w).alias("peak")).filter("peak")
    s = ts.series()
    tops = tops.select("symbol", "date", F.col("close").alias("h"), F.lag("close").over(s).alias("l"), F.lead("close").over(s).alias("r"))
    return tops.filter((F.col("h") > F.col("l")) & (F.col("h") > F.col("r")) & (F.abs(F.col("l") - F.col("r")) / ((F.col("l") + F.col("r")) / 2) <= 0.05)).select("symbol", "date")


def double_top_bottom(rows: DataFrame, w: int) -> DataFrame:
    """symbol, date, code: 1 for a peak within 3% of the one before, -1 for such a valley where there is no such peak."""
    x = rows.select("symbol", "date", "close", ts.peaks(F.col("close"), w).alias("peak"), ts.valleys(F.col("close"), w).alias("valley"))
    s = ts.series()

    def near(kind: str) -> DataFrame:
        own = x.filter(kind).select("symbol", "date", F.col("close").alias("b"), F.lag("close").over(s).alias("a"))
        return own.filter(F.abs(F.col("a") - F.col("b")) / F.abs((F.col("a") + F.col("b")) / 2) < 0.03).select("symbol", "date", F.lit(1 if kind == "peak" else -1).alias("code"))

    both = near("peak").unionByName(near("valley"))
    return both.groupBy("symbol", "date").agg(F.max("code").alias("code"))


def support_resistance(rows: DataFrame, w: int, most: int) -> DataFrame:
    """symbol, rank, level, touches: sorted peak and valley prices are joined while they lie within 5% of their range of the group's mean."""
    marked = rows.select("symbol", "date", "close", (ts.peaks(F.col("close"), w) | ts.valleys(F.col("close"), w)).alias("turn")).filter("turn").select("symbol", "close")

    def levels(part: pd.DataFrame) -> pd.DataFrame:
        prices = np.sort(part["close"].to_numpy(float))
        reach = 0.05 * (prices[-1] - prices[0])
        level, touches = [], []
        for p in prices.tolist():
            if level and p - level[-1] / touches[-1] <= reach:
                level[-1] += p
                touches[-1] += 1
            else:
                level.append(p)
                touches.append(1)
        mean = np.array(level) / np.array(touches)
        best = np.lexsort((mean, -np.array(touches)))[:most]
        return pd.DataFrame({"symbol": part["symbol"].iloc[0], "rank": np.arange(1, len(best) + 1), "level": mean[best], "touches": np.array(touches)[best]})

    # a symbol's few turning points, not its bars
    return marked.groupBy("symbol").applyInPandas(levels, "symbol long, rank int, level double, touches int")


def shapes(rows: DataFrame, n: int) -> DataFrame:
    """symbol, date, triangle, broadening from the peaks and valleys of each trailing window of n + 1 bars.

    triangle: 1 with rising valleys under flat peaks, -1 with falling peaks over flat valleys. broadening: 1 with
    rising peaks and falling valleys. Two of each kind are needed. A turn is the largest or least of the bars around it,
    gaps passed over; what a window needs of its turns are counts, sums and ends, so all is windows over the series.
    """
    w = max(2, n // 5)
    s = ts.series()
    x, around = F.col("close"), s.rowsBetween(-w, w)
    turned = rows.select("symbol", "date", "close", F.when(x == F.max(x).over(around), x).alias("p"), F.when(x == F.min(x).over(around), x).alias("v"), (F.row_number().over(s) - 1).alias("_i"))
    before = s.rowsBetween(Window.unboundedPreceding, -1)
    # the number of a turn among its kind, and whether it breaks the order of the one before it
    turned = turned.withColumns({
        "_pk": F.count("p").over(s.rowsBetween(Window.unboundedPreceding, 0)).cast("double"), "_vk": F.count("v").over(s.rowsBetween(Window.unboundedPreceding, 0)).cast("double"),
        "_pbad": (F.col("p") <= F.last("p", ignorenulls=True).over(before)).cast("int"), "_vbad": (F.col("v") >= F.last("v", ignorenulls=True).over(before)).cast("int"),
    })
    inside = s.rowsBetween(w - n, -w)

    def of(kind: str) -> dict[str, Column]:
        k, bad = F.when(F.col(kind).isNotNull(), F.col(f"_{kind}k")), F.coalesce(f"_{kind}bad", F.lit(0))
        # the first turn of a window has none before it there
        first = F.first(F.when(F.col(kind).isNotNull(), bad), ignorenulls=True).over(inside)
        return {
            f"{kind}_n": F.count(kind).over(inside), f"{kind}_slope": F.try_divide(F.covar_pop(k, F.col(kind)).over(inside), F.var_pop(k).over(inside)),
            f"{kind}_end": (F.max(kind) if kind == "p" else F.min(kind)).over(inside), f"{kind}_bad": F.sum(F.when(F.col(kind).isNotNull(), bad)).over(inside) - first,
        }

    seen = turned.withColumns(of("p") | of("v"))
    enough = (F.col("_i") >= n) & (F.col("p_n") >= 2) & (F.col("v_n") >= 2)
    reach = F.col("p_end") - F.col("v_end")
    flat = 0.02 * reach
    rising, falling = (F.col("v_slope") > flat) & (F.abs("p_slope") < flat), (F.col("p_slope") < -flat) & (F.abs("v_slope") < flat)
    triangle = F.when(enough & (reach != 0), F.when(rising, 1).when(falling, -1).otherwise(0)).otherwise(0)
    broadening = F.when(enough & (F.col("p_bad") == 0) & (F.col("v_bad") == 0), 1).otherwise(0)
    return seen.select("symbol", "date", triangle.alias("triangle"), broadening.alias("broadening"))
