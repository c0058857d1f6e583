"""Performance, risk and trade statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(state: Column, keys: list[str], at: str) -> Column:
    """A number that grows by one where the state differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce((~state.eqNullSafe(F.lag(state).over(w))).cast("int"), F.lit(1))
    return new


def trade_stats(trades: DataFrame, keys: list[str]) -> DataFrame:
    """keys, win_rate, profit_loss_ratio, profit_factor, max_consecutive_loss, avg_holding_bars, n."""
    w = Window.partitionBy(*keys).orderBy("exit_time", "trade_id")
    lost = F.coalesce(F.col("pnl") < 0, F.lit(False))
    # a run of losses is what shares the number of wins before it
    runs = trades.withColumn("_lost", lost).withColumn("_run", F.sum((~F.col("_lost")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streaks = runs.filter("_lost").groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("k")).groupBy(*keys).agg(F.max("k").alias("max_consecutive_loss"))
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    zero = F.lit(0.0)
    flat = trades.groupBy(*keys).agg(
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.round(F.coalesce(F.try_divide(F.avg(win), F.abs(F.avg(loss))), zero), 4).alias("profit_loss_ratio"),
        F.round(F.coalesce(F.try_divide(F.sum(win), F.abs(F.sum(loss))), zero), 4).alias("profit_factor"),
        F.round(F.coalesce(F.avg(F.when(F.col("holding_bars") > 0, F.col("holding_bars"))), zero), 1).alias("avg_holding_bars"), F.count(F.lit(1)).alias("n"),
    )
    return flat.join(streaks, keys, "left").withColumn("max_consecutive_loss", F.coalesce("max_consecutive_loss", F.lit(0)))


def turnover(weights: DataFrame) -> DataFrame:
    """date, turnover: half the absolute change of all weights; a weight that is missing is 0. Expects a dense grid."""
    w = Window.partitionBy("symbol").orderBy("date")
    now = F.coalesce("weight", F.lit(0.0))
    change = F.abs(now - F.coalesce(F.lag(now).over(w), F.lit(0.0)))
    return weights.select("date", change.alias("c")).groupBy("date").agg((0.5 * F.sum("c")).alias("turnover"))


def traded_turnover(fills: DataFrame, equity: DataFrame) -> DataFrame:
    """date, turnover: what was traded (positive values) over twice the equity."""
    traded = fills.filter("margin > 0").groupBy("date").agg(F.sum("margin").alias("traded"))
    ratio = F.try_divide(F.col("traded"), 2 * F.abs("equity"))
    return equity.join(traded, "date", "left").select("date", F.coalesce(ratio, F.lit(0.0)).alias("turnover"))


def curve(equity: DataFrame, keys: list[str], start: float | None = None) -> DataFrame:
    """equity with r (return, 0 on the first bar), peak (not below start, if given) and dd (from the peak, at most 0)."""
    w = Window.partitionBy(*keys).orderBy("date")
    r = F.coalesce(F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1, F.lit(0.0))
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    peak = F.greatest(peak, F.lit(float(start))) if start is not None else peak
    return equity.withColumn("r", r).withColumn("peak", peak).withColumn("dd", F.try_divide(F.col("equity") - F.col("peak"), F.when(F.col("peak") == 0, 1.0).otherwise(F.col("peak"))))


def performance(equity: DataFrame, keys: list[str], start: float, per_year: int) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, drawdown, Calmar, and against a benchmark's returns (column b) beta, tracking error, information ratio."""
    rows = curve(equity, keys, start)
    root = per_year**0.5
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("equity", "date").alias("final"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("vol"), F.min("dd").alias("max_dd"),
        F.coalesce(F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))), F.lit(1e-10)).alias("down"), F.avg(F.col("r") - F.col("b")).alias("active"),
        F.stddev_samp(F.col("r") - F.col("b")).alias("tracking"), F.covar_samp("r", "b").alias("cov"), F.var_samp("b").alias("var_b"), F.expr("exp(sum(ln(1 + b))) - 1").alias("bench_return"),
    )
    total = F.col("final") / start - 1
    annual = F.when(1 + total <= 0, -1.0).otherwise(F.pow(1 + total, F.lit(float(per_year)) / F.col("n")) - 1)
    return out.select(
        *keys, "n", total.alias("total_return"), annual.alias("annual_return"), F.col("vol").alias("volatility"), (F.col("mean") / (F.col("vol") + 1e-10) * root).alias("sharpe"),
        (F.col("mean") / (F.col("down") + 1e-10) * root).alias("sortino"), F.col("max_dd").alias("max_drawdown"), F.when(F.abs("max_dd") > 1e-10, F.try_divide(annual, F.abs("max_dd"))).otherwise(0.0).alias("calmar"),
        "bench_return", (total - F.col("bench_return")).alias("excess_return"), F.try_divide("cov", "var_b").alias("beta"), (F.col("tracking") * root).alias("tracking_error"), (F.col("active") / (F.col("tracking") + 1e-10) * root).alias("information_ratio"),
    )


def drawdown_episodes(equity: DataFrame, keys: list[str]) -> DataFrame:
    """keys, episode, peak_date, trough_date, recovery_date (null if open), depth, bars: from a peak to the first bar at or above it."""
    w = Window.partitionBy(*keys).orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = equity.withColumn("peak", F.max("equity").over(so_far)).withColumn("k", F.row_number().over(w))
    # an episode has the number of bars at a peak before it
    rows = rows.withColumn("episode", F.sum((F.col("equity") >= F.col("peak")).cast("int")).over(so_far))
    rows = rows.withColumn("before", F.lag("date").over(w)).withColumn("after", F.lead("date").over(w)).withColumn("under", F.col("equity") < F.col("peak"))
    own = rows.filter("under").groupBy(*keys, "episode").agg(
        F.min("before").alias("peak_date"), F.min_by("date", F.struct("equity", "date")).alias("trough_date"), F.max_by("after", "date").alias("recovery_date"),
        (1 - F.min(F.col("equity") / F.col("peak"))).alias("depth"), (F.count(F.lit(1)) + 1).alias("bars"),
    )
    return own.withColumn("bars", F.when(F.col("recovery_date").isNotNull(), F.col("bars")))


def tail_risk(returns: DataFrame, keys: list[str], level: float) -> DataFrame:
    """keys, var (interpolated quantile of losses) and es (mean of the losses at least as large)."""
    losses = returns.select(*keys, (-F.col("r")).alias("loss"))
    var = losses.groupBy(*keys).agg(F.percentile("loss", F.lit(level)).alias("var"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return losses.join(F.broadcast(var) if not keys else var, keys or None).filter("loss >= var").groupBy(*keys, "var").agg(F.avg("loss").alias("es"))


def order_var(returns: DataFrame, keys: list[str], confidence: float) -> DataFrame:
    """keys, var, cvar: the loss of place ceil((1 - c) n) from the worst, and the mean of losses from it on."""
    w = Window.partitionBy(*keys)
    rows = returns.select(*keys, F.col("r")).withColumn("k", F.row_number().over(w.orderBy("r"))).withColumn("n", F.count(F.lit(1)).over(w))
    at = F.greatest(F.ceil(F.round(F.lit(1 - confidence) * F.col("n"), 9)), F.lit(1))
    cut = rows.filter(F.col("k") == at).select(*keys, (-F.col("r")).alias("var"))
    return returns.select(*keys, (-F.col("r")).alias("loss")).join(cut, keys).filter(F.col("loss") >= F.col("var")).groupBy(*keys, "var").agg(F.avg("loss").alias("cvar"))
