"""Queries on tests and estimates, attribution, factor controls, signals and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..data import BARS, CASHFLOWS, PANEL, bars, cashflows, panel
from ..operators import attribution, bench, metrics, pairs, signals, stats, textindex, ts, xs
from ..scratch import new_path
from .panels import _FACTOR, _IC, _PAIRS, agg, factor_rows, guard, lag, over
from .portfolio import _EQ, _PORT, _RET, _SECTOR, _TRADES, _W, aligned_weights, equity, holdings_weights, portfolio_returns, returns, round_trips, rounded, sector_returns
from .registry import query, r6, table
from .reports import _MANY, many_ic

C = F.col
S = "PARTITION BY symbol ORDER BY date"


def one() -> WindowSpec:
    """A window over everything, for series of one row a date or a sector."""
    return Window.partitionBy(F.lit(0))




def draw_sql(*parts: str) -> str:
    """The pseudo-random draw of operators.stats, in SQL."""
    out = "CAST(12345 AS BIGINT)"
    for p in parts:
        value = f"({out} * {stats.STEP} + CAST({p} AS BIGINT) * {stats.TURN} + 11) % {stats.MODULUS}"
        out = f"list_transform([{value}], lambda z: (z * z + 12345) % {stats.MODULUS})[1]"
    return out


# ---- J: permutation, bootstrap, events, models


@query("J01_permutation_test", f"""{_TRADES}, sq AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY exit_time, trade_id) AS seq, pnl FROM tr), e AS (SELECT symbol, sim, seq, pnl, CASE WHEN sim = 0 THEN seq ELSE {draw_sql('sim', 'seq')} END AS o FROM sq, (SELECT unnest(generate_series(0, 1000)) AS sim)),
  c AS (SELECT *, 1e6 + sum(pnl) OVER (PARTITION BY symbol, sim ORDER BY o, seq) AS eq FROM e), d AS (SELECT symbol, sim, eq - greatest(max(eq) OVER (PARTITION BY symbol, sim ORDER BY o, seq), 1e6) AS dd FROM c), w AS (SELECT symbol, sim, round(min(dd), 4) AS dd FROM d GROUP BY ALL), a AS (SELECT symbol, dd AS actual FROM w WHERE sim = 0)
  SELECT symbol, actual, round(avg(CASE WHEN dd <= actual THEN 1.0 ELSE 0 END), 6) AS share FROM w JOIN a USING (symbol) WHERE sim > 0 GROUP BY ALL""")
def _j01(spark, sf_dir):
    t = round_trips(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("symbol").orderBy("exit_time", "trade_id"))).select("symbol", "seq", "pnl")
    return stats.permutation_drawdowns(t, ["symbol"], 1e6, 1000).select("symbol", "actual", r6("share").alias("share"))


_BOOT = lambda stat: f"""WITH {_SECTOR}, b AS (SELECT sector, r, row_number() OVER (PARTITION BY sector ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY sector) AS n FROM sr), p AS (SELECT sector, sim, {draw_sql('sim', 'i')} % n AS i FROM b, (SELECT unnest(generate_series(1, 1000)) AS sim)),
  s AS (SELECT sector, sim, {stat} AS s FROM p JOIN b USING (sector, i) GROUP BY ALL) SELECT sector, round(quantile_cont(s, 0.05), 6) AS lo, round(quantile_cont(s, 0.95), 6) AS hi FROM s GROUP BY sector"""  # noqa: E731


@query("J02_bootstrap_sharpe", _BOOT("avg(r) / stddev_samp(r) * sqrt(12)"))
def _j02(spark, sf_dir):
    return rounded(stats.bootstrap(sector_returns(spark, sf_dir), ["sector"], F.try_divide(F.avg("r"), F.stddev_samp("r")) * 12**0.5, 1000, 0.9))


@query("J03_bootstrap_statistic", _BOOT("quantile_cont(r, 0.5)"))
def _j03(spark, sf_dir):
    return rounded(stats.bootstrap(sector_returns(spark, sf_dir), ["sector"], F.percentile("r", F.lit(0.5)), 1000, 0.9))


_RM = f"{PANEL}, {_RET}, rm AS (SELECT symbol, date, r, avg(r) OVER (PARTITION BY date) AS m, row_number() OVER ({S}) AS k FROM rets)"


def with_market(spark, sf_dir) -> DataFrame:
    """symbol, date, r, m (mean of the date), k (bar number)."""
    return returns(spark, sf_dir).select("symbol", "date", "r", F.avg("r").over(xs.section()).alias("m"), F.row_number().over(ts.series()).alias("k"))


@query("J04_event_study", f"""WITH {_RM}, ev AS (SELECT symbol, k AS k0 FROM rm WHERE r > 2 AND k > 30), nr AS (SELECT e.symbol, e.k0, rm.k - e.k0 AS rel, r, m FROM ev e JOIN rm ON rm.symbol = e.symbol AND rm.k BETWEEN e.k0 - 26 AND e.k0 + 2),
  md AS (SELECT symbol, k0, regr_slope(r, m) AS b, regr_intercept(r, m) AS a FROM nr WHERE rel BETWEEN -26 AND -4 AND r IS NOT NULL AND m IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
  ar AS (SELECT rel, r - a - b * m AS ar FROM nr JOIN md USING (symbol, k0) WHERE rel BETWEEN -2 AND 2) SELECT rel, count(ar) AS n, round(avg(ar), 6) AS aar, round(avg(ar) / (stddev_samp(ar) / sqrt(count(ar))), 6) AS t FROM ar GROUP BY rel""")
def _j04(spark, sf_dir):
    rm = with_market(spark, sf_dir)
    events = rm.filter("r > 2 and k > 30").select("symbol", C("k").alias("k0"))
    return rounded(stats.event_study(rm.select("symbol", "k", "r", "m"), events, (-2, 2), (-26, -4)))


_OLS = "regr_count({y}, {x}) AS n, regr_intercept({y}, {x}) AS alpha, regr_slope({y}, {x}) AS beta, regr_r2({y}, {x}) AS r2, sqrt(regr_count({y}, {x}) * (var_pop(CASE WHEN {x} IS NOT NULL THEN {y} END) - pow(covar_pop({y}, {x}), 2) / var_pop(CASE WHEN {y} IS NOT NULL THEN {x} END)) / (regr_count({y}, {x}) - 2)) AS sd"


@query("J05_market_model", f"WITH {_RM}, o AS (SELECT symbol, {_OLS.format(y='r', x='m')} FROM rm GROUP BY symbol) SELECT symbol, n, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(sd, 6) AS residual_std FROM o WHERE n >= 3")
def _j05(spark, sf_dir):
    return rounded(stats.market_model(with_market(spark, sf_dir), ["symbol"]).select("symbol", "n", "alpha", "beta", "residual_std"))


@query("J47_attribution_ols", f"WITH {_RM}, o AS (SELECT symbol, {_OLS.format(y='r', x='m')}, avg(CASE WHEN r IS NOT NULL THEN m END) AS mx, var_pop(CASE WHEN r IS NOT NULL THEN m END) AS vx FROM rm GROUP BY symbol) SELECT symbol, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(r2, 6) AS r2, round(alpha / (sd * sqrt(1.0 / n + mx * mx / (n * vx))), 6) AS t_alpha FROM o WHERE n >= 3")
def _j47(spark, sf_dir):
    return rounded(stats.market_model(with_market(spark, sf_dir), ["symbol"]).select("symbol", "alpha", "beta", "r2", "t_alpha"))


_CDF_TAIL = "exp(-t * t / 2) * 0.3989422804014327 * (u * (0.319381530 + u * (-0.356563782 + u * (1.781477937 + u * (-1.821255978 + u * 1.330274429)))))"


@query("J06_benjamini_hochberg", f"""WITH {_RM}, tt AS (SELECT symbol AS id, abs(avg(r) / (stddev_samp(r) / sqrt(count(r)))) AS t FROM rm GROUP BY symbol), p AS (SELECT id, round(2 * {_CDF_TAIL}, 9) AS p FROM (SELECT *, 1 / (1 + 0.2316419 * t) AS u FROM tt)),
  k AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM p) SELECT id, round(p, 6) AS p, round(least(min(p * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 6) AS adjusted FROM k""")
def _j06(spark, sf_dir):
    t = with_market(spark, sf_dir).groupBy(C("symbol").alias("id")).agg((F.avg("r") / (F.stddev_samp("r") / F.sqrt(F.count("r")))).alias("t"))
    p = t.select("id", F.round(stats.two_sided_p(C("t")), 9).alias("p"))
    return rounded(stats.benjamini_hochberg(p, 0.05).select("id", "p", "adjusted"))


@query("J07_overfitting", f"""WITH {_SECTOR}, dt AS (SELECT date, (row_number() OVER (ORDER BY date) - 1) * 6 // count(*) OVER () AS block FROM (SELECT DISTINCT date FROM sr)), sm AS (SELECT sector AS strategy, block, count(r) AS n, sum(r) AS s, sum(r * r) AS q FROM sr JOIN dt USING (date) GROUP BY ALL),
  cb AS (SELECT a.i AS x, b.i AS y, c.i AS z FROM (SELECT unnest(range(6)) AS i) a, (SELECT unnest(range(6)) AS i) b, (SELECT unnest(range(6)) AS i) c WHERE a.i < b.i AND b.i < c.i), hf AS (SELECT x, y, z, strategy, block IN (x, y, z) AS inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM cb, sm GROUP BY ALL),
  sh AS (SELECT x, y, z, strategy, max(CASE WHEN inside THEN sr END) AS i, max(CASE WHEN NOT inside THEN sr END) AS o FROM (SELECT *, round(coalesce(s / n / nullif(sqrt(greatest((q - s * s / n) / (n - 1), 0)), 0), 0), 9) AS sr FROM hf) GROUP BY ALL),
  rk AS (SELECT *, rank() OVER (PARTITION BY x, y, z ORDER BY o) + (count(*) OVER (PARTITION BY x, y, z, o) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY x, y, z) AS m, row_number() OVER (PARTITION BY x, y, z ORDER BY i DESC, strategy) AS b FROM sh) SELECT count(*) AS n, round(avg(CASE WHEN ln((rank / (m + 1)) / (1 - rank / (m + 1))) <= 0 THEN 1.0 ELSE 0 END), 6) AS pbo FROM rk WHERE b = 1""")
def _j07(spark, sf_dir):
    return rounded(stats.overfitting(sector_returns(spark, sf_dir).select(C("sector").alias("strategy"), "date", "r"), 6))


_SHARPE = f"{_SECTOR}, sp AS (SELECT sector, count(r) AS n, avg(r) / stddev_samp(r) AS sr, avg(pow(r - a, 3)) / pow(avg(pow(r - a, 2)), 1.5) AS skew, avg(pow(r - a, 4)) / pow(avg(pow(r - a, 2)), 2) AS kurt FROM (SELECT *, avg(r) OVER (PARTITION BY sector) AS a FROM sr) GROUP BY sector)"
_PSR = lambda b: f"(SELECT *, (sr - {b}) * sqrt(n - 1) / sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12)) AS zz FROM sp)"
_PHI = f"CASE WHEN zz >= 0 THEN 1 - {_CDF_TAIL} ELSE {_CDF_TAIL} END"


@query("J10_sharpe_ratio", f"WITH {_SHARPE} SELECT sector, round(sr, 6) AS sr FROM sp")
def _j10(spark, sf_dir):
    return rounded(stats.sharpe_stats(sector_returns(spark, sf_dir), ["sector"]).select("sector", "sr"))


@query("J09_probabilistic_sharpe", f"WITH {_SHARPE}, z AS (SELECT *, abs(zz) AS t, 1 / (1 + 0.2316419 * abs(zz)) AS u FROM {_PSR('0.3')}) SELECT sector, round({_PHI}, 6) AS psr FROM z")
def _j09(spark, sf_dir):
    s = stats.sharpe_stats(sector_returns(spark, sf_dir), ["sector"])
    return rounded(s.select("sector", stats.probabilistic_sharpe(C("sr"), C("n"), F.lit(0.3), C("skew"), C("kurt")).alias("psr")))


def _best_factor(trials: int) -> float:
    from statistics import NormalDist

    z = NormalDist().inv_cdf
    return (1 - 0.5772156649015329) * z(1 - 1 / trials) + 0.5772156649015329 * z(1 - 1 / (trials * 2.718281828459045))


@query("J08_deflated_sharpe", f"WITH {_SHARPE}, b AS (SELECT stddev_samp(sr) * {_best_factor(25)!r} AS b FROM sp), z AS (SELECT *, abs(zz) AS t, 1 / (1 + 0.2316419 * abs(zz)) AS u FROM (SELECT sp.*, (sr - b) * sqrt(n - 1) / sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12)) AS zz FROM sp, b)) SELECT sector, round({_PHI}, 6) AS dsr FROM z")
def _j08(spark, sf_dir):
    s = stats.sharpe_stats(sector_returns(spark, sf_dir), ["sector"]).withColumn("b", stats.expected_best(25, F.stddev_samp("sr").over(one())))
    return rounded(s.select("sector", stats.probabilistic_sharpe(C("sr"), C("n"), C("b"), C("skew"), C("kurt")).alias("dsr")))


# ---- splits

_ROWS = "rw AS (SELECT row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders))"


def _days(spark, sf_dir) -> tuple[DataFrame, int]:
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return d.select((F.row_number().over(one().orderBy("date")) - 1).alias("i")), d.count()


_KF = lambda h, e: f"""WITH {_ROWS}, f AS (SELECT i, fold, ceil(fold * n / 5.0) AS lo, ceil((fold + 1) * n / 5.0) - 1 AS hi FROM rw, (SELECT unnest(range(5)) AS fold)), r AS (SELECT fold, CASE WHEN i BETWEEN lo AND hi THEN 'test' WHEN i < lo AND i + {h} >= lo THEN 'purged' WHEN i > hi AND i <= hi + {h} THEN 'purged' WHEN i > hi AND i <= hi + {h} + {e} THEN 'embargo' ELSE 'train' END AS role FROM f)"""


@query("J11_purged_kfold", f"{_KF(3, 20)} SELECT fold, role, count(*) AS n FROM r GROUP BY ALL")
def _j11(spark, sf_dir):
    d, n = _days(spark, sf_dir)
    return stats.splits_kfold(n, 5, 3, 20, d).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("J12_group_purged_kfold", f"WITH g AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY CAST(o_orderdate AS DATE)) - 1 AS i FROM orders), m AS (SELECT max(i) + 1 AS n FROM g), f AS (SELECT i, fold, ceil(fold * n / 5.0) AS lo, ceil((fold + 1) * n / 5.0) - 1 AS hi FROM g, m, (SELECT unnest(range(5)) AS fold)), r AS (SELECT fold, CASE WHEN i BETWEEN lo AND hi THEN 'test' WHEN i < lo AND i + 3 >= lo THEN 'purged' WHEN i > hi AND i <= hi + 3 THEN 'purged' WHEN i > hi AND i <= hi + 23 THEN 'embargo' ELSE 'train' END AS role FROM f) SELECT fold, role, count(*) AS n FROM r GROUP BY ALL")
def _j12(spark, sf_dir):
    """Rows of a panel take the role of their date: the split is made over dates, then joined."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    dates = o.distinct()
    numbered = dates.select("date", (F.row_number().over(one().orderBy("date")) - 1).alias("i"))
    roles = stats.splits_kfold(dates.count(), 5, 3, 20, numbered.select("i")).join(numbered, "i")
    return roles.join(o.groupBy("date").agg(F.count(F.lit(1)).alias("c")), "date").groupBy("fold", "role").agg(F.sum("c").alias("n"))


@query("J13_walk_forward_splits", f"WITH {_ROWS}, f AS (SELECT i, fold, ceil(fold * n / 6.0) AS lo, ceil((fold + 1) * n / 6.0) - 1 AS hi FROM rw, (SELECT unnest(range(1, 6)) AS fold)), r AS (SELECT fold, CASE WHEN i BETWEEN lo AND hi THEN 'test' WHEN i < lo AND i + 3 >= lo THEN 'purged' WHEN i < lo THEN 'train' END AS role FROM f) SELECT fold, role, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY ALL")
def _j13(spark, sf_dir):
    d, n = _days(spark, sf_dir)
    r = d.select("i", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("fold")).withColumn("lo", F.ceil(C("fold") * F.lit(n) / 6)).withColumn("hi", F.ceil((C("fold") + 1) * F.lit(n) / 6) - 1)
    role = F.when(C("i").between(C("lo"), C("hi")), "test").when((C("i") < C("lo")) & (C("i") + 3 >= C("lo")), "purged").when(C("i") < C("lo"), "train")
    return r.select("fold", role.alias("role")).filter("role is not null").groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


_CPCV = f"WITH {_ROWS}, b AS (SELECT i, i * 5 // n AS b FROM rw), p AS (SELECT x.k AS x, y.k AS y FROM (SELECT unnest(range(5)) AS k) x, (SELECT unnest(range(5)) AS k) y WHERE x.k < y.k), r AS (SELECT x, y, i, b IN (x, y) AS test FROM b, p), s AS (SELECT *, max(CASE WHEN test THEN 1 ELSE 0 END) OVER (PARTITION BY x, y ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS near, max(CASE WHEN test THEN 1 ELSE 0 END) OVER (PARTITION BY x, y ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS after FROM r), q AS (SELECT x, y, CASE WHEN test THEN 'test' WHEN near = 1 OR after = 1 THEN 'purged' ELSE 'train' END AS role FROM s)"


def _cpcv(spark, sf_dir) -> DataFrame:
    d, n = _days(spark, sf_dir)
    r = d.withColumn("b", F.floor(C("i") * 5 / F.lit(n))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter("x < y")
    r = r.withColumn("test", (C("b") == C("x")) | (C("b") == C("y")))
    w = Window.partitionBy("x", "y").orderBy("i")
    near = F.coalesce(F.max(C("test").cast("int")).over(w.rowsBetween(1, 3)), F.lit(0)) + F.coalesce(F.max(C("test").cast("int")).over(w.rowsBetween(-3, -1)), F.lit(0))
    return r.withColumn("near", near).withColumn("role", F.when(C("test"), "test").when(C("near") > 0, "purged").otherwise("train"))


@query("J14_combinatorial_splits", f"{_CPCV} SELECT x, y, role, count(*) AS n FROM q GROUP BY ALL")
def _j14(spark, sf_dir):
    return _cpcv(spark, sf_dir).groupBy("x", "y", "role").agg(F.count(F.lit(1)).alias("n"))


@query("J15_boundary_leakage", f"{_KF(0, 0).replace('SELECT fold, CASE', 'SELECT fold, i, CASE')}, l AS (SELECT fold, role, max(CASE WHEN role = 'test' THEN 1 ELSE 0 END) OVER (PARTITION BY fold ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS hit FROM r) SELECT fold, count(*) FILTER (role = 'train' AND hit = 1) AS leaks FROM l GROUP BY fold")
def _j15(spark, sf_dir):
    """An unpurged split is audited: training rows whose label window (three rows) reaches into the test block."""
    d, n = _days(spark, sf_dir)
    s = stats.splits_kfold(n, 5, 0, 0, d)
    hit = F.max((C("role") == "test").cast("int")).over(Window.partitionBy("fold").orderBy("i").rowsBetween(1, 3))
    return s.withColumn("hit", hit).groupBy("fold").agg(F.sum(((C("role") == "train") & (F.coalesce("hit", F.lit(0)) == 1)).cast("long")).alias("leaks"))


# ---- value at risk

_OV = f"{_SECTOR}, o AS (SELECT sector, -r AS loss, row_number() OVER (PARTITION BY sector ORDER BY r) AS k, count(*) OVER (PARTITION BY sector) AS n FROM sr), v AS (SELECT sector, loss AS var FROM o WHERE k = greatest(ceil(round(0.05 * n, 9)), 1))"


@query("J16_historical_var", f"WITH {_OV} SELECT sector, round(var, 6) AS var FROM v")
def _j16(spark, sf_dir):
    return rounded(metrics.order_var(sector_returns(spark, sf_dir), ["sector"], 0.95).select("sector", "var"))


@query("J17_historical_cvar", f"WITH {_OV} SELECT sector, round(avg(loss), 6) AS cvar FROM o JOIN v USING (sector) WHERE loss >= var GROUP BY sector")
def _j17(spark, sf_dir):
    return rounded(metrics.order_var(sector_returns(spark, sf_dir), ["sector"], 0.95).select("sector", "cvar"))


@query("J18_parametric_var", f"WITH {_SECTOR} SELECT sector, round(1.6448536269514722 * stddev_samp(r) - avg(r), 6) AS var FROM sr GROUP BY sector")
def _j18(spark, sf_dir):
    from statistics import NormalDist

    return rounded(sector_returns(spark, sf_dir).groupBy("sector").agg((NormalDist().inv_cdf(0.95) * F.stddev_samp("r") - F.avg("r")).alias("var")))


_BR = f"{_SECTOR}, fc AS (SELECT *, quantile_cont(-r, 0.9) OVER (PARTITION BY sector ORDER BY date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS var, row_number() OVER (PARTITION BY sector ORDER BY date) AS k FROM sr), br AS (SELECT sector, date, CASE WHEN -r > var THEN 1 ELSE 0 END AS v FROM fc WHERE k > 24)"


def breaches(spark, sf_dir) -> DataFrame:
    """sector, date, v: losses beyond the 90% quantile of the 24 bars before."""
    w = Window.partitionBy("sector").orderBy("date")
    f = sector_returns(spark, sf_dir).withColumn("var", F.percentile(-C("r"), F.lit(0.9)).over(w.rowsBetween(-24, -1))).withColumn("k", F.row_number().over(w))
    return f.filter("k > 24").select("sector", "date", (-C("r") > C("var")).cast("int").alias("v"))


@query("J19_violations", f"WITH {_BR} SELECT sector, date, v FROM br")
def _j19(spark, sf_dir):
    return breaches(spark, sf_dir)


_XLN = lambda k, q: f"CASE WHEN {k} > 0 THEN {k} * ln({q}) ELSE 0 END"


@query("J20_kupiec", f"WITH {_BR}, s AS (SELECT sector, count(*) AS n, sum(v) AS x FROM br GROUP BY sector) SELECT sector, n, x::BIGINT AS x, round(-2 * ({_XLN('(n - x)', '0.9')} + {_XLN('x', '0.1')} - {_XLN('(n - x)', '(1 - x / n)')} - {_XLN('x', '(x / n)')}), 6) AS lr FROM s")
def _j20(spark, sf_dir):
    return rounded(stats.kupiec(breaches(spark, sf_dir), ["sector"], 0.9))


@query("J21_christoffersen", f"""WITH {_BR}, l AS (SELECT *, lag(v) OVER (PARTITION BY sector ORDER BY date) AS b FROM br), s AS (SELECT sector, count(*) FILTER (b = 0 AND v = 0) AS n00, count(*) FILTER (b = 0 AND v = 1) AS n01, count(*) FILTER (b = 1 AND v = 0) AS n10, count(*) FILTER (b = 1 AND v = 1) AS n11 FROM l WHERE b IS NOT NULL GROUP BY sector), p AS (SELECT *, (n01 + n11) / (n00 + n01 + n10 + n11) AS p, n01 / (n00 + n01) AS p01, n11 / nullif(n10 + n11, 0) AS p11 FROM s)
  SELECT sector, n00, n01, n10, n11, round(-2 * ({_XLN('(n00 + n10)', '(1 - p)')} + {_XLN('(n01 + n11)', 'p')} - {_XLN('n00', '(1 - p01)')} - {_XLN('n01', 'p01')} - {_XLN('n10', '(1 - p11)')} - {_XLN('n11', 'p11')}), 6) AS lr FROM p""")
def _j21(spark, sf_dir):
    return rounded(stats.christoffersen(breaches(spark, sf_dir), ["sector"]))


@query("J22_traffic_light", f"WITH {_BR}, s AS (SELECT sector, sum(v) AS x FROM br GROUP BY sector) SELECT sector, x::BIGINT AS x, CASE WHEN x <= 8 THEN 'green' WHEN x <= 12 THEN 'yellow' ELSE 'red' END AS zone FROM s")
def _j22(spark, sf_dir):
    """Zones end where the binomial distribution of breaches passes 95% and 99.99%; for 59 bars at 90% after 8 and 12 breaches."""
    s = breaches(spark, sf_dir).groupBy("sector").agg(F.sum("v").alias("x"))
    return s.select("sector", "x", F.when(C("x") <= 8, "green").when(C("x") <= 12, "yellow").otherwise("red").alias("zone"))


# ---- attribution

_BF = f"""WITH {PANEL}, {_RET}, sx AS (SELECT s_suppkey AS symbol, s_nationkey AS sector, (s_suppkey % 7 + 1) / sum(s_suppkey % 7 + 1) OVER () AS wp, 1.0 / count(*) OVER () AS wb FROM supplier),
bs AS (SELECT date, sector, sum(wp) AS wp, sum(wp * ret) / sum(wp) AS rp, sum(wb) AS wb, sum(wb * ret) / sum(wb) AS rb FROM rets JOIN sx USING (symbol) GROUP BY ALL), bt AS (SELECT *, sum(wb * rb) OVER (PARTITION BY date) AS total FROM bs),
bf AS (SELECT date, sector, (wp - wb) * (rb - total) AS allocation, wb * (rp - rb) AS selection, (wp - wb) * (rp - rb) AS interaction, wp * rp AS p, wb * rb AS b FROM bt)"""


def brinson_rows(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("symbol"), C("s_nationkey").alias("sector"))
    x = returns(spark, sf_dir).select("symbol", "date", "ret").join(holdings_weights(spark, sf_dir).join(s, "symbol"), "symbol").withColumn("wb", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("date")))
    ratio = lambda w: F.try_divide(F.sum(C(w) * C("ret")), F.sum(w))
    return x.groupBy("date", "sector").agg(F.sum("w").alias("wp"), ratio("w").alias("rp"), F.sum("wb").alias("wb"), ratio("wb").alias("rb"))


@query("J23_brinson", f"{_BF} SELECT date, sector, round(allocation, 6) AS allocation, round(selection, 6) AS selection, round(interaction, 6) AS interaction FROM bf")
def _j23(spark, sf_dir):
    return rounded(attribution.brinson(brinson_rows(spark, sf_dir), ["date"]).select("date", "sector", "allocation", "selection", "interaction"))


_K = lambda p, b: f"CASE WHEN abs({p} - {b}) < 1e-12 THEN 1 / (1 + {p}) ELSE (ln(1 + {p}) - ln(1 + {b})) / ({p} - {b}) END"


@query("J24_carino_link", f"{_BF}, pd AS (SELECT date, sum(allocation) AS a, sum(selection) AS s, sum(interaction) AS i, sum(p) AS rp, sum(b) AS rb FROM bf GROUP BY date), lk AS (SELECT sum(k * a) AS a, sum(k * s) AS s, sum(k * i) AS i, exp(sum(ln(1 + rp))) - 1 AS p, exp(sum(ln(1 + rb))) - 1 AS b FROM (SELECT *, {_K('rp', 'rb')} AS k FROM pd)) SELECT round(a / ({_K('p', 'b')}), 6) AS allocation, round(s / ({_K('p', 'b')}), 6) AS selection, round(i / ({_K('p', 'b')}), 6) AS interaction, round(p - b, 6) AS excess FROM lk")
def _j24(spark, sf_dir):
    e = attribution.brinson(brinson_rows(spark, sf_dir), ["date"])
    names = ["allocation", "selection", "interaction"]
    e = e.groupBy("date").agg(*[F.sum(n).alias(n) for n in names], F.sum("p").alias("rp"), F.sum("b").alias("rb"))
    return rounded(attribution.carino(e, names))


@query("J48_brinson_asset_class", f"{_BF.replace('s_nationkey AS sector', 's_nationkey % 5 AS sector')} SELECT sector AS asset_class, round(sum(allocation), 6) AS allocation, round(sum(selection), 6) AS selection FROM bf GROUP BY sector")
def _j48(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("symbol"), (C("s_nationkey") % 5).alias("sector"))
    x = returns(spark, sf_dir).select("symbol", "date", "ret").join(holdings_weights(spark, sf_dir).join(s, "symbol"), "symbol").withColumn("wb", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("date")))
    ratio = lambda w: F.try_divide(F.sum(C(w) * C("ret")), F.sum(w))
    rows = x.groupBy("date", "sector").agg(F.sum("w").alias("wp"), ratio("w").alias("rp"), F.sum("wb").alias("wb"), ratio("wb").alias("rb"))
    e = attribution.brinson(rows, ["date"]).groupBy(C("sector").alias("asset_class")).agg(F.sum("allocation").alias("allocation"), F.sum("selection").alias("selection"))
    return rounded(e)


# ---- flows of accounts

_VAL = f"WITH {CASHFLOWS}, va AS (SELECT fund, date, max(amount) AS value FROM cashflows WHERE kind = 'valuation' GROUP BY ALL), fl AS (SELECT fund, date, -amount * 0.1 AS amount FROM cashflows WHERE kind <> 'valuation')"


def _accounts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = cashflows(spark, sf_dir)
    v = c.filter("kind = 'valuation'").groupBy("fund", "date").agg(F.max("amount").alias("value"))
    return v, c.filter("kind <> 'valuation'").select("fund", "date", (-C("amount") * 0.1).alias("amount"))


@query("J25_time_weighted", f"""{_VAL}, fk AS (SELECT *, row_number() OVER () AS k FROM fl), nx AS (SELECT f.fund, f.k, any_value(f.amount) AS amount, min(v.date) AS at FROM fk f JOIN va v ON v.fund = f.fund AND v.date >= f.date GROUP BY f.fund, f.k),
  sp AS (SELECT v.fund, v.date, v.value, lag(v.value) OVER (PARTITION BY v.fund ORDER BY v.date) AS open, coalesce((SELECT sum(amount) FROM nx WHERE nx.fund = v.fund AND nx.at = v.date), 0) AS flow FROM va v), g AS (SELECT fund, (value - flow) / open AS g FROM sp WHERE open IS NOT NULL) SELECT fund, CASE WHEN min(g) > 0 THEN round(exp(sum(CASE WHEN g > 0 THEN ln(g) END)) - 1, 6) END AS twr, count(*) AS n FROM g GROUP BY fund""")
def _j25(spark, sf_dir):
    v, f = _accounts(spark, sf_dir)
    return rounded(attribution.time_weighted(v, f, "fund"))


_SPAN = f"{_VAL}, sn AS (SELECT fund, min(date) AS start, max(date) AS stop, arg_min(value, date) AS open, arg_max(value, date) AS close FROM va GROUP BY fund HAVING min(date) < max(date))"


@query("J26_modified_dietz", f"{_SPAN}, j AS (SELECT s.*, coalesce(sum(amount), 0) AS f, coalesce(sum(amount * (stop - date) / (stop - start)), 0) AS wf FROM sn s LEFT JOIN fl ON fl.fund = s.fund AND date > start AND date <= stop GROUP BY ALL) SELECT fund, round((close - open - f) / nullif(open + wf, 0), 6) AS dietz FROM j")
def _j26(spark, sf_dir):
    v, f = _accounts(spark, sf_dir)
    sn = v.groupBy("fund").agg(F.min("date").alias("start"), F.max("date").alias("stop"), F.min_by("value", "date").alias("open"), F.max_by("value", "date").alias("close")).filter("start < stop")
    return rounded(attribution.modified_dietz(sn, f, "fund"))


_NPV = lambda r: f"list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] / pow(1 + {r}, t[i])))"


@query("J27_money_weighted", f"""WITH RECURSIVE {CASHFLOWS}, dy AS (SELECT fund, date, sum(amount) AS amount, date - min(date) OVER (PARTITION BY fund) AS days FROM cashflows WHERE kind <> 'valuation' GROUP BY fund, date),
  ls AS (SELECT fund, list(amount ORDER BY date) AS a, list(days / 365.0 ORDER BY date) AS t FROM dy GROUP BY fund), ok AS (SELECT *, {_NPV('-0.9999')} AS x, {_NPV('100')} AS y FROM ls WHERE list_max(a) > 0 AND list_min(a) < 0),
  bi(fund, lo, hi, x, k) AS (SELECT fund, CAST(-0.9999 AS DOUBLE), CAST(100 AS DOUBLE), x, 0 FROM ok WHERE isfinite(x) AND x * y < 0
    UNION ALL SELECT fund, CASE WHEN m * x > 0 THEN mid ELSE lo END, CASE WHEN m * x > 0 THEN hi ELSE mid END, CASE WHEN m * x > 0 THEN m ELSE x END, k + 1 FROM (SELECT b.fund, lo, hi, b.x, k, (lo + hi) / 2 AS mid, {_NPV('(lo + hi) / 2')} AS m FROM bi b JOIN ok ON ok.fund = b.fund WHERE k < 70))
  SELECT ls.fund, round((lo + hi) / 2, 6) AS irr FROM ls LEFT JOIN (SELECT * FROM bi WHERE k = 70) b ON b.fund = ls.fund""")
def _j27(spark, sf_dir):
    return rounded(attribution.irr(cashflows(spark, sf_dir).filter("kind <> 'valuation'").select("fund", "date", "amount"), "fund"))


@query("J28_ks_pme", f"WITH {CASHFLOWS}, ix AS (SELECT DISTINCT date, 100 + date_diff('day', DATE '1995-01-01', date) * 0.05 AS level FROM cashflows), e AS (SELECT arg_max(level, date) AS e FROM ix) SELECT fund, round(sum(CASE WHEN kind <> 'contribution' THEN abs(amount) * e / level END) / sum(CASE WHEN kind = 'contribution' THEN abs(amount) * e / level END), 6) AS pme FROM cashflows JOIN ix USING (date), e GROUP BY fund")
def _j28(spark, sf_dir):
    c = cashflows(spark, sf_dir)
    ix = c.select("date").distinct().select("date", (100 + F.datediff("date", F.lit("1995-01-01").cast("date")) * 0.05).alias("level"))
    return rounded(attribution.ks_pme(c, ix, "fund"))


# ---- style and risk of factors

_EX = f"{_W}, ex AS (SELECT date, sum(weight * s_acctbal) AS e FROM weights JOIN supplier ON s_suppkey = symbol GROUP BY date)"


def exposures(spark, sf_dir) -> DataFrame:
    x = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("symbol"), "s_acctbal")
    return aligned_weights(spark, sf_dir).join(x, "symbol").groupBy("date").agg(F.sum(C("weight") * C("s_acctbal")).alias("e"))


@query("J29_style_drift", f"WITH {_EX} SELECT round(arg_min(e, date), 4) AS first, round(arg_max(e, date), 4) AS last, round(arg_max(e, date) - arg_min(e, date), 4) AS drift, round(stddev_samp(e), 4) AS spread FROM ex")
def _j29(spark, sf_dir):
    a, b = F.min_by("e", "date"), F.max_by("e", "date")
    r = lambda c, n: F.round(c, 4).alias(n)
    return exposures(spark, sf_dir).agg(r(a, "first"), r(b, "last"), r(b - a, "drift"), r(F.stddev_samp("e"), "spread"))


@query("J30_factor_attribution", f"WITH {_PORT}, mk AS (SELECT date, avg(ret) AS f FROM rets GROUP BY date) SELECT date, round(0.9 * f, 6) AS factor_part, round(r - 0.9 * f, 6) AS specific FROM port JOIN mk USING (date)")
def _j30(spark, sf_dir):
    f = returns(spark, sf_dir).groupBy("date").agg(F.avg("ret").alias("f"))
    return rounded(portfolio_returns(spark, sf_dir).join(f, "date").select("date", (0.9 * C("f")).alias("factor_part"), (C("r") - 0.9 * C("f")).alias("specific")))


@query("J31_risk_decomposition", f"WITH {_SECTOR}, cv AS (SELECT a.sector AS a, b.sector AS b, covar_samp(a.r, b.r) AS c FROM sr a JOIN sr b USING (date) GROUP BY ALL), sw AS (SELECT s_nationkey AS sector, count(*) / sum(count(*)) OVER () AS w FROM supplier GROUP BY ALL) SELECT cv.a AS sector, round(any_value(x.w) * sum(y.w * c), 6) AS contribution FROM cv JOIN sw x ON x.sector = cv.a JOIN sw y ON y.sector = cv.b GROUP BY cv.a")
def _j31(spark, sf_dir):
    r = sector_returns(spark, sf_dir)
    cov = r.select(C("sector").alias("a"), "date", C("r").alias("x")).join(r.select(C("sector").alias("b"), "date", C("r").alias("y")), "date").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("c"))
    w = table(spark, sf_dir, "supplier").groupBy(C("s_nationkey").alias("sector")).agg(F.count(F.lit(1)).alias("n"))
    w = w.select("sector", (C("n") / F.sum("n").over(one())).alias("w"))
    j = cov.join(w.select(C("sector").alias("a"), C("w").alias("wa")), "a").join(w.select(C("sector").alias("b"), C("w").alias("wb")), "b")
    return rounded(j.groupBy(C("a").alias("sector")).agg(F.sum(C("wa") * C("wb") * C("c")).alias("contribution")))


# ---- single series by key

_PAIR = f"{PANEL}, pp AS (SELECT a.symbol, a.date, a.close AS y, b.close AS x FROM panel a JOIN panel b ON b.symbol = a.symbol + 1 AND a.date = b.date WHERE a.close IS NOT NULL AND b.close IS NOT NULL)"


def pair_panel(spark, sf_dir) -> DataFrame:
    """symbol, date, y (its close), x (the next symbol's close)."""
    p = panel(spark, sf_dir).select("symbol", "date", "close").filter("close is not null")
    return p.select("symbol", "date", C("close").alias("y")).join(p.select((C("symbol") - 1).alias("symbol"), "date", C("close").alias("x")), ["symbol", "date"])


@query("J32_hedge_ratio", f"WITH {_PAIR} SELECT symbol, round(regr_slope(y, x), 6) AS beta, round(regr_intercept(y, x), 4) AS alpha, round(regr_r2(y, x), 6) AS r2 FROM pp GROUP BY symbol HAVING count(*) >= 3")
def _j32(spark, sf_dir):
    m = stats.market_model(pair_panel(spark, sf_dir), ["symbol"], "y", "x")
    return m.select("symbol", r6("beta").alias("beta"), F.round("alpha", 4).alias("alpha"), r6("r2").alias("r2"))


@query("J33_half_life", f"WITH {_PAIR}, d AS (SELECT symbol, lag(y - x) OVER ({S}) AS l, y - x - lag(y - x) OVER ({S}) AS d FROM pp), b AS (SELECT symbol, regr_slope(d, l) AS b FROM d GROUP BY symbol) SELECT symbol, CASE WHEN b < 0 THEN round(-ln(2) / b, 6) END AS half_life FROM b")
def _j33(spark, sf_dir):
    return rounded(stats.half_life(pair_panel(spark, sf_dir).withColumn("s", C("y") - C("x")), ["symbol"], "s"))


@query("J34_ljung_box", f"WITH {_SECTOR}, z AS (SELECT sector, date, r - avg(r) OVER (PARTITION BY sector) AS z FROM sr), l AS (SELECT sector, z, " + ", ".join(f"lag(z, {k}) OVER (PARTITION BY sector ORDER BY date) AS z{k}" for k in range(1, 6)) + " FROM z) SELECT sector, round(count(*) * (count(*) + 2) * (" + " + ".join(f"pow(sum(z * z{k}) / sum(z * z), 2) / (count(*) - {k})" for k in range(1, 6)) + "), 6) AS q FROM l GROUP BY sector")
def _j34(spark, sf_dir):
    return rounded(stats.ljung_box(sector_returns(spark, sf_dir), ["sector"], "r", 5))


@query("J35_auto_cluster")
def _j35(spark, sf_dir):
    """Customers by standardised features, k-means, the k of best silhouette."""
    return _clustered(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


_clusterings: dict[tuple[str, str], DataFrame] = {}


def _clustered(spark, sf_dir) -> DataFrame:
    """The clustering, which both queries share: fitted once an application and read from the shared folder."""
    from ..operators.clusters import auto_cluster

    key = spark.sparkContext.applicationId, sf_dir
    if key not in _clusterings:
        _clusterings[key] = auto_cluster(_features(spark, sf_dir), ["n", "mean", "share"], 5)
    return _clusterings[key]


def _features(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("o_totalprice").alias("mean"), F.avg((C("o_orderstatus") == "F").cast("double")).alias("share"))


@query("J36_cluster_rules")
def _j36(spark, sf_dir):
    from ..operators.clusters import rules

    return rules(_clustered(spark, sf_dir), ["n", "mean", "share"])


@query("J37_rolling_correlation", f"WITH {_SECTOR}, t AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY date DESC) AS k FROM sr), w AS (SELECT * FROM t WHERE k <= 24) SELECT a.sector AS a, b.sector AS b, round(coalesce(corr(a.r, b.r), 0), 6) AS corr FROM w a JOIN w b ON a.date = b.date AND a.sector < b.sector GROUP BY ALL")
def _j37(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("date")))
    c = pairs.correlations(sector_returns(spark, sf_dir).withColumn("k", k).filter("k <= 24").drop("k"), "sector")
    return c.select("a", "b", r6(F.coalesce("corr", F.lit(0.0))).alias("corr"))


# ---- sizing and cost

_IV = f"{PANEL}, {_RET}, iv AS (SELECT symbol, date, CASE WHEN count(r) OVER w = 12 THEN 1 / nullif(stddev_samp(r) OVER w, 0) END AS i FROM rets WINDOW w AS ({S} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)), ivw AS (SELECT symbol, date, i / sum(i) OVER (PARTITION BY date) AS weight FROM iv)"


def inverse_vol(spark, sf_dir) -> DataFrame:
    """symbol, date, weight from the volatility of strictly earlier bars; null until there are twelve."""
    w = ts.series().rowsBetween(-12, -1)
    i = F.when(F.count("r").over(w) == 12, F.try_divide(F.lit(1.0), F.stddev_samp("r").over(w)))
    return returns(spark, sf_dir).select("symbol", "date", i.alias("i")).select("symbol", "date", F.try_divide("i", F.sum("i").over(xs.section())).alias("weight"))


@query("J38_inverse_volatility", f"WITH {_IV} SELECT symbol, date, round(weight, 6) AS weight FROM ivw")
def _j38(spark, sf_dir):
    return rounded(inverse_vol(spark, sf_dir))


_CP = f"{_W}, cp AS (SELECT w.symbol, w.date, weight, coalesce(lag(weight) OVER (PARTITION BY w.symbol ORDER BY w.date), 0) AS before, coalesce(amount, 0) * 0.1 / 1e7 AS lim FROM weights w LEFT JOIN (SELECT symbol, CAST(date AS DATE) AS date, amount FROM ({BARS})) b ON b.symbol = w.symbol AND b.date = w.date)"


def sized(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir).select("symbol", "date", C("amount").alias("adv"))
    w = aligned_weights(spark, sf_dir).withColumn("before", F.coalesce(F.lag("weight").over(ts.series()), F.lit(0.0)))
    return w.join(b, ["symbol", "date"], "left").withColumn("adv", F.coalesce("adv", F.lit(0.0)))


@query("J39_adv_capacity", f"WITH {_CP} SELECT symbol, date, round(before + greatest(least(weight - before, lim), -lim), 6) AS capped FROM cp")
def _j39(spark, sf_dir):
    return rounded(attribution.capped_change(sized(spark, sf_dir), 0.1, 1e7).select("symbol", "date", "capped"))


@query("J40_borrow_cost", f"WITH {_W} SELECT date, round(coalesce(sum(CASE WHEN weight < 0 THEN -weight END), 0) * 0.03 / 12, 6) AS cost FROM weights GROUP BY date")
def _j40(spark, sf_dir):
    return rounded(aligned_weights(spark, sf_dir).groupBy("date").agg((F.coalesce(F.sum(F.when(C("weight") < 0, -C("weight"))), F.lit(0.0)) * 0.03 / 12).alias("cost")))


@query("J41_rebalance_cost", f"WITH {_CP}, k AS (SELECT *, before + greatest(least(weight - before, lim), -lim) AS c FROM cp) SELECT date, round(sum(abs(c - before)), 6) AS traded, round(sum(abs(c - before)) * 0.0005, 8) AS spread, round(sum(CASE WHEN lim > 0 THEN 0.1 * 0.02 * abs(c - before) * sqrt(abs(c - before) / (lim * 10)) ELSE 0 END), 8) AS impact FROM k GROUP BY date")
def _j41(spark, sf_dir):
    s = attribution.capped_change(sized(spark, sf_dir), 0.1, 1e7).withColumn("t", F.abs(C("capped") - C("before")))
    impact = F.when(C("adv") > 0, 0.1 * 0.02 * C("t") * F.sqrt(C("t") * 1e7 / C("adv"))).otherwise(0.0)
    return s.groupBy("date").agg(r6(F.sum("t")).alias("traded"), F.round(F.sum("t") * 0.0005, 8).alias("spread"), F.round(F.sum(impact), 8).alias("impact"))


_CAPPED = f"""{_IV}, ab AS (SELECT w.symbol, date, abs(weight) AS m, sign(weight) AS sg, s_nationkey % 5 AS grp FROM ivw w JOIN supplier ON s_suppkey = w.symbol WHERE weight IS NOT NULL AND abs(weight) > 1e-9),
  ck AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY m DESC, symbol) - 1 AS k, sum(m) OVER (PARTITION BY date) AS gross, sum(m) OVER (PARTITION BY date ORDER BY m DESC, symbol ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM ab),
  cs AS (SELECT *, (gross - k * 0.02) / rest AS scale FROM ck), cb AS (SELECT *, arg_min(scale, k) FILTER (scale > 0 AND m * scale <= 0.02 + 1e-12) OVER (PARTITION BY date) AS best FROM cs), c1 AS (SELECT symbol, date, sg, grp, CASE WHEN best IS NULL THEN 0.02 ELSE least(m * best, 0.02) END AS m FROM cb),
  fn AS (SELECT *, sum(greatest(0.008 - m, 0)) OVER (PARTITION BY date) AS need, sum(greatest(m - 0.008, 0)) OVER (PARTITION BY date) AS spare, avg(m) OVER (PARTITION BY date) AS even FROM c1),
  c2 AS (SELECT symbol, date, sg, grp, CASE WHEN need <= 1e-12 THEN m WHEN need > spare THEN even WHEN m < 0.008 THEN 0.008 ELSE m - (m - 0.008) / spare * need END AS m FROM fn), c3 AS (SELECT *, sum(m) OVER (PARTITION BY date, grp) AS total FROM c2)"""


@query("J42_constraints", f"WITH {_CAPPED} SELECT symbol, date, round(sg * CASE WHEN total > 0.22 THEN m * 0.22 / total ELSE m END, 6) AS weight FROM c3")
def _j42(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("symbol"), (C("s_nationkey") % 5).alias("grp"))
    w = inverse_vol(spark, sf_dir).filter("weight is not null").join(s, "symbol")
    return rounded(attribution.constrain(w, cap=0.02, floor=0.008, group="grp", group_cap=0.22))


# ---- search

_TERMS = ["the", "and", "for"]
_WORDS = "wd AS (SELECT {keys}, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '') AS w FROM {table})"
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(_TERMS))
_SC = " + ".join(f"ln((N - n{i} + 0.5) / (n{i} + 0.5) + 1) * t{i} * 2.5 / (t{i} + 1.5 * (0.25 + 0.75 * len / avg))" for i in range(3))
_BM = lambda keys, t: f"WITH {_WORDS.format(keys=keys, table=t)}, tf AS (SELECT {keys}, len(w) AS len, {_TF} FROM wd), tot AS (SELECT count(*) AS N, avg(len) AS avg, " + ", ".join(f"count(*) FILTER (t{i} > 0) AS n{i}" for i in range(3)) + f" FROM tf), sc AS (SELECT {keys}, {_SC} AS score FROM tf, tot)"


@query("J44_search_sessions", f"{_BM('conv_id, turn', 'conversations')}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 9) DESC, turn) AS k FROM sc WHERE score > 0) SELECT conv_id, turn, round(score, 6) AS score FROM k WHERE k = 1")
def _j44(spark, sf_dir):
    path = new_path(spark, "index")
    textindex.add(table(spark, sf_dir, "conversations"), path, ["conv_id", "turn"], "all")
    s = textindex.scores(spark, path, _TERMS)
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.round("score", 9).desc(), "turn"))
    return s.withColumn("k", k).filter("k = 1").select("conv_id", "turn", r6("score").alias("score"))


@query("J45_bm25", f"{_BM('doc_id', 'documents')} SELECT doc_id, round(score, 6) AS score FROM sc")
def _j45(spark, sf_dir):
    return rounded(stats.bm25(table(spark, sf_dir, "documents"), _TERMS, ["doc_id"]))


@query("N14_top_documents", f"{_BM('doc_id', 'documents')} SELECT doc_id, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT 20")
def _n14(spark, sf_dir):
    """The twenty best documents of an index, for a query of three words."""
    path = new_path(spark, "index")
    textindex.add(table(spark, sf_dir, "documents"), path, ["doc_id"], "all")
    return rounded(textindex.search(spark, path, _TERMS, 20))


@query("J46_idf", f"WITH {_WORDS.format(keys='doc_id', table='documents')}, t AS (SELECT unnest(list_distinct(w)) AS term FROM wd), n AS (SELECT count(*) AS N FROM documents) SELECT term, round(ln((N - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM t, n GROUP BY term, N")
def _j46(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    terms = d.select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("term")).filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = d.agg(F.count(F.lit(1)).alias("total"))
    return terms.join(F.broadcast(total)).select("term", r6(F.log((C("total") - C("n") + 0.5) / (C("n") + 0.5) + 1)).alias("idf"))


# ---- F and C: controls of factors


@query("F06_rewiring", f"""WITH {_SECTOR}, nb AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY date DESC) AS k FROM sr), pr AS (SELECT a.sector AS a, b.sector AS b, a.k, a.r AS x, b.r AS y FROM nb a JOIN nb b ON a.date = b.date AND a.sector <> b.sector),
  c AS (SELECT a, b, corr(CASE WHEN k <= 12 THEN x END, CASE WHEN k <= 12 THEN y END) AS e, corr(CASE WHEN k BETWEEN 13 AND 48 THEN x END, CASE WHEN k BETWEEN 13 AND 48 THEN y END) AS m FROM pr GROUP BY ALL) SELECT a AS sector, round(avg(abs(e - m)), 6) AS score FROM c GROUP BY a""")
def _f06(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("date")))
    r = sector_returns(spark, sf_dir).withColumn("k", k)
    both = r.select(C("sector").alias("a"), "date", "k", C("r").alias("x")).join(r.select(C("sector").alias("b"), "date", C("r").alias("y")), "date").filter("a <> b")
    part = lambda c, cond: F.when(cond, C(c))
    e, m = C("k") <= 12, C("k").between(13, 48)
    c = both.groupBy("a", "b").agg(pairs.safe_corr(part("x", e), part("y", e)).alias("e"), pairs.safe_corr(part("x", m), part("y", m)).alias("m"))
    return rounded(c.groupBy(C("a").alias("sector")).agg(F.avg(F.abs(C("e") - C("m"))).alias("score")))


_SHUF = f"{_PAIRS}, a AS (SELECT date, sd, symbol, y, f, row_number() OVER (PARTITION BY sd, date ORDER BY symbol) AS i, row_number() OVER (PARTITION BY sd, date ORDER BY {draw_sql('sd', 'symbol')}, symbol) AS j FROM pairs, (SELECT unnest(range(1, 6)) AS sd)), sh AS (SELECT a.sd, a.date, a.symbol, a.y, b.f FROM a JOIN a b ON a.sd = b.sd AND a.date = b.date AND a.i = b.j)"


def shuffled(spark, sf_dir, seeds: int = 5) -> DataFrame:
    """seed, symbol, date, f (permuted inside its date), y."""
    p = factor_rows(panel(spark, sf_dir)).filter("f is not null and y is not null").withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    w = Window.partitionBy("seed", "date")
    a = p.withColumn("i", F.row_number().over(w.orderBy("symbol"))).withColumn("j", F.row_number().over(w.orderBy(stats.draw(C("seed"), C("symbol")), "symbol")))
    return a.select("seed", "date", "symbol", "y", "i").join(a.select("seed", "date", C("j").alias("i"), "f"), ["seed", "date", "i"]).drop("i")


@query("F09_shuffle", f"WITH {PANEL}, {_SHUF} SELECT sd AS seed, symbol, date, round(f, 6) AS f FROM sh")
def _f09(spark, sf_dir):
    return shuffled(spark, sf_dir).select(C("seed").cast("long").alias("seed"), "symbol", "date", r6("f").alias("f"))


_SIC = f"{_SHUF}, rk AS (SELECT sd, date, rank() OVER (PARTITION BY sd, date ORDER BY f) + (count(*) OVER (PARTITION BY sd, date, f) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY sd, date ORDER BY y) + (count(*) OVER (PARTITION BY sd, date, y) - 1) / 2.0 AS ry FROM sh), ric AS (SELECT sd, date, corr(rf, ry) AS ic FROM rk GROUP BY ALL HAVING count(*) >= 5), rnd AS (SELECT date, avg(ic) AS ric FROM ric GROUP BY date HAVING count(*) = 5)"


def random_ic(spark, sf_dir) -> DataFrame:
    r = bench.ic_series(shuffled(spark, sf_dir), ["seed"])
    return r.groupBy("date").agg(F.avg("ic").alias("ric"), F.count(F.lit(1)).alias("n")).filter("n = 5").select("date", "ric")


@query("F10_random_ic", f"WITH {PANEL}, {_SIC} SELECT date, round(ric, 6) AS ic FROM rnd")
def _f10(spark, sf_dir):
    return random_ic(spark, sf_dir).select("date", r6("ric").alias("ic"))


_OWN = "rr AS (SELECT date, n, rank() OVER (PARTITION BY date ORDER BY f) + (count(*) OVER (PARTITION BY date, f) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS ry FROM pairs), sic AS (SELECT date, corr(rf, ry) AS ic FROM rr WHERE n >= 5 GROUP BY date)"


@query("C14_paired_ic", f"WITH {PANEL}, {_SIC}, {_OWN} SELECT date, round(ic - ric, 6) AS alpha FROM sic JOIN rnd USING (date)")
def _c14(spark, sf_dir):
    own = bench.ic_series(factor_rows(panel(spark, sf_dir)), [])
    return own.join(random_ic(spark, sf_dir), "date").select("date", r6(C("ic") - C("ric")).alias("alpha"))


@query("F15_bench_strict", f"WITH {PANEL}, {_SIC}, {_OWN} SELECT date < DATE '1999-06-01' AS train, count(*) AS n, round(avg(ic), 6) AS ic, round(avg(ic - ric), 6) AS alpha, round(avg(ic - ric) / (stddev_samp(ic - ric) / sqrt(count(*))), 6) AS t FROM sic JOIN rnd USING (date) GROUP BY 1")
def _f15(spark, sf_dir):
    j = bench.ic_series(factor_rows(panel(spark, sf_dir)), []).join(random_ic(spark, sf_dir), "date").withColumn("a", C("ic") - C("ric"))
    g = j.groupBy((C("date") < F.lit("1999-06-01").cast("date")).alias("train"))
    return rounded(g.agg(F.count(F.lit(1)).alias("n"), F.avg("ic").alias("ic"), F.avg("a").alias("alpha"), (F.avg("a") / (F.stddev_samp("a") / F.sqrt(F.count(F.lit(1))))).alias("t")))


_ST = f"{PANEL}, qx AS (SELECT date, quantile_cont(close, 0.05) AS lo, quantile_cont(close, 0.95) AS hi FROM panel GROUP BY date), wz AS (SELECT symbol, date, least(greatest(close, lo), hi) AS x, amount FROM panel JOIN qx USING (date) WHERE close IS NOT NULL), stx AS (SELECT symbol, date, (x - sum(x * amount) OVER (PARTITION BY date) / sum(amount) OVER (PARTITION BY date)) / nullif(stddev_samp(x) OVER (PARTITION BY date), 0) AS z FROM wz)"


def standardised(spark, sf_dir, value: str = "close") -> DataFrame:
    """symbol, date, z: winsorised, less the amount-weighted mean, over the plain deviation."""
    x = panel(spark, sf_dir).select("symbol", "date", "amount", xs.winsorise(C(value), 0.05).alias("x")).filter("x is not null")
    w = xs.section()
    mean = F.try_divide(F.sum(C("x") * C("amount")).over(w), F.sum("amount").over(w))
    return x.select("symbol", "date", F.try_divide(C("x") - mean, F.stddev_samp("x").over(w)).alias("z"))


@query("F11_standardise", f"WITH {_ST} SELECT symbol, date, round(z, 6) AS z FROM stx")
def _f11(spark, sf_dir):
    return rounded(standardised(spark, sf_dir))


@query("F12_style_exposures", f"WITH {_ST}, qv AS (SELECT date, quantile_cont(volume, 0.05) AS lo, quantile_cont(volume, 0.95) AS hi FROM panel GROUP BY date), wv AS (SELECT symbol, date, least(greatest(volume, lo), hi) AS x, amount FROM panel JOIN qv USING (date) WHERE volume IS NOT NULL), sv AS (SELECT symbol, date, (x - sum(x * amount) OVER (PARTITION BY date) / sum(amount) OVER (PARTITION BY date)) / nullif(stddev_samp(x) OVER (PARTITION BY date), 0) AS z FROM wv) SELECT symbol, date, round((coalesce(a.z, 0) - coalesce(b.z, 0)) / 2, 6) AS style FROM stx a FULL JOIN sv b USING (symbol, date)")
def _f12(spark, sf_dir):
    a, b = standardised(spark, sf_dir).withColumnRenamed("z", "a"), standardised(spark, sf_dir, "volume").withColumnRenamed("z", "b")
    zero = lambda c: F.coalesce(C(c), F.lit(0.0))
    return a.join(b, ["symbol", "date"], "full_outer").select("symbol", "date", r6((zero("a") - zero("b")) / 2).alias("style"))


@query("F13_factor_returns", f"WITH {_ST}, lz AS (SELECT symbol, date, lag(z) OVER ({S}) AS z, x, amount FROM (SELECT p.symbol, p.date, z, p.close / lag(p.close) OVER (PARTITION BY p.symbol ORDER BY p.date) - 1 AS x, p.amount FROM panel p LEFT JOIN stx USING (symbol, date))), s AS (SELECT date, sum(sqrt(amount)) AS w, sum(sqrt(amount) * z) AS wz, sum(sqrt(amount) * z * z) AS wzz, sum(sqrt(amount) * x) AS wx, sum(sqrt(amount) * z * x) AS wzx FROM lz WHERE z IS NOT NULL AND x IS NOT NULL AND amount IS NOT NULL GROUP BY date HAVING count(*) >= 5) SELECT date, round((w * wzx - wz * wx) / (w * wzz - wz * wz), 6) AS factor_return FROM s")
def _f13(spark, sf_dir):
    """Weighted least squares per date on the exposure one bar earlier, by normal equations: sums only."""
    p = panel(spark, sf_dir).select("symbol", "date", "amount", ts.pct_change(C("close")).alias("x")).join(standardised(spark, sf_dir), ["symbol", "date"], "left")
    p = p.withColumn("z", F.lag("z").over(ts.series())).filter("z is not null and x is not null and amount is not null").withColumn("w", F.sqrt("amount"))
    w, z, x = C("w"), C("z"), C("x")
    s = p.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * z).alias("wz"), F.sum(w * z * z).alias("wzz"), F.sum(w * x).alias("wx"), F.sum(w * z * x).alias("wzx")).filter("n >= 5")
    return s.select("date", r6(F.try_divide(C("w") * C("wzx") - C("wz") * C("wx"), C("w") * C("wzz") - C("wz") * C("wz"))).alias("factor_return"))


@query("F14_ic_analysis", f"WITH {PANEL}, {_IC} SELECT count(*) AS n, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, round(avg(ic) / (stddev_samp(ic) / sqrt(count(*))), 6) AS t, round(skewness(ic), 6) AS skew, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END), 6) AS positive FROM ic")
def _f14(spark, sf_dir):
    ic = bench.ic_series(factor_rows(panel(spark, sf_dir)), [])
    n = F.count(F.lit(1))
    skew = F.skewness("ic") * F.sqrt(n * (n - 1)) / (n - 2)
    return rounded(ic.agg(n.alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), (F.avg("ic") / (F.stddev_samp("ic") / F.sqrt(n))).alias("t"), skew.alias("skew"), F.avg((C("ic") > 0).cast("double")).alias("positive")))


# ---- K: signals

_ZS = lambda x: f"CASE WHEN min({x}) OVER (PARTITION BY date) < max({x}) OVER (PARTITION BY date) THEN ({x} - avg({x}) OVER (PARTITION BY date)) / stddev_samp({x}) OVER (PARTITION BY date) END"
_MF = f"{PANEL}, ff AS (SELECT symbol, date, close / lag(close, 3) OVER ({S}) - 1 AS a, -volume AS b FROM panel), zz AS (SELECT symbol, date, {_ZS('a')} AS a, {_ZS('b')} AS b FROM ff)"


def z_factors(spark, sf_dir) -> DataFrame:
    p = panel(spark, sf_dir).select("symbol", "date", ts.pct_change(C("close"), 3).alias("a"), (-C("volume")).alias("b"))
    return p.select("symbol", "date", xs.zscore(C("a")).alias("a"), xs.zscore(C("b")).alias("b"))


@query("K01_multi_factor", f"WITH {_MF}, k AS (SELECT symbol, date, CASE WHEN a + b IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY round(a + b, 9) DESC NULLS LAST, symbol) END AS k, dense_rank() OVER (ORDER BY date) AS d FROM zz), p AS (SELECT symbol, date, CASE WHEN (d - 1) % 3 = 0 THEN CASE WHEN k <= 10 THEN 1.0 / least(10, count(k) OVER (PARTITION BY date)) ELSE 0 END END AS w FROM k) SELECT symbol, date, round(last_value(w IGNORE NULLS) OVER ({S}), 6) AS weight FROM p")
def _k01(spark, sf_dir):
    z = z_factors(spark, sf_dir).select("symbol", "date", F.round(C("a") + C("b"), 9).alias("score"))
    w = signals.top_n_equal(z, 10)
    # every third date of the calendar; dates between carry the last weights
    months = F.months_between("date", F.min("date").over(Window.partitionBy("symbol"))).cast("int")
    held = w.withColumn("w", F.when(months % 3 == 0, C("weight")))
    return held.select("symbol", "date", r6(F.last("w", ignorenulls=True).over(ts.so_far())).alias("weight"))


@query("K02_composite", f"WITH {_MF}, k AS (SELECT symbol, date, round(0.7 * a + 0.3 * b, 9) AS s FROM zz), r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY s DESC NULLS LAST, symbol) AS t, row_number() OVER (PARTITION BY date ORDER BY s NULLS LAST, symbol) AS u FROM k) SELECT symbol, date, CASE WHEN s IS NULL THEN 0 WHEN t <= 10 THEN 1 WHEN u <= 10 THEN -1 ELSE 0 END AS signal FROM r")
def _k02(spark, sf_dir):
    z = z_factors(spark, sf_dir).select("symbol", "date", F.round(0.7 * C("a") + 0.3 * C("b"), 9).alias("s"))
    w = Window.partitionBy("date")
    t, u = F.row_number().over(w.orderBy(C("s").desc_nulls_last(), "symbol")), F.row_number().over(w.orderBy(C("s").asc_nulls_last(), "symbol"))
    return z.select("symbol", "date", F.when(C("s").isNull(), 0).when(t <= 10, 1).when(u <= 10, -1).otherwise(0).alias("signal"))


@query("K03_pair_trading", f"WITH {_PAIR}, q AS (SELECT symbol, date, y / x AS q FROM pp), z AS (SELECT symbol, date, CASE WHEN count(q) OVER w = 12 THEN (q - avg(q) OVER w) / nullif(stddev_samp(q) OVER w, 0) END AS z FROM q WINDOW w AS ({S} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT symbol, date, CASE WHEN z > 2 THEN -1 WHEN z < -2 THEN 1 ELSE 0 END AS signal FROM z")
def _k03(spark, sf_dir):
    q = pair_panel(spark, sf_dir).withColumn("q", F.try_divide("y", "x"))
    z = F.try_divide(C("q") - ts.ts_mean(C("q"), 12), ts.ts_std(C("q"), 12))
    return q.select("symbol", "date", F.when(z > 2, -1).when(z < -2, 1).otherwise(0).alias("signal"))


@query("K04_seasonal", "SELECT event_id, CASE WHEN month(ts) IN (11, 12, 1) AND dayofweek(ts) NOT IN (0, 6) THEN 1 WHEN dayofweek(ts) = 1 THEN -1 ELSE 0 END AS signal FROM events")
def _k04(spark, sf_dir):
    day = F.dayofweek("ts") - 1
    return table(spark, sf_dir, "events").select("event_id", F.when(F.month("ts").isin(11, 12, 1) & ~day.isin(0, 6), 1).when(day == 1, -1).otherwise(0).alias("signal"))


_MID = lambda n: f"({agg('max', 'high', n)} + {agg('min', 'low', n)}) / 2"


@query("K05_ichimoku", f"WITH {PANEL}, m AS (SELECT symbol, date, close, {_MID(5)} AS t, {_MID(9)} AS k, {_MID(18)} AS b FROM panel), c AS (SELECT *, lag((t + k) / 2, 4) OVER ({S}) AS a4, lag(b, 4) OVER ({S}) AS b4 FROM m) SELECT symbol, date, CASE WHEN t > k AND close > greatest(a4, b4) AND a4 > b4 AND b4 IS NOT NULL THEN 1 WHEN t < k AND close < least(a4, b4) AND a4 < b4 AND b4 IS NOT NULL THEN -1 ELSE 0 END AS signal FROM c")
def _k05(spark, sf_dir):
    from ..operators.indicators import donchian_mid

    mid = lambda n: donchian_mid(C("high"), C("low"), n)
    m = panel(spark, sf_dir).select("symbol", "date", "close", mid(5).alias("t"), mid(9).alias("k"), mid(18).alias("b"))
    m = m.withColumn("a4", ts.delay((C("t") + C("k")) / 2, 4)).withColumn("b4", ts.delay(C("b"), 4))
    up = (C("t") > C("k")) & (C("close") > F.greatest("a4", "b4")) & (C("a4") > C("b4")) & C("b4").isNotNull()
    down = (C("t") < C("k")) & (C("close") < F.least("a4", "b4")) & (C("a4") < C("b4")) & C("b4").isNotNull()
    return m.select("symbol", "date", F.when(up, 1).when(down, -1).otherwise(0).alias("signal"))


@query("K06_technical", f"WITH {PANEL}, m AS (SELECT symbol, date, {agg('avg', 'close', 5)} AS f, {agg('avg', 'close', 20)} AS s, volume, {agg('avg', 'volume', 10)} AS v, {agg('stddev_samp', 'close', 20)} AS d, close FROM panel) SELECT symbol, date, CASE WHEN (f > s OR close < s - 2 * d) AND volume > v AND NOT close > s + 2 * d THEN 1 WHEN (f < s OR close > s + 2 * d) AND volume > v AND NOT close < s - 2 * d THEN -1 ELSE 0 END AS signal FROM m")
def _k06(spark, sf_dir):
    c = C("close")
    m = panel(spark, sf_dir).select("symbol", "date", "close", "volume", ts.ts_mean(c, 5).alias("f"), ts.ts_mean(c, 20).alias("s"), ts.ts_std(c, 20).alias("d"), ts.ts_mean(C("volume"), 10).alias("v"))
    hi, lo = C("s") + 2 * C("d"), C("s") - 2 * C("d")
    buy = ((C("f") > C("s")) | (c < lo)) & (C("volume") > C("v")) & ~(c > hi)
    sell = ((C("f") < C("s")) | (c > hi)) & (C("volume") > C("v")) & ~(c < lo)
    return m.select("symbol", "date", F.when(buy, 1).when(sell, -1).otherwise(0).alias("signal"))


@query("K07_volatility_bands", f"WITH {PANEL}, r AS (SELECT *, ln(close / {lag('close')}) AS r FROM panel), h AS (SELECT *, round({agg('stddev_samp', 'r', 6)}, 9) AS hv FROM r), l AS (SELECT *, list(hv) {over(10)} AS v FROM h), p AS (SELECT symbol, date, {guard('(len(list_filter(v, lambda a: a < hv)) + 0.5 * (len(list_filter(v, lambda a: a = hv)) + 1)) / 10', 'hv', 10)} AS p FROM l) SELECT symbol, date, CASE WHEN p <= 0.2 THEN 1 WHEN p >= 0.8 THEN -1 ELSE 0 END AS signal FROM p")
def _k07(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("r", F.log(ts.pct_change(C("close")) + 1)).withColumn("hv", F.round(ts.ts_std(C("r"), 6), 9))
    k = ts.ts_rank(C("hv"), 10)
    return p.select("symbol", "date", F.when(k <= 0.2, 1).when(k >= 0.8, -1).otherwise(0).alias("signal"))


@query("K08_cross_market", f"WITH {PANEL}, m AS (SELECT symbol, date, CASE WHEN symbol % 2 = 0 THEN {agg('avg', 'close', 3)} - {agg('avg', 'close', 12)} ELSE {agg('avg', 'close', 5)} - {agg('avg', 'close', 20)} END AS x, close / {lag('close')} - 1 AS r FROM panel), v AS (SELECT *, CASE WHEN count(r) OVER w = 6 THEN 1 / nullif(stddev_samp(r) OVER w, 0) END AS iv FROM m WINDOW w AS ({S} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) SELECT symbol, date, round(sign(x) * iv / sum(iv) OVER (PARTITION BY date), 6) AS weight FROM v")
def _k08(spark, sf_dir):
    """Window lengths by market; weights by the volatility of earlier bars, never of the whole sample."""
    c = C("close")
    x = F.when(C("symbol") % 2 == 0, ts.ts_mean(c, 3) - ts.ts_mean(c, 12)).otherwise(ts.ts_mean(c, 5) - ts.ts_mean(c, 20))
    m = panel(spark, sf_dir).select("symbol", "date", x.alias("x"), ts.pct_change(c).alias("r"))
    w = ts.series().rowsBetween(-6, -1)
    m = m.withColumn("iv", F.when(F.count("r").over(w) == 6, F.try_divide(F.lit(1.0), F.stddev_samp("r").over(w))))
    return m.select("symbol", "date", r6(F.signum("x") * F.try_divide("iv", F.sum("iv").over(xs.section()))).alias("weight"))


@query("K09_event_driven", "WITH scored AS (SELECT user_id AS symbol, CAST(ts AS DATE) + CASE WHEN hour(ts) >= 15 THEN 1 ELSE 0 END AS day, CASE event_type WHEN 'error' THEN -0.3 ELSE 0.3 END AS s FROM events WHERE event_type IN ('error', 'purchase')), points AS (SELECT DISTINCT user_id AS symbol, CAST(ts AS DATE) AS day FROM events), sc AS (SELECT p.symbol, p.day, round(coalesce(sum(s * exp(-0.4 * date_diff('day', e.day, p.day))), 0), 9) AS score FROM points p LEFT JOIN scored e ON e.symbol = p.symbol AND e.day <= p.day AND e.day > p.day - 5 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, symbol) AS k FROM sc WHERE score >= 0.2) SELECT day, symbol, round(1.0 / count(*) OVER (PARTITION BY day), 6) AS weight FROM k WHERE k <= 10")
def _k09(spark, sf_dir):
    from ..operators.asof import window_sum
    from .portfolio import scored_events

    points = table(spark, sf_dir, "events").select(C("user_id").alias("symbol"), F.to_date("ts").alias("day")).distinct()
    sc = window_sum(points, scored_events(spark, sf_dir), ["symbol"], "day", "known", 5, C("s") * F.exp(-0.4 * C("_age"))).withColumn("score", F.round("score", 9)).filter("score >= 0.2")
    w = Window.partitionBy("day")
    best = sc.withColumn("k", F.row_number().over(w.orderBy(F.desc("score"), "symbol"))).filter("k <= 10")
    return best.select("day", "symbol", r6(1.0 / F.count(F.lit(1)).over(w)).alias("weight"))


@query("K10_fundamental_filter", "WITH f AS (SELECT o_custkey AS symbol, year(o_orderdate) AS year, sum(o_totalprice) AS revenue, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS profit FROM orders GROUP BY ALL), g AS (SELECT symbol, year, CASE WHEN profit IS NOT NULL THEN revenue > 400000 AND profit > 100000 ELSE revenue > 900000 END AS ok FROM f) SELECT symbol, year, round(CASE WHEN ok THEN 1.0 / sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY year) ELSE 0 END, 6) AS weight FROM g")
def _k10(spark, sf_dir):
    f = table(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("symbol"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("revenue"), F.sum(F.when(C("o_orderstatus") == "O", C("o_totalprice"))).alias("profit"))
    ok = F.when(C("profit").isNotNull(), (C("revenue") > 400000) & (C("profit") > 100000)).otherwise(C("revenue") > 900000)
    g = f.withColumn("ok", ok.cast("int"))
    return g.select("symbol", "year", r6(F.when(C("ok") == 1, 1.0 / F.sum("ok").over(Window.partitionBy("year"))).otherwise(0.0)).alias("weight"))


_CD = f"""{PANEL}, cd AS (SELECT symbol, date, open AS o, high AS h, low AS l, close AS c, abs(close - open) AS b, high - low AS g, high - greatest(open, close) AS u, least(open, close) - low AS d,
  {lag('open')} AS o1, {lag('close')} AS c1, {lag('open', 2)} AS o2, {lag('close', 2)} AS c2 FROM panel)"""
#: Candle patterns as conditions on the last three candles, with their sign.
CANDLES = {
    "hammer": (1, "d > 2 * b AND u < b AND g > 0"),
    "inverted_hammer": (1, "u > 2 * b AND d < b AND c1 < o1"),
    "shooting_star": (-1, "u > 2 * b AND d < b AND c1 > o1"),
    "bullish_engulfing": (1, "c1 < o1 AND c > o AND o <= c1 AND c >= o1"),
    "bearish_engulfing": (-1, "c1 > o1 AND c < o AND o >= c1 AND c <= o1"),
    "bullish_harami": (1, "c1 < o1 AND c > o AND o >= c1 AND c <= o1"),
    "bearish_harami": (-1, "c1 > o1 AND c < o AND o <= c1 AND c >= o1"),
    "piercing": (1, "c1 < o1 AND c > o AND o < c1 AND c > (o1 + c1) / 2 AND c < o1"),
    "dark_cloud": (-1, "c1 > o1 AND c < o AND o > c1 AND c < (o1 + c1) / 2 AND c > o1"),
    "morning_star": (1, "c2 < o2 AND abs(c1 - o1) < abs(c2 - o2) * 0.3 AND c > o AND c > (o2 + c2) / 2"),
    "evening_star": (-1, "c2 > o2 AND abs(c1 - o1) < abs(c2 - o2) * 0.3 AND c < o AND c < (o2 + c2) / 2"),
    "three_soldiers": (1, "c > o AND c1 > o1 AND c2 > o2 AND c > c1 AND c1 > c2"),
    "three_crows": (-1, "c < o AND c1 < o1 AND c2 < o2 AND c < c1 AND c1 < c2"),
}
_SUM = " + ".join(f"CASE WHEN {cond} THEN {sign} ELSE 0 END" for sign, cond in CANDLES.values())


@query("K11_candles", f"WITH {_CD} SELECT symbol, date, {_SUM} AS score FROM cd")
def _k11(spark, sf_dir):
    p = panel(spark, sf_dir)
    o, h, low, c = (C(x) for x in ("open", "high", "low", "close"))
    d = p.select(
        "symbol", "date", o.alias("o"), c.alias("c"), F.abs(c - o).alias("b"), (h - low).alias("g"), (h - F.greatest(o, c)).alias("u"), (F.least(o, c) - low).alias("d"),
        ts.delay(o, 1).alias("o1"), ts.delay(c, 1).alias("c1"), ts.delay(o, 2).alias("o2"), ts.delay(c, 2).alias("c2"),
    )
    return d.select("symbol", "date", F.expr(_SUM).alias("score"))


# ---- L: streams run to their end over the events, beside their batch twins

from ..streaming import streams  # noqa: E402


@query("L01_stream_ohlcv", "SELECT user_id AS symbol, date_trunc('hour', ts) AS bar, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2")
def _l01(spark, sf_dir):
    return streams.run_to_end(streams.ohlcv(streams.events(spark, sf_dir), "1 hour", "1 day"), "complete")


@query("L02_stream_dedupe", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def _l02(spark, sf_dir):
    return streams.run_to_end(streams.dedupe(streams.events(spark, sf_dir), "40 days"), "append")


@query("L03_stream_score", "SELECT user_id AS symbol, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2000-01-01') AS day, round(sum(CASE event_type WHEN 'error' THEN -0.3 WHEN 'purchase' THEN 0.3 ELSE 0 END * exp(-0.4 * (epoch(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2000-01-01')) + 86400 - epoch(ts)) / 86400)), 6) AS score FROM events GROUP BY 1, 2")
def _l03(spark, sf_dir):
    return streams.run_to_end(streams.score(streams.events(spark, sf_dir), "1 day", 0.4), "complete").withColumn("score", F.round("score", 6))


@query("L04_stream_regime", "SELECT user_id, coalesce(arg_max(CASE WHEN value >= 300 THEN 1 ELSE 0 END, (ts, event_id)) FILTER (value >= 300 OR value <= 20), 0) AS state, count(*) AS n FROM events GROUP BY user_id")
def _l04(spark, sf_dir):
    with streams.keyed_store(spark):
        return streams.run_to_end(streams.regime_machine(streams.events(spark, sf_dir), 300.0, 20.0), "update", ["user_id"]).select("user_id", "state", "n")


@query("L05_stream_late", "SELECT event_type, ts > TIMESTAMP '2024-01-20' AS late, count(*) AS n FROM events GROUP BY ALL")
def _l05(spark, sf_dir):
    from datetime import datetime

    good, late = streams.split_late(streams.events(spark, sf_dir), datetime(2024, 1, 20))
    both = good.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.groupBy("event_type", "late").agg(F.count(F.lit(1)).alias("n"))


@query("L06_register_factor", f"WITH {PANEL} SELECT symbol, date, round((close - open) / nullif(high - low, 0), 6) AS value FROM panel")
def _l06(spark, sf_dir):
    from ..operators.registry import Registry

    r = Registry()
    r.register("body_share", lambda p: p.withColumn("value", F.try_divide(C("close") - C("open"), C("high") - C("low"))), {"theme": ["shape"]})
    return rounded(r.compute("body_share", panel(spark, sf_dir)))


@query("L07_event_scorer", "SELECT conv_id, turn, round(least(length(text) / 1000.0, 1), 6) AS score FROM conversations")
def _l07(spark, sf_dir):
    from ..operators.registry import score_events

    return rounded(score_events(table(spark, sf_dir, "conversations"), lambda text: (text.str.len() / 1000.0).clip(upper=1.0)).select("conv_id", "turn", "score"))
