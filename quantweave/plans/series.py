"""Queries on single series and pairs of them, for every key: unit roots, cointegration, causality, collinearity, variance of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..data import CASHFLOWS, PANEL, cashflows, panel
from ..operators import leastsq
from .portfolio import _RET, returns, rounded
from .registry import query, r6, table
from .statistics import _PAIR, pair_panel

C = F.col
S = "PARTITION BY symbol ORDER BY date"
#: All pairs of symbols of a sector. They are the result's rows, so the work grows with the square of a sector's symbols.
_WITHIN = f"{PANEL}, pw AS (SELECT a.symbol AS a, b.symbol AS b, a.date, a.close AS y, b.close AS x FROM panel a JOIN panel b ON a.sector = b.sector AND a.date = b.date AND a.symbol < b.symbol WHERE a.close IS NOT NULL AND b.close IS NOT NULL)"


def sums_sql(size: int) -> str:
    return ", ".join(f"sum(v{i} * v{j}) AS s{i}_{j}" for i in range(size + 1) for j in range(i, size + 1))


def eliminated(name: str, source: str, carry: str, size: int, pivots: int) -> str:
    """CTEs name_0.. in which the sums of `source` have had one more of the first variables eliminated; a pivot of 0 is skipped."""
    out, before = [], source
    for k in range(pivots):
        rest = ", ".join(f"s{i}_{j} - CASE WHEN s{k}_{k} = 0 THEN 0 ELSE s{k}_{i} * s{k}_{j} / s{k}_{k} END AS s{i}_{j}" for i in range(k + 1, size + 1) for j in range(i, size + 1))
        out.append(f"{name}_{k} AS (SELECT {carry}, {rest} FROM {before})")
        before = f"{name}_{k}"
    return ", ".join(out)


def unit_root_sql(source: str, keys: str, lags: int, constant: bool = True) -> str:
    """CTEs up to `adf` (keys, n, lags, statistic) of the series v by date in `source`."""
    w, first = f"PARTITION BY {keys} ORDER BY date", int(constant)
    y = f"v - avg(v) OVER (PARTITION BY {keys})" if constant else "v"
    size, level = lags + 2 if constant else lags + 1, lags + first
    lagged = "".join(f", coalesce(lag(d, {j}) OVER ({w}), 0) AS v{j - 1 + first}" for j in range(1, lags + 1))
    one = ", 1.0 AS v0" if constant else ""
    s = lambda i, j: f"s{i}_{j}"
    a, b, c = s(level, level), s(level, size), s(size, size)
    steps = [f"e_{j - 1 + first}" if j + first else "g1" for j in range(lags + 1)]
    scores = " UNION ALL ".join(f"SELECT {keys}, {j} AS lags, n * (ln(2 * pi() * ({c} - {b} * {b} / {a}) / n) + 1) + {2 * (j + 1 + first)} AS score FROM {t} WHERE {j} <= own" for j, t in enumerate(steps))
    masked = ", ".join((f"v{i}" if i < first or i >= level else f"CASE WHEN {i - first + 1} <= u.lags THEN v{i} ELSE 0 END AS v{i}") for i in range(size + 1))
    on = " AND ".join(f"x1.{k.strip()} = u.{k.strip()}" for k in keys.split(","))
    last = f"h_{lags - 1 + first}" if lags + first else "g2"
    picked = ", ".join(f"x1.{k.strip()}" for k in keys.split(","))
    return f"""y0 AS (SELECT {keys}, date, {y} AS y, count(*) OVER (PARTITION BY {keys}) AS nt, row_number() OVER ({w}) AS i FROM {source} WHERE v IS NOT NULL),
y1 AS (SELECT *, y - lag(y) OVER ({w}) AS d, lag(y) OVER ({w}) AS l FROM y0),
x0 AS (SELECT {keys}, i, least({lags}, greatest(0, nt // 2 - {1 + first})) AS own{one}{lagged}, l AS v{level}, d AS v{size} FROM y1), x1 AS (SELECT * FROM x0 WHERE i > 1),
g1 AS (SELECT {keys}, own, count(*) AS n, {sums_sql(size)} FROM x1 WHERE i - 1 >= own + 1 GROUP BY {keys}, own), {eliminated("e", "g1", f"{keys}, own, n", size, lags + first)},
sc AS ({scores}), us AS (SELECT {keys}, arg_min(lags, (score, lags)) AS lags FROM sc GROUP BY {keys}),
x2 AS (SELECT {picked}, u.lags, {masked} FROM x1 JOIN us u ON {on} WHERE i - 1 >= u.lags + 1),
g2 AS (SELECT {keys}, lags, count(*) AS n, {sums_sql(size)} FROM x2 GROUP BY {keys}, lags), {eliminated("h", "g2", f"{keys}, lags, n", size, lags + first)},
adf AS (SELECT {keys}, n, lags, {b} / {a} / sqrt(({c} - {b} * {b} / {a}) / (n - lags - {1 + first}) / {a}) AS statistic FROM {last})"""


@query("N01_unit_root", f"WITH {PANEL}, ps AS (SELECT symbol, date, close AS v FROM panel), {unit_root_sql('ps', 'symbol', 4)} SELECT symbol, n, CAST(lags AS BIGINT) AS lags, round(statistic, 5) AS statistic FROM adf")
def _unit_root(spark, sf_dir):
    found = leastsq.unit_root(panel(spark, sf_dir).select("symbol", "date", "close"), ["symbol"], "date", "close", lags=4)
    return found.select("symbol", "n", "lags", F.round("statistic", 5).alias("statistic"))


@query(
    "N02_cointegration",
    f"WITH {_WITHIN}, rb AS (SELECT a, b, regr_slope(y, x) AS s, avg(y) AS my, avg(x) AS mx FROM pw GROUP BY a, b), ps AS (SELECT pw.a AS a, pw.b AS b, date, y - my - s * (x - mx) AS v FROM pw JOIN rb ON pw.a = rb.a AND pw.b = rb.b), "
    f"{unit_root_sql('ps', 'a, b', 3, False)} SELECT a, b, n, CAST(lags AS BIGINT) AS lags, round(statistic, 5) AS statistic FROM adf",
)
def _cointegration(spark, sf_dir):
    found = leastsq.cointegration_within(panel(spark, sf_dir), "sector", "symbol", "date", "close", lags=3, p=False, places=5)
    return found.select("a", "b", "n", "lags", "statistic")


@query("N03_unit_root_lags")
def _unit_root_lags(spark, sf_dir):
    """With the default number of lags for each length, and tail probabilities."""
    return rounded(leastsq.unit_root(panel(spark, sf_dir).select("symbol", "date", "close"), ["symbol"], "date", "close"))


def _granger_sql(lags: int) -> str:
    parts, ends = [], []
    for d, (target, own, other) in enumerate((("y", "y", "x"), ("x", "x", "y"))):
        for j in range(1, lags + 1):
            names = ["1.0", *(f"{own}{k}" for k in range(1, j + 1)), *(f"{other}{k}" for k in range(1, j + 1)), target]
            tag, size = f"{'ab'[d]}{j}", 2 * j + 1
            parts.append(f"{tag}v AS (SELECT a, b, {', '.join(f'{c} AS v{i}' for i, c in enumerate(names))} FROM gl WHERE i > {j}), {tag}g AS (SELECT a, b, count(*) AS n, {sums_sql(size)} FROM {tag}v GROUP BY a, b), {eliminated(tag, f'{tag}g', 'a, b, n', size, 2 * j + 1)}")
            r, f = f"{tag}_{j}", f"{tag}_{2 * j}"
            ends.append(f"SELECT {r}.a, {r}.b, '{('x->y', 'y->x')[d]}' AS direction, {j} AS lag, {r}.n, ({r}.s{size}_{size} - {f}.s{size}_{size}) / {j} / ({f}.s{size}_{size} / ({r}.n - {2 * j + 1})) AS f FROM {r} JOIN {f} ON {r}.a = {f}.a AND {r}.b = {f}.b")
    lagged = ", ".join(f"lag({c}, {k}) OVER (PARTITION BY a, b ORDER BY date) AS {c}{k}" for c in "yx" for k in range(1, lags + 1))
    return f"gm AS (SELECT a, b, date, y - avg(y) OVER (PARTITION BY a, b) AS y, x - avg(x) OVER (PARTITION BY a, b) AS x FROM pw), gl AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY date) AS i, {lagged} FROM gm), {', '.join(parts)}, gr AS ({' UNION ALL '.join(ends)})"


@query("N04_granger", f"WITH {_WITHIN}, {_granger_sql(2)} SELECT a, b, direction, CAST(lag AS BIGINT) AS lag, n, round(f, 5) AS f FROM gr")
def _granger(spark, sf_dir):
    found = leastsq.granger_within(panel(spark, sf_dir), "sector", "symbol", "date", "close", 2, p=False, places=5)
    return found.select("a", "b", "direction", "lag", "n", "f")


_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _inflation_sql() -> str:
    parts, ends = [], []
    centred = ", ".join(f"{c} - avg({c}) OVER () AS {c}" for c in _FEATURES)
    for k, c in enumerate(_FEATURES):
        names = [*(x for x in _FEATURES if x != c), c]
        size = len(names) - 1
        parts.append(f"q{k} AS (SELECT {', '.join(f'{x} AS v{i}' for i, x in enumerate(names))} FROM fc), g{k} AS (SELECT 1 AS one, {sums_sql(size)} FROM q{k}), {eliminated(f'e{k}', f'g{k}', 'one', size, size)}")
        ends.append(f"SELECT '{c}' AS feature, g{k}.s{size}_{size} / e{k}_{size - 1}.s{size}_{size} AS vif FROM g{k}, e{k}_{size - 1}")
    return f"fc AS (SELECT {centred} FROM lineitem), {', '.join(parts)}, vi AS ({' UNION ALL '.join(ends)})"


@query("N05_variance_inflation", f"WITH {_inflation_sql()} SELECT feature, round(vif, 6) AS vif, CASE WHEN vif > 10 THEN 'severe' WHEN vif > 5 THEN 'watch' ELSE 'normal' END AS concern FROM vi")
def _inflation(spark, sf_dir):
    return rounded(leastsq.variance_inflation(table(spark, sf_dir, "lineitem"), list(_FEATURES)))


@query(
    "N06_heteroscedasticity",
    f"WITH {_PAIR}, rb AS (SELECT symbol, regr_slope(y, x) AS s, avg(y) AS my, avg(x) AS mx, stddev_pop(x) AS sx FROM pp GROUP BY symbol HAVING count(*) > 2), er AS (SELECT pp.symbol, y - my - s * (x - mx) AS e, (x - mx) / sx AS z FROM pp JOIN rb ON pp.symbol = rb.symbol), "
    f"hv AS (SELECT symbol, 1.0 AS v0, z AS v1, z * z AS v2, e * e / avg(e * e) OVER (PARTITION BY symbol) AS v3 FROM er), hg AS (SELECT symbol, count(*) AS n, {sums_sql(3)} FROM hv GROUP BY symbol), {eliminated('h', 'hg', 'symbol, n', 3, 3)} "
    "SELECT h_0.symbol, h_0.n, round(h_0.n * (1 - h_1.s3_3 / h_0.s3_3), 5) AS breusch_pagan, round(h_0.n * (1 - h_2.s3_3 / h_0.s3_3), 5) AS white FROM h_0 JOIN h_1 USING (symbol) JOIN h_2 USING (symbol)",
)
def _heteroscedasticity(spark, sf_dir):
    found = leastsq.heteroscedasticity(pair_panel(spark, sf_dir), ["symbol"], "y", ["x"])
    return found.select("symbol", "n", F.round("breusch_pagan", 5).alias("breusch_pagan"), F.round("white", 5).alias("white"))


_OWN = f"{PANEL}, lv AS (SELECT symbol, date, close, ln(volume) AS size, high / low - 1 AS spread FROM panel WHERE close IS NOT NULL AND volume > 0 AND low > 0)"


@query(
    "N07_least_squares",
    f"WITH {_OWN}, lc AS (SELECT symbol, 1.0 AS v0, size - avg(size) OVER (PARTITION BY symbol) AS v1, spread - avg(spread) OVER (PARTITION BY symbol) AS v2, close - avg(close) OVER (PARTITION BY symbol) AS v3 FROM lv), "
    f"lg AS (SELECT symbol, count(*) AS n, {sums_sql(3)} FROM lc GROUP BY symbol), {eliminated('k', 'lg', 'symbol, n', 3, 3)} "
    "SELECT k_1.symbol, k_1.n, round(k_1.s2_3 / k_1.s2_2, 4) AS spread, round(sqrt(k_2.s3_3 / (k_1.n - 3) / k_1.s2_2), 4) AS se, round(1 - k_2.s3_3 / k_0.s3_3, 6) AS r2 FROM k_0 JOIN k_1 USING (symbol) JOIN k_2 USING (symbol) WHERE k_1.n > 3",
)
def _least_squares(spark, sf_dir):
    """Closes on the size of trade and the spread of the bar."""
    p = panel(spark, sf_dir).filter("close is not null and volume > 0 and low > 0")
    p = p.select("symbol", "close", F.log("volume").alias("size"), (C("high") / C("low") - 1).alias("spread"))
    fit = leastsq.least_squares(p, ["symbol"], "close", ["size", "spread"]).filter("coef is not null")
    return fit.select("symbol", "n", F.round(C("coef")[2], 4).alias("spread"), F.round(C("se")[1], 4).alias("se"), F.round("r2", 6).alias("r2"))


# ---- regimes, and books by optimisation


@query("N08_markov_regimes")
def _markov(spark, sf_dir):
    """Two regimes of each symbol's monthly returns."""
    from ..operators.regimes import markov

    r = returns(spark, sf_dir).filter("r is not null").select("symbol", "date", "r")
    fit = markov(r, ["symbol"], "date", "r", tol=1e-7)
    return fit.select("symbol", "n", "converged", r6("llf").alias("llf"), *[r6(C(c)[i]).alias(f"{c}_{i}") for c in ("means", "vols") for i in (0, 1)], r6(C("transition")[0]).alias("stays_calm"), "current")


def sector_books(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Returns, and positions of one a symbol and date; a sector's symbols are a book."""
    r = returns(spark, sf_dir).select("symbol", "date", "r")
    s = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("symbol"), C("s_nationkey").alias("sector"))
    return r, r.select("symbol", "date").join(s, "symbol").withColumn("weight", F.when(C("symbol") % 2 == 0, 1.0).otherwise(-1.0))


def _optimised(spark, sf_dir, method: str) -> DataFrame:
    from ..operators.optimizers import optimise

    r, p = sector_books(spark, sf_dir)
    return rounded(optimise(r, p, method, 24, ["sector"]))


@query("N09_risk_parity")
def _risk_parity(spark, sf_dir):
    return _optimised(spark, sf_dir, "risk_parity")


@query("N10_max_diversification")
def _diversification(spark, sf_dir):
    return _optimised(spark, sf_dir, "diversification")


@query("N11_max_sharpe")
def _sharpe(spark, sf_dir):
    return _optimised(spark, sf_dir, "sharpe")


#: Books of two neighbours have answers in closed form: both parities weigh by inverse volatility, and the Sharpe ratio by
#: the inverse covariance, or all on one symbol where the other would be short.
_TWO = f"""{PANEL}, {_RET}, pr AS (SELECT x.symbol // 2 AS book, x.date, x.r AS a, y.r AS b, x.symbol AS sa, y.symbol AS sb FROM rets x JOIN rets y ON y.symbol = x.symbol + 1 AND x.date = y.date WHERE x.symbol % 2 = 0),
  cv AS (SELECT *, count(*) OVER w AS k, count(a) OVER w AS na, count(b) OVER w AS nb, regr_count(a, b) OVER w AS nab, avg(a) OVER w AS ma, avg(b) OVER w AS mb, var_samp(a) OVER w AS va, var_samp(b) OVER w AS vb, covar_samp(a, b) OVER w AS c
    FROM pr WINDOW w AS (PARTITION BY book ORDER BY date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
  rd AS (SELECT *, (va + vb) / 2 * 1e-8 AS e FROM cv), sv AS (SELECT *, (ma * (vb + e) - mb * c) AS ya, (mb * (va + e) - ma * c) AS yb FROM rd),
  wt AS (SELECT book, date, sa, sb, CASE WHEN k < 24 OR nab < 2 THEN NULL ELSE sqrt(vb + e) / (sqrt(va + e) + sqrt(vb + e)) END AS pa,
    CASE WHEN k < 24 OR nab < 2 THEN NULL WHEN greatest(ma, mb) <= 0 THEN 0.5 WHEN ya > 0 AND yb > 0 THEN ya / (ya + yb) WHEN ma / sqrt(va) > mb / sqrt(vb) THEN 1 ELSE 0 END AS ha FROM sv)"""


def _two(which: str) -> str:
    return f"WITH {_TWO} SELECT sa AS symbol, date, book, round(coalesce({which}, 1), 5) AS weight FROM wt UNION ALL SELECT sb, date, book, round(coalesce(1 - {which}, 1), 5) FROM wt"


def _pair_books(spark, sf_dir, method: str) -> DataFrame:
    from ..operators.optimizers import optimise

    r = returns(spark, sf_dir).select("symbol", "date", "r")
    both = r.select((F.floor(C("symbol") / 2)).alias("book"), "symbol").distinct().groupBy("book").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    p = r.select("symbol", "date", F.floor(C("symbol") / 2).alias("book"), F.lit(1.0).alias("weight")).join(both.select("book"), "book")
    return optimise(r, p, method, 24, ["book"]).select("symbol", "date", "book", F.round("weight", 5).alias("weight"))


@query("N12_risk_parity_pairs", _two("pa"))
def _parity_pairs(spark, sf_dir):
    return _pair_books(spark, sf_dir, "risk_parity")


@query("N13_max_sharpe_pairs", _two("ha"))
def _sharpe_pairs(spark, sf_dir):
    return _pair_books(spark, sf_dir, "sharpe")


# ---- volatility and tails


@query("N15_garch")
def _garch(spark, sf_dir):
    """GARCH(1, 1) of each symbol's monthly returns."""
    from ..operators.volatility import garch

    fit = garch(returns(spark, sf_dir).filter("r is not null"), ["symbol"], "date", "r", horizon=3)
    return fit.select("symbol", "n", "converged", *[F.round(c, 5).alias(c) for c in ("mu", "omega", "alpha", "beta", "current_vol", "llf")])


_TAIL = f"""{PANEL}, {_RET}, th AS (SELECT symbol, count(*) AS n, quantile_cont(r, 0.2) AS threshold FROM rets WHERE r IS NOT NULL GROUP BY symbol),
  ex AS (SELECT th.symbol, n, threshold, threshold - r AS y FROM rets JOIN th ON rets.symbol = th.symbol WHERE r < threshold)"""


@query("N16_tail_moments", f"WITH {_TAIL}, mm AS (SELECT symbol, n, threshold, count(*) AS n_exceedances, avg(y) AS m, nullif(var_samp(y), 0) AS v FROM ex GROUP BY ALL) SELECT symbol, n, round(threshold, 6) AS threshold, n_exceedances, round(n_exceedances / n, 6) AS rate, round(0.5 * (1 - m * m / v), 5) AS shape, round(0.5 * m * (1 + m * m / v), 5) AS scale FROM mm")
def _tail_moments(spark, sf_dir):
    from ..operators.extremes import exceedances, moments

    found = moments(exceedances(returns(spark, sf_dir), ["symbol"], "r", 20.0), ["symbol"])
    return found.select("symbol", "n", r6("threshold").alias("threshold"), "n_exceedances", r6("rate").alias("rate"), F.round("shape", 5).alias("shape"), F.round("scale", 5).alias("scale"))


@query("N17_pareto_tail")
def _pareto_tail(spark, sf_dir):
    from ..operators.extremes import pareto_tail

    found = pareto_tail(returns(spark, sf_dir), ["symbol"], "r", 20.0)
    return found.select("symbol", "n_exceedances", r6("threshold").alias("threshold"), F.round("shape", 4).alias("shape"), F.round("scale", 4).alias("scale"), "tail")


# ---- funds and curves


def deal_flows(spark, sf_dir) -> DataFrame:
    """Flows of funds, each flow of one of three deals."""
    return cashflows(spark, sf_dir).select("fund", (C("flow_id") % 3).alias("deal"), "date", "amount", "kind")


def _split_sql(source: str, keys: str, extra: str = "") -> str:
    """Tiers of paid, contributed, preferred in `source`, for a carry of 0.2 and a full catch-up."""
    return f"""SELECT {keys}{extra}, paid, contributed, preferred, least(paid, contributed) AS capital, least(paid - least(paid, contributed), preferred) AS hurdle,
      least(greatest(paid - contributed - preferred, 0), 0.25 * least(paid - least(paid, contributed), preferred)) AS catch_up FROM {source}"""


def _fund_sql(keys: str, name: str) -> str:
    on = " AND ".join(f"c.{k.strip()} = l.{k.strip()}" for k in keys.split(","))
    picked = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return f"""{name}l AS (SELECT {keys}, max(date) AS last FROM df GROUP BY {keys}),
    {name}s AS (SELECT {picked}, sum(CASE kind WHEN 'distribution' THEN amount ELSE 0 END) AS paid, sum(CASE kind WHEN 'contribution' THEN -amount ELSE 0 END) AS contributed,
      sum(CASE kind WHEN 'contribution' THEN -amount * (pow(1.08, date_diff('day', date, last) / 365.0) - 1) ELSE 0 END) AS preferred FROM df c JOIN {name}l l ON {on} WHERE kind <> 'valuation' GROUP BY {picked}),
    {name}t AS ({_split_sql(name + 's', keys)}), {name} AS (SELECT *, paid - capital - hurdle - catch_up AS carry, catch_up + 0.2 * (paid - capital - hurdle - catch_up) AS gp FROM {name}t)"""


_DEALS = f"{CASHFLOWS}, df AS (SELECT fund, flow_id % 3 AS deal, date, amount, kind FROM cashflows)"


@query("N18_waterfall_by_deal", f"WITH {_DEALS}, {_fund_sql('fund, deal', 'am')} SELECT fund, deal, round(paid, 2) AS paid, round(capital, 2) AS capital, round(hurdle, 2) AS preferred_paid, round(catch_up, 2) AS catch_up, round(carry, 2) AS carry, round(gp, 2) AS gp FROM am")
def _waterfall(spark, sf_dir):
    from ..operators.funds import waterfall

    w = waterfall(deal_flows(spark, sf_dir), ["fund", "deal"], 0.08, 0.2)
    return w.select("fund", "deal", *[F.round(c, 2).alias(c) for c in ("paid", "capital", "preferred_paid", "catch_up", "carry", "gp")])


@query("N19_clawback", f"WITH {_DEALS}, {_fund_sql('fund, deal', 'am')}, {_fund_sql('fund', 'eu')} SELECT eu.fund, round(received, 2) AS received, round(eu.gp, 2) AS entitled, round(greatest(received - eu.gp, 0), 2) AS clawback FROM eu JOIN (SELECT fund, sum(gp) AS received FROM am GROUP BY fund) r ON r.fund = eu.fund")
def _clawback(spark, sf_dir):
    from ..operators.funds import clawback

    return clawback(deal_flows(spark, sf_dir), "fund", "deal", 0.08, 0.2).select("fund", *[F.round(c, 2).alias(c) for c in ("received", "entitled", "clawback")])


@query(
    "N20_waterfall_by_date",
    f"""WITH {CASHFLOWS}, dd AS (SELECT fund, date, sum(CASE kind WHEN 'contribution' THEN -amount ELSE 0 END) AS i, sum(CASE kind WHEN 'distribution' THEN amount ELSE 0 END) AS o FROM cashflows WHERE kind <> 'valuation' GROUP BY ALL),
    ac AS (SELECT a.fund, a.date, sum(b.o) AS paid, sum(b.i) AS contributed, greatest(sum(b.i * (pow(1.08, date_diff('day', b.date, a.date) / 365.0) - 1)), 0) AS preferred FROM dd a JOIN dd b ON a.fund = b.fund AND b.date <= a.date GROUP BY a.fund, a.date),
    tt AS ({_split_sql('ac', 'fund', ', date')}) SELECT fund, date, round(paid, 2) AS paid, round(capital, 2) AS capital, round(hurdle, 2) AS preferred_paid, round(catch_up, 2) AS catch_up, round(paid - capital - hurdle - catch_up, 2) AS carry FROM tt""",
)
def _waterfall_dates(spark, sf_dir):
    from ..operators.funds import waterfall_by_date

    w = waterfall_by_date(cashflows(spark, sf_dir), ["fund"], 0.08, 0.2)
    return w.select("fund", "date", *[F.round(c, 2).alias(c) for c in ("paid", "capital", "preferred_paid", "catch_up", "carry")])


@query("N21_all_rates")
def _all_rates(spark, sf_dir):
    """Every rate at which a fund's contributions, distributions and valuations have no value."""
    from ..operators.funds import all_rates

    return all_rates(cashflows(spark, sf_dir), "fund").select("fund", F.round("rate", 6).alias("rate"))


_LADDER = [0.5, 1.0, 2.0, 4.0, 8.0, 16.0]


def curve_rows(spark, sf_dir) -> DataFrame:
    """A curve a month: mean discounts by quantity, in place of yields by maturity."""
    x = table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("date"), (C("l_quantity") / 2).alias("maturity"), "l_discount")
    return x.groupBy("date", "maturity").agg(F.avg("l_discount").alias("y"))


@query(
    "N22_curve_grid",
    f"""WITH cr AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_quantity / 2 AS m, avg(l_discount) AS y FROM lineitem GROUP BY ALL), cl AS (SELECT date, m, y, l, (1 - exp(-m / l)) / (m / l) AS s FROM cr, (SELECT unnest({_LADDER}) AS l)),
    cv AS (SELECT date, l, 1.0 AS v0, s AS v1, s - exp(-m / l) AS v2, y AS v3 FROM cl), cg AS (SELECT date, l, count(*) AS n, {sums_sql(3)} FROM cv GROUP BY date, l), {eliminated('c', 'cg', 'date, l, n', 3, 3)},
    bt AS (SELECT date, n, arg_min(l, s3_3) AS lambda1, min(s3_3) AS ssr FROM c_2 GROUP BY date, n) SELECT date, n, lambda1, round(ssr, 9) AS ssr FROM bt WHERE n >= 4""",
)
def _curve_grid(spark, sf_dir):
    from ..operators.curves import grid_fit

    return grid_fit(curve_rows(spark, sf_dir), ["date"], "maturity", "y", _LADDER).select("date", "n", "lambda1", F.round("ssr", 9).alias("ssr"))


@query("N23_curve_fit")
def _curve_fit(spark, sf_dir):
    from ..operators.curves import fit

    return rounded(fit(curve_rows(spark, sf_dir), ["date"], "maturity", "y").select("date", "n", "rmse", "lambda1"))
