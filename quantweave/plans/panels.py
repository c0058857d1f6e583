"""Queries on the dense monthly panel: time-series operators, cross-sectional operators, indicators, patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..data import PANEL, panel
from ..operators import indicators as ind
from ..operators import ts, xs
from ..operators.ewm import Ewm, ewm
from .registry import query, r6

C = F.col
#: A window of SQL over a symbol's last n rows, and over all so far.
S = "PARTITION BY symbol ORDER BY date"


def over(n: int) -> str:
    return f"OVER ({S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


SO_FAR = f"OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def guard(expression: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {expression} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({S})"


def agg(f: str, x: str, n: int) -> str:
    return guard(f"{f}({x}) {over(n)}", x, n)


def corr(x: str, y: str, n: int) -> str:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    w = over(n)
    return (
        f"CASE WHEN count({a}) {w} = {n} AND min({a}) {w} < max({a}) {w} AND min({b}) {w} < max({b}) {w} "
        f"THEN covar_samp({a}, {b}) {w} / (stddev_samp({a}) {w} * stddev_samp({b}) {w}) END"
    )


def argbest(x: str, n: int, best: str) -> str:
    values = f"list({x}) {over(n)}"
    return guard(f"CAST(list_position({values}, list_{best}({values})) - 1 AS DOUBLE)", x, n)


def panel_query(name: str, columns: dict[str, tuple[Column | Callable[[], Column], str]], before: Callable[[DataFrame], DataFrame] | None = None, before_sql: str = "", source: str = "panel") -> None:
    """One row per symbol and date with the columns, rounded. before and before_sql prepare the panel for both."""
    body = ", ".join(f"round({sql}, 6) AS {out}" for out, (_, sql) in columns.items())
    text = f"WITH {PANEL}{', ' + before_sql if before_sql else ''} SELECT symbol, date, {body} FROM {source}"

    @query(name, text)
    def run(spark, sf_dir):
        rows = panel(spark, sf_dir)
        rows = before(rows) if before else rows
        return rows.select("symbol", "date", *[r6(c() if callable(c) else c).alias(out) for out, (c, _) in columns.items()])


panel_query("E01_ts_mean", {"ts_mean": (lambda: ts.ts_mean(C("close"), 5), agg("avg", "close", 5))})
panel_query("E02_ts_std", {"ts_std": (lambda: ts.ts_std(C("close"), 10), agg("stddev_samp", "close", 10))})
panel_query("E03_ts_max", {"ts_max": (lambda: ts.ts_max(C("high"), 10), agg("max", "high", 10))})
panel_query("E04_ts_min", {"ts_min": (lambda: ts.ts_min(C("low"), 10), agg("min", "low", 10))})
_values = f"list(close) {over(10)}"
panel_query(
    "E05_ts_rank",
    {"ts_rank": (lambda: ts.ts_rank(C("close"), 10), guard("(len(list_filter(v, lambda a: a < close)) + 0.5 * (len(list_filter(v, lambda a: a = close)) + 1)) / 10", "close", 10))},
    before_sql=f"listed AS (SELECT *, {_values} AS v FROM panel)",
    source="listed",
)
panel_query("E06_ts_corr", {"ts_corr": (lambda: ts.ts_corr(C("close"), C("volume"), 10), corr("close", "volume", 10))})
_a, _b = "CASE WHEN volume IS NOT NULL THEN close END", "CASE WHEN close IS NOT NULL THEN volume END"
panel_query("E07_ts_cov", {"ts_cov": (lambda: ts.ts_cov(C("close"), C("volume"), 10), guard(f"covar_samp({_a}, {_b}) {over(10)}", _a, 10))})
panel_query("E08_ts_argmax", {"ts_argmax": (lambda: ts.ts_argmax(C("high"), 10), argbest("high", 10, "max"))})
panel_query("E09_ts_argmin", {"ts_argmin": (lambda: ts.ts_argmin(C("low"), 10), argbest("low", 10, "min"))})
panel_query("E10_delta", {"delta": (lambda: ts.delta(C("close"), 3), f"close - {lag('close', 3)}")})
panel_query("E11_decay_linear", {"decay": (lambda: ts.decay_linear(C("close"), 5), "(" + " + ".join(f"{lag('close', k) if k else 'close'} * {k + 1}" for k in range(5)) + ") / 15")})
panel_query("E12_signed_power", {"signed": (lambda: ts.signed_power(ts.delta(C("close"), 1), 0.5), f"sign(close - {lag('close')}) * pow(abs(close - {lag('close')}), 0.5)")})
panel_query("E13_safe_div", {"ratio": (lambda: ts.safe_div(C("amount"), ts.delta(C("volume"), 1)), "CASE WHEN dv <> 0 THEN amount / (dv + 1e-12 * sign(dv)) END")}, before_sql=f"moved AS (SELECT *, volume - {lag('volume')} AS dv FROM panel)", source="moved")
panel_query(
    "E14_vwap",
    {
        "vwap_cn": (lambda: ts.vwap("equity_cn", amount=C("amount"), volume=C("volume")), "amount * 1000 / (volume * 100 + 1 + 1e-12)"),
        "vwap_us": (lambda: ts.vwap("equity_us", open=C("open"), high=C("high"), low=C("low"), close=C("close")), "(open + high + low + close) / 4"),
    },
)


def ewm_sql(name: str, x: str, alpha: float, source: str = "panel", first: str = "panel") -> str:
    """A recursive table of an average without adjustment: nulls before the first value stay null, later ones carry on."""
    return f"""{name}_rows AS (SELECT symbol, date, CAST({x} AS DOUBLE) AS x, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM {source}),
{name}(symbol, date, k, value, weight) AS (SELECT symbol, date, k, x, CAST(1 AS DOUBLE) FROM {name}_rows WHERE k = 1
  UNION ALL SELECT r.symbol, r.date, r.k,
    CASE WHEN r.x IS NULL THEN p.value WHEN p.value IS NULL THEN r.x ELSE (p.value * p.weight * (1 - {alpha}) + r.x * {alpha}) / (p.weight * (1 - {alpha}) + {alpha}) END,
    CASE WHEN p.value IS NULL THEN CAST(1 AS DOUBLE) WHEN r.x IS NULL THEN p.weight * (1 - {alpha}) ELSE CAST(1 AS DOUBLE) END
  FROM {name} p JOIN {name}_rows r ON r.symbol = p.symbol AND r.k = p.k + 1)"""


@query("E15_sma", f"WITH RECURSIVE {PANEL}, {ewm_sql('e', 'close', 0.25)} SELECT symbol, date, round(value, 6) AS sma FROM e")
def _sma(spark, sf_dir):
    return ewm(panel(spark, sf_dir).select("symbol", "date", "close"), {"sma": Ewm("close", 2 / 8)}).select("symbol", "date", r6("sma").alias("sma"))


panel_query("E16_rolling_sum_delay", {"total": (lambda: ts.ts_sum(C("volume"), 5), agg("sum", "volume", 5)), "delayed": (lambda: ts.delay(C("close"), 4), lag("close", 4))})
panel_query("E17_ts_quantile", {"q80": (lambda: ts.ts_quantile(C("close"), 0.8, 10), guard(f"quantile_cont(close, 0.8) {over(10)}", "close", 10))})
panel_query("E18_r_squared", {"rsqr": (lambda: ts.r_squared(C("close"), 10), f"pow({corr('close', 'k', 10)}, 2)")}, before_sql=f"numbered AS (SELECT *, CAST(row_number() OVER ({S}) AS DOUBLE) AS k FROM panel)", source="numbered")
panel_query("E19_ts_skew", {"skew": (lambda: ts.ts_skew(C("close"), 12), agg("skewness", "close", 12))})
panel_query("E20_bar_returns", {"ret": (lambda: ts.bar_returns(C("close")), f"coalesce(close / CASE WHEN last_value(close IGNORE NULLS) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN last_value(close IGNORE NULLS) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END - 1, 0)")})
panel_query("E21_forward_returns", {"label": (lambda: ts.forward_returns(C("close")), f"lead(close) OVER ({S}) / close - 1")})
panel_query("E22_ffill_limit", {"filled": (lambda: ts.forward_fill(C("close"), 2), f"last_value(close IGNORE NULLS) OVER ({S} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")})


@query("E23_last_sma", f"WITH {PANEL}, s AS (SELECT symbol, date, {agg('avg', 'close', 20)} AS sma, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM panel) SELECT symbol, round(sma, 6) AS sma FROM s WHERE r = 1")
def _last_sma(spark, sf_dir):
    rows = panel(spark, sf_dir).select("symbol", "date", ts.ts_mean(C("close"), 20).alias("sma"))
    return rows.groupBy("symbol").agg(r6(F.max_by("sma", "date")).alias("sma"))


_FILLED = f"filled AS (SELECT symbol, date, high, low, close, volume FROM panel WHERE close IS NOT NULL)"


def _known(spark, sf_dir) -> DataFrame:
    """Bars that exist: indicators read a symbol's own bars."""
    return panel(spark, sf_dir).filter("close is not null")


@query("E24_ema", f"WITH RECURSIVE {PANEL}, {_FILLED}, {ewm_sql('e', 'close', 2 / 13, 'filled')} SELECT symbol, round(last(value ORDER BY k), 6) AS ema FROM e GROUP BY symbol")
def _ema(spark, sf_dir):
    rows = ewm(_known(spark, sf_dir).select("symbol", "date", "close"), {"ema": Ewm.span("close", 12)})
    return rows.groupBy("symbol").agg(r6(F.max_by("ema", "date")).alias("ema"))


_n, _a14 = 14, 1 / 14


@query(
    "E25_rsi",
    f"""WITH {PANEL}, {_FILLED}, moves AS (SELECT symbol, date, close - {lag('close')} AS d, row_number() OVER ({S}) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM filled),
    sums AS (SELECT symbol, sum(greatest(d, 0) * pow(1 - 1.0 / 14, n - k)) AS gain, sum(greatest(-d, 0) * pow(1 - 1.0 / 14, n - k)) AS loss, count(d) AS c FROM moves WHERE d IS NOT NULL GROUP BY symbol)
    SELECT symbol, CASE WHEN c >= 14 THEN round(CASE WHEN loss = 0 AND gain = 0 THEN 50 WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END, 6) END AS rsi FROM sums""",
)
def _rsi(spark, sf_dir):
    return ind.last_rsi(_known(spark, sf_dir), 14).select("symbol", r6("rsi").alias("rsi"))


@query(
    "E26_macd",
    f"""WITH RECURSIVE {PANEL}, {_FILLED}, {ewm_sql('f', 'close', 2 / 13, 'filled')}, {ewm_sql('s', 'close', 2 / 27, 'filled')},
    line AS (SELECT f.symbol, f.date, f.value - s.value AS m FROM f JOIN s ON f.symbol = s.symbol AND f.date = s.date), {ewm_sql('g', 'm', 0.2, 'line')},
    both_ AS (SELECT g.symbol, g.k, m, value FROM g JOIN line ON g.symbol = line.symbol AND g.date = line.date)
    SELECT symbol, round(last(m ORDER BY k), 6) AS macd, round(last(value ORDER BY k), 6) AS signal, round(last(m - value ORDER BY k), 6) AS histogram FROM both_ GROUP BY symbol""",
)
def _macd(spark, sf_dir):
    return ind.last_macd(_known(spark, sf_dir)).select("symbol", *[r6(c).alias(c) for c in ("macd", "signal", "histogram")])


panel_query(
    "E27_bollinger",
    {
        "upper": (lambda: ind.bollinger(C("close"), 20, 2.0)[0], f"{agg('avg', 'close', 20)} + 2 * {agg('stddev_samp', 'close', 20)}"),
        "middle": (lambda: ind.bollinger(C("close"), 20, 2.0)[1], agg("avg", "close", 20)),
        "lower": (lambda: ind.bollinger(C("close"), 20, 2.0)[2], f"{agg('avg', 'close', 20)} - 2 * {agg('stddev_samp', 'close', 20)}"),
    },
)


_ADX = f"""mv AS (SELECT symbol, date, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS minus
  FROM (SELECT *, {lag('close')} AS pc, high - {lag('high')} AS up, {lag('low')} - low AS down FROM filled)), {ewm_sql('ea', 'tr', _a14, 'mv')}, {ewm_sql('ep', 'plus', _a14, 'mv')}, {ewm_sql('em', 'minus', _a14, 'mv')},
  di AS (SELECT ea.symbol, ea.date, 100 * ep.value / nullif(ea.value, 0) AS plus_di, 100 * em.value / nullif(ea.value, 0) AS minus_di FROM ea JOIN ep USING (symbol, k) JOIN em USING (symbol, k)),
  dx AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM di), {ewm_sql('ex', 'dx', _a14, 'dx')}"""


@query("E28_adx", f"WITH RECURSIVE {PANEL}, {_FILLED}, {_ADX} SELECT di.symbol, di.date, round(value, 6) AS adx, round(plus_di, 6) AS plus_di, round(minus_di, 6) AS minus_di FROM di JOIN ex ON ex.symbol = di.symbol AND ex.date = di.date")
def _adx(spark, sf_dir):
    return ind.adx(_known(spark, sf_dir), 14).select("symbol", "date", *[r6(c).alias(c) for c in ("adx", "plus_di", "minus_di")])


panel_query("E29_obv", {"obv": (lambda: ind.obv(C("close"), C("volume")), f"sum(coalesce(volume * sign(d), 0)) {SO_FAR}")}, before_sql=f"d AS (SELECT *, close - {lag('close')} AS d FROM panel)", source="d", before=lambda p: p.withColumn("_d", ts.delta(C("close"), 1)))
panel_query(
    "E30_hv",
    {"hv": (lambda: ind.historical_vol(C("r"), 12, 12), f"{agg('stddev_samp', 'r', 12)} * sqrt(12)")},
    before=lambda p: p.withColumn("r", F.log(ts.pct_change(C("close")) + 1)), before_sql=f"r AS (SELECT *, ln(close / {lag('close')}) AS r FROM panel)", source="r",
)
panel_query(
    "E31_hv_percentile",
    {"percentile": (lambda: ts.ts_rank(C("hv"), 10) * 100, guard("(len(list_filter(v, lambda a: a < hv)) + 0.5 * (len(list_filter(v, lambda a: a = hv)) + 1)) * 10", "hv", 10))},
    before=lambda p: p.withColumn("r", F.log(ts.pct_change(C("close")) + 1)).withColumn("hv", F.round(ts.ts_std(C("r"), 6), 9)),
    before_sql=f"r AS (SELECT *, ln(close / {lag('close')}) AS r FROM panel), hv AS (SELECT *, round({agg('stddev_samp', 'r', 6)}, 9) AS hv FROM r), listed AS (SELECT *, list(hv) {over(10)} AS v FROM hv)", source="listed",
)
_TP = "(high + low + close) / 3"
panel_query("E32_cumulative_vwap", {"vwap": (lambda: ind.cumulative_vwap(C("high"), C("low"), C("close"), C("volume")), f"sum({_TP} * volume) {SO_FAR} / nullif(sum(CASE WHEN close IS NOT NULL THEN volume END) {SO_FAR}, 0)")})
panel_query("E33_twap", {"twap": (lambda: F.avg((C("high") + C("low") + C("close")) / 3).over(ts.so_far()), f"avg({_TP}) {SO_FAR}")})
panel_query(
    "E34_donchian",
    {
        "mid": (lambda: ind.donchian_mid(C("high"), C("low"), 9), f"({agg('max', 'high', 9)} + {agg('min', 'low', 9)}) / 2"),
        "displaced": (lambda: ts.delay(C("m26"), 6), lag("m26", 6)),
    },
    before=lambda p: p.withColumn("m26", ind.donchian_mid(C("high"), C("low"), 26)), before_sql=f"m AS (SELECT *, ({agg('max', 'high', 26)} + {agg('min', 'low', 26)}) / 2 AS m26 FROM panel)", source="m",
)
_AROUND = f"OVER ({S} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
_EXTREMA = f"""extrema AS (SELECT symbol, date, close, row_number() OVER ({S}) AS k, coalesce(count(*) {_AROUND} = 7 AND close = max(close) {_AROUND}, false) AS peak,
  coalesce(count(*) {_AROUND} = 7 AND close = min(close) {_AROUND}, false) AS valley FROM panel)"""


@query("E35_peaks_valleys", f"WITH {PANEL}, {_EXTREMA} SELECT symbol, date, peak, valley FROM extrema WHERE peak OR valley")
def _peaks(spark, sf_dir):
    return panel(spark, sf_dir).select("symbol", "date", ts.peaks(C("close"), 3).alias("peak"), ts.valleys(C("close"), 3).alias("valley")).filter("peak or valley")


@query(
    "E36_candlestick_patterns",
    f"""WITH {PANEL}, f AS (SELECT *, abs(close - open) AS body, high - greatest(open, close) AS up, least(open, close) - low AS down, {lag('close')} AS pc, {lag('open')} AS po, abs({lag('close')} - {lag('open')}) AS pb FROM panel)
    SELECT symbol, date, CASE WHEN coalesce(pc > po AND close < open AND open >= pc AND close <= po AND body > pb, false) THEN -1
      WHEN coalesce(pc < po AND close > open AND open <= pc AND close >= po AND body > pb, false) THEN 1
      WHEN coalesce(down > 2 * body AND up < body, false) AND NOT coalesce(body / nullif(high - low, 0) < 0.1, false) THEN 1 ELSE 0 END AS pattern FROM f""",
)
def _candles(spark, sf_dir):
    return panel(spark, sf_dir).select("symbol", "date", ind.candle_code(C("open"), C("high"), C("low"), C("close")).alias("pattern"))


@query(
    "E37_support_resistance",
    f"""WITH RECURSIVE {PANEL}, {_EXTREMA}, tp AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY close) AS i, 0.05 * (max(close) OVER (PARTITION BY symbol) - min(close) OVER (PARTITION BY symbol)) AS reach FROM extrema WHERE peak OR valley),
    st AS (SELECT symbol, i, 1 AS g, close AS s, 1 AS n FROM tp WHERE i = 1 UNION ALL SELECT tp.symbol, tp.i, CASE WHEN close - s / n <= reach THEN g ELSE g + 1 END, CASE WHEN close - s / n <= reach THEN s + close ELSE close END, CASE WHEN close - s / n <= reach THEN n + 1 ELSE 1 END FROM st JOIN tp ON tp.symbol = st.symbol AND tp.i = st.i + 1),
    gr AS (SELECT symbol, g, max(n) AS touches, arg_max(s / n, i) AS level FROM st GROUP BY symbol, g), rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY touches DESC, level) AS rank FROM gr)
    SELECT symbol, CAST(rank AS INTEGER) AS rank, round(level, 6) AS level, CAST(touches AS INTEGER) AS touches FROM rk WHERE rank <= 3""",
)
def _levels(spark, sf_dir):
    return ind.support_resistance(panel(spark, sf_dir), 3, 3).select("symbol", "rank", r6("level").alias("level"), "touches")


panel_query("E38_trend_slope", {"slope": (lambda: ts.slope(C("close"), 12), guard(f"regr_slope(close, k) {over(12)}", "close", 12))}, before_sql=f"numbered AS (SELECT *, CAST(row_number() OVER ({S}) AS DOUBLE) AS k FROM panel)", source="numbered")


@query(
    "E39_head_and_shoulders",
    f"""WITH {PANEL}, {_EXTREMA}, p AS (SELECT symbol, date, close AS h, lag(close) OVER ({S}) AS l, lead(close) OVER ({S}) AS r FROM extrema WHERE peak)
    SELECT symbol, date FROM p WHERE h > l AND h > r AND abs(l - r) / ((l + r) / 2) <= 0.05""",
)
def _shoulders(spark, sf_dir):
    return ind.head_and_shoulders(panel(spark, sf_dir), 3)


@query(
    "E40_double_top_bottom",
    f"""WITH {PANEL}, {_EXTREMA}, t AS (SELECT symbol, date, close AS b, lag(close) OVER ({S}) AS a FROM extrema WHERE peak), v AS (SELECT symbol, date, close AS b, lag(close) OVER ({S}) AS a FROM extrema WHERE valley),
    tops AS (SELECT symbol, date FROM t WHERE abs(a - b) / abs((a + b) / 2) < 0.03), bottoms AS (SELECT symbol, date FROM v WHERE abs(a - b) / abs((a + b) / 2) < 0.03)
    SELECT symbol, date, 1 AS code FROM tops UNION ALL SELECT symbol, date, -1 FROM bottoms ANTI JOIN tops USING (symbol, date)""",
)
def _double(spark, sf_dir):
    return ind.double_top_bottom(panel(spark, sf_dir), 3)


def _shapes_sql(n: int) -> str:
    w = max(2, n // 5)
    around, inside, before = f"OVER ({S} ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING)", f"OVER ({S} ROWS BETWEEN {n - w} PRECEDING AND {w} PRECEDING)", f"OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    of = lambda k, end: f"count({k}) {inside} AS {k}_n, regr_slope({k}, {k}k) {inside} AS {k}_slope, {end}({k}) {inside} AS {k}_end, sum(CASE WHEN {k} IS NOT NULL THEN {k}bad END) {inside} - first_value(CASE WHEN {k} IS NOT NULL THEN {k}bad END IGNORE NULLS) {inside} AS {k}_bad"
    return f"""tn AS (SELECT symbol, date, CASE WHEN close = max(close) {around} THEN close END AS p, CASE WHEN close = min(close) {around} THEN close END AS v, row_number() OVER ({S}) - 1 AS i FROM panel),
    nb AS (SELECT *, count(p) OVER ({S}) AS pk, count(v) OVER ({S}) AS vk, CAST(coalesce(p <= last_value(p IGNORE NULLS) {before}, false) AS INT) AS pbad, CAST(coalesce(v >= last_value(v IGNORE NULLS) {before}, false) AS INT) AS vbad FROM tn),
    sn AS (SELECT symbol, date, i, {of("p", "max")}, {of("v", "min")} FROM nb), sh AS (SELECT *, 0.02 * (p_end - v_end) AS flat FROM sn WHERE i >= {n} AND p_n >= 2 AND v_n >= 2)"""


@query("E41_triangle", f"WITH {PANEL}, {_shapes_sql(20)}, tr AS (SELECT symbol, date, CASE WHEN v_slope > flat AND abs(p_slope) < flat THEN 1 WHEN p_slope < -flat AND abs(v_slope) < flat THEN -1 ELSE 0 END AS triangle FROM sh WHERE flat <> 0) SELECT * FROM tr WHERE triangle <> 0")
def _triangle(spark, sf_dir):
    return ind.shapes(panel(spark, sf_dir), 20).select("symbol", "date", "triangle").filter("triangle <> 0")


@query("E42_broadening", f"WITH {PANEL}, {_shapes_sql(20)} SELECT symbol, date, 1 AS broadening FROM sh WHERE p_bad = 0 AND v_bad = 0")
def _broadening(spark, sf_dir):
    return ind.shapes(panel(spark, sf_dir), 20).select("symbol", "date", "broadening").filter("broadening <> 0")


panel_query("E54_delayed_execution", {"signal": (lambda: ts.delay(C("s"), 2), lag("s", 2))}, before=lambda p: p.withColumn("s", F.signum(ts.delta(C("close"), 1))), before_sql=f"s AS (SELECT *, sign(close - {lag('close')}) AS s FROM panel)", source="s")

# cross sections

D = "PARTITION BY date"
_RANK = lambda x: f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({D} ORDER BY {x} NULLS LAST) + (count(*) OVER ({D}, {x}) - 1) / 2.0) / count({x}) OVER ({D}) END"
_Z = lambda x: f"CASE WHEN min({x}) OVER ({D}) < max({x}) OVER ({D}) THEN ({x} - avg({x}) OVER ({D})) / stddev_samp({x}) OVER ({D}) END"
panel_query("F01_rank", {"rank": (lambda: xs.rank(C("volume")), _RANK("volume"))})
panel_query("F02_zscore", {"zscore": (lambda: xs.zscore(C("close")), _Z("close"))})
panel_query("F03_scale", {"scaled": (lambda: xs.scale(C("d")), "d / nullif(sum(abs(d)) OVER (PARTITION BY date), 0)")}, before=lambda p: p.withColumn("d", ts.delta(C("close"), 1)), before_sql=f"d AS (SELECT *, close - {lag('close')} AS d FROM panel)", source="d")
panel_query("F04_neutralize", {"within_sector": (lambda: xs.neutralize(C("close"), C("sector")), "close - avg(close) OVER (PARTITION BY date, sector)"), "within_market": (lambda: xs.neutralize(C("close")), f"close - avg(close) OVER ({D})")})
panel_query(
    "F05_market_beta",
    {"beta": (lambda: F.try_divide(ts.ts_cov(C("r"), C("m"), 12), F.when(ts.ts_std(C("m"), 12) > 0, F.pow(ts.ts_std(C("m"), 12), F.lit(2.0)))), f"{guard(f'covar_samp(r, CASE WHEN r IS NOT NULL THEN m END) {over(12)}', 'r', 12)} / nullif(pow({agg('stddev_samp', 'm', 12)}, 2), 0)")},
    before=lambda p: p.withColumn("r", ts.pct_change(C("close"))).withColumn("m", F.avg("r").over(xs.section())),
    before_sql=f"r AS (SELECT *, close / {lag('close')} - 1 AS r FROM panel), m AS (SELECT *, avg(r) OVER ({D}) AS m FROM r)", source="m",
)

_FACTOR = f"factor AS (SELECT symbol, date, close / {lag('close', 3)} - 1 AS f, lead(close) OVER ({S}) / close - 1 AS y FROM panel)"
_PAIRS = f"{_FACTOR}, pairs AS (SELECT *, count(*) OVER ({D}) AS n FROM factor WHERE f IS NOT NULL AND y IS NOT NULL)"
_IC = f"""{_PAIRS}, ranked AS (SELECT date, n, rank() OVER ({D} ORDER BY f) + (count(*) OVER ({D}, f) - 1) / 2.0 AS rf, rank() OVER ({D} ORDER BY y) + (count(*) OVER ({D}, y) - 1) / 2.0 AS ry FROM pairs),
ic AS (SELECT date, corr(rf, ry) AS ic FROM ranked WHERE n >= 5 GROUP BY date HAVING min(rf) < max(rf) AND min(ry) < max(ry))"""


def factor_rows(rows: DataFrame) -> DataFrame:
    """symbol, date, f (three-bar momentum), y (the next bar's return)."""
    return rows.select("symbol", "date", ts.pct_change(C("close"), 3).alias("f"), ts.forward_returns(C("close")).alias("y"))


@query("F07_ic_series", f"WITH {PANEL}, {_IC} SELECT date, round(ic, 6) AS ic FROM ic")
def _ic(spark, sf_dir):
    from ..operators import bench

    return bench.ic_series(factor_rows(panel(spark, sf_dir)), []).select("date", r6("ic").alias("ic"))


@query("C15_ic_pairs", f"WITH {PANEL}, {_PAIRS} SELECT symbol, date, round(f, 6) AS f, round(y, 6) AS y FROM pairs")
def _pairs(spark, sf_dir):
    rows = panel(spark, sf_dir)
    factor = rows.select("symbol", "date", ts.pct_change(C("close"), 3).alias("f")).filter("f is not null")
    label = rows.select("symbol", "date", ts.forward_returns(C("close")).alias("y")).filter("y is not null")
    return factor.join(label, ["symbol", "date"]).select("symbol", "date", r6("f").alias("f"), r6("y").alias("y"))


@query(
    "F08_group_equity",
    f"""WITH {PANEL}, {_PAIRS}, placed AS (SELECT date, y, greatest(CAST(ceil((row_number() OVER ({D} ORDER BY f, symbol) - 1) * 5.0 / (n - 1)) AS INTEGER), 1) AS g FROM pairs WHERE n >= 5),
    days AS (SELECT DISTINCT date FROM placed), means AS (SELECT d.date, k.g, coalesce(avg(y), 0) AS r FROM days d CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS g) k LEFT JOIN placed p ON p.date = d.date AND p.g = k.g GROUP BY ALL)
    SELECT date, g, round(exp(sum(ln(1 + r)) OVER (PARTITION BY g ORDER BY date)), 6) AS nav FROM means""",
)
def _groups(spark, sf_dir):
    from ..operators import bench

    return bench.group_equity(factor_rows(panel(spark, sf_dir)), 5).select("date", "g", r6("nav").alias("nav"))


@query(
    "G03_run_bench",
    f"WITH {PANEL}, {_IC} SELECT round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS ir, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END), 6) AS positive, count(*) AS n FROM ic",
)
def _bench(spark, sf_dir):
    from ..operators import bench

    return bench.summary(bench.ic_series(factor_rows(panel(spark, sf_dir)), []), []).select(*[r6(c).alias(c) for c in ("ic_mean", "ic_std", "ir", "positive")], "n")
