"""Queries on the factor catalogue: many factors a pass, on weekly bars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..data import WEEKLY, weekly_panel
from ..operators import asof, zoo
from ..operators.expr import NUDGE, X, evaluate, to_sql
from .registry import query, r6

C = F.col


def factor_query(name: str, targets: dict[str, X], with_sql: bool = True) -> None:
    @query(name, f"WITH {WEEKLY}{to_sql('panel', targets)}" if with_sql else None)
    def run(spark, sf_dir):
        out = evaluate(weekly_panel(spark, sf_dir), targets)
        return out.select("symbol", "date", *[r6(C(n) + NUDGE).alias(n) for n in targets])


for _n in zoo.WINDOWS:
    factor_query(f"Z_qlib158_w{_n}", {f"{k}{_n}": x for k, x in zoo.qlib(_n).items()})
factor_query("Z_qlib158_candles", zoo.candles())
factor_query("Z_academic", zoo.academic())
_ALPHAS = zoo.alpha101()
for _i in range(1, 102, 10):
    factor_query(f"Z_alpha101_{_i:03d}", {f"a{k:03d}": _ALPHAS[k] for k in range(_i, min(_i + 10, 102)) if k != 84})
# its powers grow beyond what two engines round alike
factor_query("Z_alpha101_084", {"a084": _ALPHAS[84]}, with_sql=False)

_GTJA = zoo.gtja191()
#: Without a SQL twin: recursive averages, and powers and products that grow beyond what two engines round alike.
_APART = (*zoo.RECURRING, 17, 143)
_REST = [k for k in _GTJA if k not in _APART]
for _i in range(0, len(_REST), 20):
    factor_query(f"Z_gtja191_{_i // 20 + 1:02d}", {f"g{k:03d}": _GTJA[k] for k in _REST[_i : _i + 20]})
for _i in range(0, len(_APART), 18):
    factor_query(f"Z_gtja191_apart_{_i // 18 + 1}", {f"g{k:03d}": _GTJA[k] for k in _APART[_i : _i + 18]}, with_sql=False)

_FUND = """fq AS (SELECT o_custkey % 25 AS symbol, CAST(date_trunc('month', o_orderdate) AS DATE) AS filed, sum(o_totalprice) AS ni, count(*) AS n, max(o_totalprice) AS gp, avg(o_totalprice) AS roe FROM orders GROUP BY ALL),
fg AS (SELECT *, ni / lag(ni) OVER (PARTITION BY symbol ORDER BY filed) - 1 AS ag FROM fq),
fp AS (SELECT p.symbol, p.date, p.close, g.ag AS asset_growth, g.ni AS net_income, CAST(g.n AS DOUBLE) AS shares_diluted, g.gp / g.ni AS gross_profitability, g.roe FROM panel p ASOF LEFT JOIN fg g ON p.symbol = g.symbol AND p.date >= g.filed)"""


@query("Z_fundamental", f"WITH {WEEKLY}, {_FUND}{to_sql('fp', zoo.fundamental())}")
def _fundamental(spark, sf_dir):
    """Growth is taken between reports, on the sparse series, and only then brought to bars as of its date."""
    from pyspark.sql import Window

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    q = orders.groupBy((C("o_custkey") % 25).alias("symbol"), F.trunc("o_orderdate", "month").alias("filed")).agg(F.sum("o_totalprice").alias("ni"), F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("gp"), F.avg("o_totalprice").alias("roe"))
    growth = F.try_divide(C("ni"), F.lag("ni").over(Window.partitionBy("symbol").orderBy("filed"))) - 1
    q = q.select("symbol", "filed", growth.alias("asset_growth"), C("ni").alias("net_income"), C("n").cast("double").alias("shares_diluted"), F.try_divide("gp", "ni").alias("gross_profitability"), "roe")
    p = asof.asof_join(weekly_panel(spark, sf_dir).select("symbol", "date", "close"), q, ["symbol"], "date", "filed")
    out = evaluate(p, zoo.fundamental())
    return out.select("symbol", "date", *[r6(C(n) + NUDGE).alias(n) for n in zoo.fundamental()])


def _rewire_sql(event: int, calm: int) -> str:
    """Correlations of all pairs in both windows from running sums, deviations being from each symbol's own mean."""
    w = {"e": f"ROWS BETWEEN {event - 1} PRECEDING AND CURRENT ROW", "c": f"ROWS BETWEEN {event + calm - 1} PRECEDING AND {event} PRECEDING"}
    own = ", ".join(f"count(r) OVER (PARTITION BY symbol ORDER BY date {f}) AS n{k}, avg(r) OVER (PARTITION BY symbol ORDER BY date {f}) AS m{k}, var_pop(r) OVER (PARTITION BY symbol ORDER BY date {f}) AS v{k}" for k, f in w.items())
    over = lambda e, f: f"sum({e}) OVER (PARTITION BY a, b ORDER BY date {f})"
    both = "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN"
    pair = ", ".join(f"({over(f'{both} x * y END', f)} - my{k} * {over(f'{both} x END', f)} - mx{k} * {over(f'{both} y END', f)} + mx{k} * my{k} * {over(f'{both} 1 END', f)}) / sqrt(nx{k} * vx{k} * ny{k} * vy{k}) AS q{k}" for k, f in w.items())
    sides = ", ".join(f"{t}.{c}{k} AS {c}{s}{k}" for t, s in (("p", "x"), ("q", "y")) for k in "ec" for c in "nmv")
    good = " AND ".join(f"n{s}{k} >= {int(np.ceil(0.9 * n - 1e-9))} AND v{s}{k} > 0" for s in "xy" for k, n in (("e", event), ("c", calm)))
    return f"""rr AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM panel), ow AS (SELECT symbol, date, i, r, {own} FROM rr),
    pq AS (SELECT p.symbol AS a, q.symbol AS b, p.date, p.i, p.r AS x, q.r AS y, {sides} FROM ow p JOIN ow q ON p.date = q.date AND p.symbol <> q.symbol), cr AS (SELECT a, date, i, {good} AS good, {pair} FROM pq),
    sc AS (SELECT a AS symbol, date, avg(CASE WHEN good THEN abs(qe - qc) END) AS s, count(CASE WHEN good THEN 1 END) AS n FROM cr WHERE i >= {event + calm} GROUP BY a, date), sd AS (SELECT symbol, date, CASE WHEN n >= 2 THEN -s END AS s FROM sc)
    SELECT symbol, date, round(CASE WHEN stddev_samp(s) OVER (PARTITION BY date) > 0 THEN (s - avg(s) OVER (PARTITION BY date)) / stddev_samp(s) OVER (PARTITION BY date) END, 5) AS corr_rewire FROM sd"""


@query("Z_academic_rewire", f"WITH {WEEKLY}, {_rewire_sql(20, 120)}")
def _rewire(spark, sf_dir):
    """The last factor of the academic ones: stable correlations rank highest."""
    from ..operators import ts, xs
    from ..operators.rewire import rewiring

    r = weekly_panel(spark, sf_dir).select("symbol", "date", ts.pct_change(C("close")).alias("r"))
    s = rewiring(r).withColumn("s", -C("score"))
    return s.select("symbol", "date", F.round(xs.zscore(C("s")), 5).alias("corr_rewire"))
