"""Queries on journals, holdings, screens, audits, regimes, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..data import BARS, CASHFLOWS, FILINGS, PANEL, TICKS, bars, cashflows, filings, panel, ticks, trades, trades_sql
from ..functions import scalar
from ..operators import bench, chains, holdings, pairs, ts
from ..operators import trades as habits
from ..operators.journal import pair_fifo
from .panels import _IC, factor_rows
from .portfolio import _EQ, _SECTOR, equity, rounded, scored_events, sector_returns
from .registry import query, r6, table

C = F.col
S = "PARTITION BY symbol ORDER BY date"

# ---- journal

_FIFO = trades_sql() + """, run AS (SELECT *, sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) OVER w AS B, sum(CASE WHEN side = 'sell' THEN quantity ELSE 0 END) OVER w AS S FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
un AS (SELECT *, S - greatest(max(S - B) OVER (PARTITION BY symbol ORDER BY seq), 0) AS M FROM run), m AS (SELECT *, coalesce(lag(M) OVER (PARTITION BY symbol ORDER BY seq), 0) AS M0 FROM un),
pt AS (SELECT symbol, seq, B - quantity AS pos, {'seq': seq, 'ts': ts, 'price': price, 'fee': fee / quantity, 'hi': B} AS lot, NULL AS sale FROM m WHERE side = 'buy' AND quantity > 0
  UNION ALL SELECT symbol, seq, M0, NULL, {'seq': seq, 'ts': ts, 'price': price, 'fee': fee / quantity, 'hi': M} FROM m WHERE side = 'sell' AND M > M0),
on_ AS (SELECT symbol, pos, last_value(lot IGNORE NULLS) OVER w AS b, last_value(sale IGNORE NULLS) OVER w AS s, lead(pos) OVER (PARTITION BY symbol ORDER BY pos, seq) AS nx FROM pt
  WINDOW w AS (PARTITION BY symbol ORDER BY pos, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
trips AS (SELECT symbol, b.seq AS buy_seq, s.seq AS sell_seq, least(nx, b.hi, s.hi) - pos AS quantity, b.ts AS buy_ts, s.ts AS sell_ts,
  (least(nx, b.hi, s.hi) - pos) * (s.price - b.price - b.fee - s.fee) AS pnl FROM on_ WHERE b IS NOT NULL AND s IS NOT NULL AND least(nx, b.hi, s.hi) - pos > 1e-9)"""


def trips(spark, sf_dir) -> DataFrame:
    return pair_fifo(trades(spark, sf_dir))


@query("E55_pair_fifo", f"WITH {_FIFO} SELECT symbol, buy_seq, sell_seq, round(quantity, 6) AS quantity, round(pnl, 4) AS pnl FROM trips")
def _fifo(spark, sf_dir):
    return trips(spark, sf_dir).select("symbol", C("buy_seq").cast("long").alias("buy_seq"), C("sell_seq").cast("long").alias("sell_seq"), r6("quantity").alias("quantity"), F.round("pnl", 4).alias("pnl"))


@query("D17_profile", f"WITH {trades_sql()} SELECT year(ts) AS year, side, count(*) AS n, count(DISTINCT symbol) AS symbols, round(sum(amount), 2) AS amount, round(avg(quantity), 6) AS avg_quantity FROM trades GROUP BY ALL")
def _profile(spark, sf_dir):
    return trades(spark, sf_dir).groupBy(F.year("ts").alias("year"), "side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols"), F.round(F.sum("amount"), 2).alias("amount"), r6(F.avg("quantity")).alias("avg_quantity"))


@query("D18_disposition", f"WITH {_FIFO}, d AS (SELECT avg(CASE WHEN pnl < 0 THEN date_diff('day', buy_ts, sell_ts) END) AS l, avg(CASE WHEN pnl > 0 THEN date_diff('day', buy_ts, sell_ts) END) AS w FROM trips) SELECT round(l / w, 6) AS ratio, CASE WHEN l / w > 1.5 THEN 'high' WHEN l / w > 1.2 THEN 'medium' ELSE 'low' END AS severity FROM d")
def _disposition(spark, sf_dir):
    return rounded(habits.disposition(trips(spark, sf_dir).withColumn("k", F.lit(0)), ["k"]).drop("k"))


@query("D19_overtrading", f"WITH {_FIFO}, p AS (SELECT CAST(sell_ts AS DATE) AS day, sum(pnl) AS pnl FROM trips GROUP BY 1), d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM trades GROUP BY 1), c AS (SELECT quantile_cont(n, 0.75) AS hi, quantile_cont(n, 0.25) AS lo FROM d) SELECT round(avg(CASE WHEN n >= hi THEN coalesce(pnl, 0) END), 4) AS busy, round(avg(CASE WHEN n <= lo THEN coalesce(pnl, 0) END), 4) AS quiet FROM d LEFT JOIN p USING (day), c")
def _overtrading(spark, sf_dir):
    p = trips(spark, sf_dir).groupBy(F.to_date("sell_ts").alias("day")).agg(F.sum("pnl").alias("pnl"))
    out = habits.overtrading(trades(spark, sf_dir), p)
    return out.select(F.round("busy", 4).alias("busy"), F.round("quiet", 4).alias("quiet"))


@query("D20_chasing_momentum", f"WITH {trades_sql()}, b AS (SELECT price, lag(price, 3) OVER (PARTITION BY symbol ORDER BY seq) AS p FROM trades WHERE side = 'buy') SELECT count(*) AS n, round(avg(CASE WHEN price / p - 1 > 0.03 THEN 1.0 ELSE 0 END), 6) AS share FROM b WHERE p > 0")
def _chasing(spark, sf_dir):
    return rounded(habits.chasing(trades(spark, sf_dir)))


@query("D21_anchoring", f"WITH {trades_sql()} SELECT symbol, count(*) AS n, round(stddev_samp(price) / avg(price), 6) AS cv FROM trades GROUP BY symbol HAVING count(*) >= 5 AND stddev_samp(price) / avg(price) < 0.5")
def _anchoring(spark, sf_dir):
    return rounded(habits.anchoring(trades(spark, sf_dir), cv=0.5))


# ---- audits

_DIGITS = "d AS (SELECT CAST(floor(v / pow(10, floor(log10(v)))) AS INTEGER) AS digit, count(*) AS n FROM (SELECT o_totalprice AS v FROM orders WHERE o_totalprice > 0) GROUP BY 1)"


@query("D22_benford", f"WITH {_DIGITS}, s AS (SELECT digit, n, n / sum(n) OVER () AS share, log10(1 + 1.0 / digit) AS e FROM d), a AS (SELECT sum(abs(share - e)) / 9 AS mad, sum(n) * sum(pow(share - e, 2) / e) AS chi2 FROM s) SELECT round(mad, 6) AS mad, round(chi2, 4) AS chi2, CASE WHEN mad < 0.006 THEN 'close' WHEN mad < 0.012 THEN 'acceptable' WHEN mad < 0.015 THEN 'marginal' ELSE 'nonconforming' END AS verdict FROM a")
def _benford(spark, sf_dir):
    return habits.benford_verdict(habits.benford(table(spark, sf_dir, "orders"), "o_totalprice")).select(r6("mad").alias("mad"), F.round("chi2", 4).alias("chi2"), "verdict")


@query("D23_cross_validate", "WITH v AS (SELECT l_partkey AS field, l_suppkey AS source, avg(l_extendedprice / l_quantity) AS value FROM lineitem GROUP BY ALL), m AS (SELECT field, quantile_cont(value, 0.5) AS median FROM v GROUP BY field) SELECT field, source, round(100 * (value - median) / abs(median), 4) AS deviation, abs(100 * (value - median) / abs(median)) <= 5 AS consistent FROM v JOIN m USING (field)")
def _cross(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy(C("l_partkey").alias("field"), C("l_suppkey").alias("source")).agg(F.avg(C("l_extendedprice") / C("l_quantity")).alias("value"))
    return habits.cross_validate(v, ["field"], 5.0).select("field", "source", F.round("deviation", 4).alias("deviation"), "consistent")


@query("D24_verify_market_cap", "WITH p AS (SELECT l_partkey AS k, sum(l_quantity) AS shares, sum(l_extendedprice) AS cap FROM lineitem GROUP BY ALL), j AS (SELECT k, abs(shares * p_retailprice - cap) / cap * 100 AS dev FROM p JOIN part ON k = p_partkey) SELECT k, round(dev, 4) AS dev, CASE WHEN dev <= 5 THEN 'pass' WHEN dev <= 15 THEN 'warn' ELSE 'fail' END AS status FROM j")
def _cap(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(C("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("shares"), F.sum("l_extendedprice").alias("cap"))
    dev = F.abs(C("shares") * C("p_retailprice") - C("cap")) / C("cap") * 100
    out = p.join(table(spark, sf_dir, "part"), C("k") == C("p_partkey")).select("k", dev.alias("dev"))
    return out.select("k", F.round("dev", 4).alias("dev"), F.when(C("dev") <= 5, "pass").when(C("dev") <= 15, "warn").otherwise("fail").alias("status"))


@query("I12_figures", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[-+]?[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?%?')) AS BIGINT) AS n FROM documents")
def _figures(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(scalar.figures(C("text"))).cast("long").alias("n"))


@query("I13_render_verdict", "WITH r AS (SELECT o_custkey AS k, sum(o_totalprice) AS reported FROM orders GROUP BY ALL), f AS (SELECT c_custkey AS k, c_acctbal * 100 AS fetched FROM customer), j AS (SELECT CASE WHEN fetched IS NULL OR fetched = 0 THEN 'missing' WHEN abs(reported - fetched) / abs(fetched) <= 0.5 THEN 'match' ELSE 'mismatch' END AS verdict FROM r LEFT JOIN f USING (k)) SELECT verdict, count(*) AS n FROM j GROUP BY ALL")
def _verdict(spark, sf_dir):
    r = table(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("reported"))
    f = table(spark, sf_dir, "customer").select(C("c_custkey").alias("k"), (C("c_acctbal") * 100).alias("fetched"))
    gap = F.try_divide(F.abs(C("reported") - C("fetched")), F.abs("fetched"))
    return r.join(f, "k", "left").groupBy(F.when(gap.isNull(), "missing").when(gap <= 0.5, "match").otherwise("mismatch").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


# ---- holdings

_ROWS = "SELECT l_suppkey AS filer, l_partkey % 50 AS cusip, l_returnflag AS put_call, sum(l_extendedprice) AS value, sum(l_quantity) AS shares FROM lineitem GROUP BY ALL"


@query("D25_aggregate_positions", f"WITH p AS ({_ROWS}) SELECT filer, cusip, put_call, round(value * 1000, 2) AS value, shares, round(100 * value / sum(value) OVER (PARTITION BY filer), 6) AS pct FROM p")
def _agg(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(C("l_suppkey").alias("filer"), (C("l_partkey") % 50).alias("cusip"), C("l_returnflag").alias("put_call"), C("l_extendedprice").alias("value"), C("l_quantity").alias("shares"))
    return holdings.aggregate_positions(rows, ["filer", "cusip", "put_call"], 1000.0).select("filer", "cusip", "put_call", F.round("value", 2).alias("value"), "shares", r6("pct").alias("pct"))


_BOOK = lambda c: f"SELECT l_partkey AS cusip, l_returnflag AS put_call, sum(l_quantity) AS shares, sum(l_extendedprice) AS value FROM lineitem WHERE {c} GROUP BY ALL"


@query("D26_merge_positions", f"WITH a AS ({_BOOK('l_suppkey % 2 = 0')}), b AS ({_BOOK('l_suppkey % 2 = 1')}), u AS (SELECT *, 1 AS s FROM a UNION ALL SELECT *, 2 FROM b) SELECT cusip, put_call, sum(shares) AS shares, round(sum(value), 2) AS value, count(DISTINCT s) AS sources FROM u GROUP BY ALL")
def _merge(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    book = lambda c: t.filter(c).groupBy(C("l_partkey").alias("cusip"), C("l_returnflag").alias("put_call")).agg(F.sum("l_quantity").alias("shares"), F.sum("l_extendedprice").alias("value"))
    return holdings.merge_positions(book("l_suppkey % 2 = 0"), book("l_suppkey % 2 = 1")).withColumn("value", F.round("value", 2))


@query("D27_combine_holdings", "SELECT s_nationkey AS region, l_partkey AS canonical, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS brokers, count(DISTINCT l_suppkey) > 1 AS duplicate FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def _combine(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), C("s_suppkey") == C("l_suppkey"))
    out = rows.groupBy(C("s_nationkey").alias("region"), C("l_partkey").alias("canonical")).agg(F.sum(C("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.sort_array(F.collect_set(C("l_suppkey").cast("string"))).alias("b"))
    return out.select("region", "canonical", "quantity", F.array_join("b", ",").alias("brokers"), (F.size("b") > 1).alias("duplicate"))


@query("D28_value_position", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(CAST(l_quantity AS DECIMAL(18, 4)) * CAST(p_retailprice AS DECIMAL(18, 4)), 4) AS DOUBLE) AS usd, round((l_quantity * p_retailprice - l_extendedprice) * 7.2, 2) AS pnl_cny FROM lineitem JOIN part ON l_partkey = p_partkey")
def _value(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), C("l_partkey") == C("p_partkey"))
    usd = F.round(C("l_quantity").cast("decimal(18,4)") * C("p_retailprice").cast("decimal(18,4)"), 4).cast("double")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", usd.alias("usd"), F.round((C("l_quantity") * C("p_retailprice") - C("l_extendedprice")) * 7.2, 2).alias("pnl_cny"))


@query("B05_normalize_position", "SELECT 'a' AS broker, 'A' || l_partkey AS symbol, l_quantity AS quantity, NULL AS fee FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT 'b', CAST(l_partkey AS VARCHAR), l_quantity * 100, round(l_tax, 6) FROM lineitem WHERE l_linestatus = 'F'")
def _position(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    a = t.filter("l_linestatus = 'O'").select(F.lit("a").alias("broker"), F.concat(F.lit("A"), C("l_partkey").cast("string")).alias("symbol"), C("l_quantity").alias("quantity"))
    b = t.filter("l_linestatus = 'F'").select(F.lit("b").alias("broker"), C("l_partkey").cast("string").alias("symbol"), (C("l_quantity") * 100).alias("quantity"), r6("l_tax").alias("fee"))
    return a.unionByName(b, allowMissingColumns=True)


_CHAIN = "c AS (SELECT l_suppkey AS filer, l_orderkey % 40 AS seq, CASE l_orderkey % 40 % 4 WHEN 0 THEN 'original' WHEN 1 THEN 'restatement' WHEN 2 THEN 'new holdings' ELSE '' END AS type, l_partkey % 30 AS cusip, l_quantity AS shares FROM lineitem)"


@query("H04_walk_chain", f"WITH {_CHAIN}, s AS (SELECT filer, max(seq) AS start FROM c WHERE type IN ('original', 'restatement') GROUP BY filer) SELECT filer, cusip, sum(shares) AS shares FROM c LEFT JOIN s USING (filer) WHERE seq = start OR (type = 'new holdings' AND seq > coalesce(start, -1)) GROUP BY ALL")
def _chain(spark, sf_dir):
    k = C("l_orderkey") % 40
    kind = F.when(k % 4 == 0, "original").when(k % 4 == 1, "restatement").when(k % 4 == 2, "new holdings").otherwise("")
    return holdings.walk_chain(table(spark, sf_dir, "lineitem").select(C("l_suppkey").alias("filer"), k.alias("seq"), kind.alias("type"), (C("l_partkey") % 30).alias("cusip"), C("l_quantity").alias("shares")))


# ---- screens and metadata


@query("G01_screen_market", "WITH a AS (SELECT p_brand AS market, l_partkey AS symbol, sum(l_extendedprice) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY amount DESC, symbol) AS rank FROM a) SELECT market, rank, symbol, round(amount, 2) AS amount FROM k WHERE rank <= 10")
def _screen(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(C("l_partkey").alias("symbol")).agg(F.sum("l_extendedprice").alias("amount"))
    a = a.join(table(spark, sf_dir, "part").select(C("p_partkey").alias("symbol"), C("p_brand").alias("market")), "symbol")
    k = F.row_number().over(Window.partitionBy("market").orderBy(F.desc("amount"), "symbol"))
    return a.withColumn("rank", k).filter("rank <= 10").select("market", C("rank").cast("long").alias("rank"), "symbol", F.round("amount", 2).alias("amount"))


@query("G06_cap_rows", "WITH k AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, total, total > 100 AS truncated FROM k WHERE k <= 100")
def _cap_rows(spark, sf_dir):
    w = Window.partitionBy("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))).withColumn("total", F.count(F.lit(1)).over(w))
    return rows.filter("k <= 100").select("l_suppkey", "l_orderkey", "l_linenumber", "total", (C("total") > 100).alias("truncated"))


@query("G07_scan_signals", f"WITH {PANEL}, f AS (SELECT symbol, date, sector, close / lag(close, 3) OVER ({S}) - 1 AS m, volume, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM panel), l AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY round(m, 9) DESC, symbol) AS rank FROM f WHERE k = 1 AND m > -0.5 AND volume > 10) SELECT sector, rank, symbol, round(m, 6) AS m FROM l WHERE rank <= 2")
def _scan(spark, sf_dir):
    f = panel(spark, sf_dir).select("symbol", "date", "sector", "volume", ts.pct_change(C("close"), 3).alias("m"))
    last = f.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).filter("k = 1 and m > -0.5 and volume > 10")
    rank = F.row_number().over(Window.partitionBy("sector").orderBy(F.round("m", 9).desc(), "symbol"))
    return last.withColumn("rank", rank).filter("rank <= 2").select("sector", C("rank").cast("long").alias("rank"), "symbol", r6("m").alias("m"))


@query("G08_sample_points", "SELECT o_orderkey, round(o_totalprice, 6) AS price FROM (SELECT *, row_number() OVER (ORDER BY (o_orderkey * 48271 + 7) % 2147483647, o_orderkey) AS k, count(*) OVER () AS n FROM orders) WHERE k <= ceil(n * 0.01)")
def _sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = o.count()
    return o.orderBy((C("o_orderkey") * 48271 + 7) % 2147483647, "o_orderkey").limit(-(-n // 100)).select("o_orderkey", r6("o_totalprice").alias("price"))


@query("B03_query_strategies", "WITH e AS (SELECT o_custkey AS strategy, count(*) AS n, avg(o_totalprice) / stddev_samp(o_totalprice) AS sharpe, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY ALL) SELECT strategy, n, round(sharpe, 6) AS sharpe, CASE WHEN n < 10 THEN 'insufficient' WHEN n < 30 THEN 'marginal' ELSE 'adequate' END AS quality FROM e WHERE n >= 5 AND sharpe >= 1.5 AND date_diff('day', last, DATE '2001-08-01') <= 180 ORDER BY round(sharpe, 9) DESC, strategy LIMIT 20")
def _strategies(spark, sf_dir):
    e = table(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("strategy")).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.avg("o_totalprice"), F.stddev_samp("o_totalprice")).alias("sharpe"), F.max(F.to_date("o_orderdate")).alias("last"))
    fresh = F.datediff(F.lit("2001-08-01").cast("date"), "last") <= 180
    best = e.filter((C("n") >= 5) & (C("sharpe") >= 1.5) & fresh).orderBy(F.round("sharpe", 9).desc(), "strategy").limit(20)
    return best.select("strategy", "n", r6("sharpe").alias("sharpe"), habits.quality(C("n"), F.lit(400)).alias("quality"))


_MANY = f"""{PANEL}, many AS (SELECT symbol, date, k AS factor, close / lag(close, k) OVER (PARTITION BY symbol, k ORDER BY date) - 1 AS f, lead(close) OVER (PARTITION BY symbol, k ORDER BY date) / close - 1 AS y FROM panel, (SELECT unnest([1, 2, 3, 6]) AS k)),
mp AS (SELECT *, count(*) OVER (PARTITION BY factor, date) AS n FROM many WHERE f IS NOT NULL AND y IS NOT NULL),
mr AS (SELECT factor, date, n, rank() OVER (PARTITION BY factor, date ORDER BY f) + (count(*) OVER (PARTITION BY factor, date, f) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY factor, date ORDER BY y) + (count(*) OVER (PARTITION BY factor, date, y) - 1) / 2.0 AS ry FROM mp),
mic AS (SELECT factor, date, corr(rf, ry) AS ic FROM mr WHERE n >= 5 GROUP BY ALL HAVING min(rf) < max(rf) AND min(ry) < max(ry)),
ms AS (SELECT factor, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / nullif(stddev_samp(ic), 0) AS ir, count(*) AS n FROM mic GROUP BY factor)"""


def many_ic(spark, sf_dir) -> DataFrame:
    """Rank correlations of four momentum factors in one pass: values side by side, then long."""
    p = panel(spark, sf_dir)
    wide = p.select("symbol", "date", ts.forward_returns(C("close")).alias("y"), *[ts.pct_change(C("close"), k).alias(str(k)) for k in (1, 2, 3, 6)])
    long = wide.unpivot(["symbol", "date", "y"], ["1", "2", "3", "6"], "factor", "f")
    return bench.ic_series(long.withColumn("factor", C("factor").cast("int")), ["factor"])


@query("G02_compare_factors", f"WITH {_MANY} SELECT factor, round(ir, 6) AS ir, row_number() OVER (ORDER BY round(ir, 9) DESC, factor) AS rank, round(ir - max(ir) OVER (), 6) AS delta FROM ms")
def _compare(spark, sf_dir):
    m = bench.summary(many_ic(spark, sf_dir), ["factor"])
    w = Window.partitionBy(F.lit(0))  # one row a factor
    return m.select("factor", r6("ir").alias("ir"), F.row_number().over(w.orderBy(F.round("ir", 9).desc(), "factor")).cast("long").alias("rank"), r6(C("ir") - F.max("ir").over(w)).alias("delta"))


_T = "CASE WHEN n > 1 AND ic_std > 0 THEN ic_mean / (ic_std / sqrt(n)) ELSE 0 END"
_CAT = f"CASE WHEN abs(ic_mean) >= 0.02 AND abs({_T}) >= 2 THEN CASE WHEN ic_mean > 0 THEN 'alive' ELSE 'reversed' END ELSE 'dead' END"


@query("G04_categorise", f"WITH {_MANY} SELECT factor, {_CAT} AS category FROM ms")
def _categorise(spark, sf_dir):
    m = bench.summary(many_ic(spark, sf_dir), ["factor"])
    return m.select("factor", bench.category(C("ic_mean"), bench.t_stat(C("ic_mean"), C("ic_std"), C("n"))).alias("category"))


@query("G09_t_stat", f"WITH {_MANY} SELECT factor, round({_T}, 6) AS t FROM ms")
def _tstat(spark, sf_dir):
    return bench.summary(many_ic(spark, sf_dir), ["factor"]).select("factor", r6(bench.t_stat(C("ic_mean"), C("ic_std"), C("n"))).alias("t"))


@query("G05_categorise_strict", f"""WITH {_MANY}, sp AS (SELECT factor, date < DATE '1999-06-01' AS train, avg(ic) AS m, stddev_samp(ic) AS s, count(*) AS n FROM mic GROUP BY ALL), w AS (SELECT factor, max(CASE WHEN train THEN m END) AS tm, max(CASE WHEN train THEN m / (s / sqrt(n)) END) AS tt, max(CASE WHEN NOT train THEN m END) AS om FROM sp GROUP BY factor)
  SELECT factor, round(tm, 6) AS train_ic, round(om, 6) AS test_ic, CASE WHEN abs(tt) < 2 THEN 'noise' WHEN tm * om <= 0 THEN 'train_only' WHEN tm < 0 THEN 'reversed' ELSE 'confirmed' END AS category FROM w""")
def _strict(spark, sf_dir):
    return rounded(bench_strict(many_ic(spark, sf_dir)).select("factor", "train_ic", "test_ic", "category"))


def bench_strict(ic: DataFrame, split: str = "1999-06-01") -> DataFrame:
    early = C("date") < F.lit(split).cast("date")
    a = F.when(early, C("ic"))
    out = ic.groupBy("factor").agg(F.avg(a).alias("train_ic"), F.stddev_samp(a).alias("s"), F.count(a).alias("n"), F.avg(F.when(~early, C("ic"))).alias("test_ic"))
    t = F.abs(bench.t_stat(C("train_ic"), C("s"), C("n")))
    return out.withColumn("category", F.when(t < 2, "noise").when(C("train_ic") * C("test_ic") <= 0, "train_only").when(C("train_ic") < 0, "reversed").otherwise("confirmed"))


_META = "meta AS (SELECT p_partkey AS id, p_brand AS zoo, string_split(p_name, ' ') AS theme FROM part)"


@query("B02_list_factors", f"WITH {_META} SELECT id FROM meta WHERE zoo = 'Brand#2' AND list_contains(theme, 'ring')")
def _list(spark, sf_dir):
    meta = table(spark, sf_dir, "part").select(C("p_partkey").alias("id"), C("p_brand").alias("zoo"), F.split("p_name", " ").alias("theme"))
    return meta.filter((C("zoo") == "Brand#2") & F.array_contains("theme", "ring")).select("id")


@query("D29_theme_breakdown", f"WITH {_META} SELECT t AS theme, count(*) FILTER (id % 3 = 0) AS alive, count(*) FILTER (id % 3 = 1) AS reversed, count(*) FILTER (id % 3 = 2) AS dead FROM (SELECT id, unnest(theme) AS t FROM meta) GROUP BY ALL")
def _themes(spark, sf_dir):
    kind = F.when(C("p_partkey") % 3 == 0, "alive").when(C("p_partkey") % 3 == 1, "reversed").otherwise("dead")
    rows = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("theme"), kind.alias("category"))
    return rows.groupBy("theme").pivot("category", ["alive", "reversed", "dead"]).agg(F.count(F.lit(1))).na.fill(0)


@query("D30_volume_profile", f"WITH bars AS ({BARS}), r AS (SELECT symbol, min(close) AS lo, max(close) AS hi FROM bars GROUP BY symbol) SELECT symbol, CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((close - lo) / (hi - lo) * 10), 9) AS BIGINT) END AS bin, sum(volume) AS volume FROM bars JOIN r USING (symbol) GROUP BY ALL")
def _vprofile(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "close", "volume")
    r = b.groupBy("symbol").agg(F.min("close").alias("lo"), F.max("close").alias("hi"))
    place = F.coalesce(F.least(F.floor(F.try_divide(C("close") - C("lo"), C("hi") - C("lo")) * 10), F.lit(9)), F.lit(0)).cast("long")
    return b.join(r, "symbol").groupBy("symbol", place.alias("bin")).agg(F.sum("volume").alias("volume"))


@query("D31_hourly_volume", f"WITH {TICKS} SELECT symbol, hour(ts) AS hour, sum(volume)::DOUBLE AS volume FROM ticks GROUP BY ALL")
def _hourly(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy("symbol", F.hour("ts").cast("long").alias("hour")).agg(F.sum("volume").alias("volume"))


@query("D32_decay_metrics", f"WITH {_MANY}, o AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY date) AS a, row_number() OVER (PARTITION BY factor ORDER BY date DESC) AS b FROM mic), g AS (SELECT factor, avg(CASE WHEN a <= 5 THEN ic END) AS baseline, avg(CASE WHEN b <= 5 THEN ic END) AS rolling, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS positive FROM o GROUP BY factor) SELECT factor, round(baseline, 6) AS baseline, round(rolling, 6) AS rolling, round(positive, 6) AS positive, round(rolling / baseline, 6) AS ratio FROM g")
def _decay(spark, sf_dir):
    return rounded(habits.decay_metrics(many_ic(spark, sf_dir), ["factor"]))


@query("J43_evaluate_decay", f"WITH {_MANY}, o AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY date) AS a, row_number() OVER (PARTITION BY factor ORDER BY date DESC) AS b FROM mic), g AS (SELECT factor, avg(CASE WHEN b <= 5 THEN ic END) / avg(CASE WHEN a <= 5 THEN ic END) AS ratio, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS positive FROM o GROUP BY factor) SELECT factor, ['healthy', 'watch', 'decayed'][greatest(CASE WHEN ratio >= 0.7 THEN 1 WHEN ratio >= 0.3 THEN 2 ELSE 3 END, CASE WHEN positive >= 0.55 THEN 1 WHEN positive >= 0.45 THEN 2 ELSE 3 END)] AS status FROM g")
def _evaluate(spark, sf_dir):
    m = habits.decay_metrics(many_ic(spark, sf_dir), ["factor"])
    level = lambda x, hi, lo: F.when(C(x) >= hi, 1).when(C(x) >= lo, 2).otherwise(3)
    worst = F.greatest(level("ratio", 0.7, 0.3), level("positive", 0.55, 0.45))
    return m.select("factor", F.element_at(F.array(*map(F.lit, ("healthy", "watch", "decayed"))), worst).alias("status"))


# ---- flows, books, multiples


@query("D33_total_flows", f"WITH {CASHFLOWS} SELECT fund, kind, round(sum(amount), 2) AS total FROM cashflows WHERE kind <> 'valuation' GROUP BY ALL")
def _total(spark, sf_dir):
    return cashflows(spark, sf_dir).filter(~C("kind").isin("valuation")).groupBy("fund", "kind").agg(F.round(F.sum("amount"), 2).alias("total"))


@query("H03_between", f"WITH {CASHFLOWS} SELECT flow_id, round(amount, 2) AS amount FROM cashflows WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND kind IN ('contribution', 'distribution')")
def _between(spark, sf_dir):
    f = cashflows(spark, sf_dir).filter(C("date").between(F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date")) & C("kind").isin("contribution", "distribution"))
    return f.select("flow_id", F.round("amount", 2).alias("amount"))


_MULT = f"""WITH {CASHFLOWS}, m AS (SELECT fund, sum(CASE WHEN kind = 'contribution' THEN -amount END) AS paid, coalesce(sum(CASE WHEN kind = 'distribution' THEN amount END), 0) AS dist, coalesce(arg_max(amount, (date, flow_id)) FILTER (kind = 'valuation'), 0) AS nav FROM cashflows GROUP BY fund)"""


@query("D34_fund_multiples", f"{_MULT} SELECT fund, round(paid, 2) AS paid_in, round(dist, 2) AS distributed, round(nav, 2) AS residual, round(dist / paid, 6) AS dpi, round(nav / paid, 6) AS rvpi, round((dist + nav) / paid, 6) AS tvpi FROM m")
def _multiples(spark, sf_dir):
    is_kind = lambda k: C("kind") == k
    m = cashflows(spark, sf_dir).groupBy("fund").agg(
        F.sum(F.when(is_kind("contribution"), -C("amount"))).alias("paid"), F.coalesce(F.sum(F.when(is_kind("distribution"), C("amount"))), F.lit(0.0)).alias("dist"),
        F.coalesce(F.max_by(C("amount"), F.when(is_kind("valuation"), F.struct("date", "flow_id"))), F.lit(0.0)).alias("nav"),
    )
    r2 = lambda c: F.round(c, 2)
    return m.select("fund", r2("paid").alias("paid_in"), r2("dist").alias("distributed"), r2("nav").alias("residual"), r6(F.try_divide("dist", "paid")).alias("dpi"), r6(F.try_divide("nav", "paid")).alias("rvpi"), r6(F.try_divide(C("dist") + C("nav"), C("paid"))).alias("tvpi"))


@query("D35_walk_book", "WITH l AS (SELECT l_partkey AS book, l_extendedprice / l_quantity AS price, sum(l_quantity) AS amount FROM lineitem GROUP BY ALL), t AS (SELECT *, greatest(least(amount, 200 - coalesce(sum(amount) OVER (PARTITION BY book ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS take FROM l) SELECT book, round(sum(take), 6) AS filled, round(sum(take * price) / nullif(sum(take), 0), 6) AS avg_price FROM t GROUP BY book")
def _book(spark, sf_dir):
    levels = table(spark, sf_dir, "lineitem").groupBy(C("l_partkey").alias("book"), (C("l_extendedprice") / C("l_quantity")).alias("price")).agg(F.sum("l_quantity").alias("amount"))
    return rounded(habits.walk_book(levels, 200.0, ["book"]))


_REGIME_DAYS = f"{_EQ}, rg AS (SELECT date, equity, equity / lag(equity) OVER (ORDER BY date) - 1 AS r, CASE WHEN date < DATE '1997-06-01' THEN 'bull' WHEN date < DATE '1999-06-01' THEN 'bear' ELSE 'structural' END AS regime FROM eq)"


@query("D37_breakeven_fee", f"WITH {_REGIME_DAYS}, g AS (SELECT regime, exp(sum(ln(1 + r))) - 1 AS gross, count(*) AS n FROM rg WHERE r IS NOT NULL GROUP BY regime) SELECT regime, round(ln(1 + gross) / (2 * n * 0.5) * 10000, 4) AS bps FROM g")
def _breakeven(spark, sf_dir):
    d = C("date")
    e = equity(spark, sf_dir).withColumn("r", F.try_divide(C("equity"), F.lag("equity").over(Window.partitionBy(F.lit(0)).orderBy("date"))) - 1).filter("r is not null")
    reg = F.when(d < F.lit("1997-06-01").cast("date"), "bull").when(d < F.lit("1999-06-01").cast("date"), "bear").otherwise("structural")
    g = e.groupBy(reg.alias("regime")).agg((F.exp(F.sum(F.log(1 + C("r")))) - 1).alias("gross"), F.count(F.lit(1)).alias("n"))
    return g.select("regime", F.round(habits.breakeven_bps(C("gross"), C("n"), 0.5), 4).alias("bps"))


@query("D38_classify_quality", "WITH e AS (SELECT o_custkey AS strategy, count(*) AS n, date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS days FROM orders GROUP BY ALL) SELECT strategy, CASE WHEN n < 10 OR days < 60 THEN 'insufficient' WHEN n < 30 OR days < 252 THEN 'marginal' ELSE 'adequate' END AS quality FROM e")
def _quality(spark, sf_dir):
    d = F.to_date("o_orderdate")
    e = table(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("strategy")).agg(F.count(F.lit(1)).alias("n"), F.datediff(F.max(d), F.min(d)).alias("days"))
    return e.select("strategy", habits.quality(C("n"), C("days")).alias("quality"))


@query("D39_classify_staleness", "WITH e AS (SELECT o_custkey AS strategy, date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '2001-08-01') AS age FROM orders GROUP BY ALL) SELECT strategy, CASE WHEN age <= 90 THEN 'fresh' WHEN age <= 365 THEN 'aging' ELSE 'stale' END AS decay FROM e")
def _staleness(spark, sf_dir):
    age = F.datediff(F.lit("2001-08-01").cast("date"), F.max(F.to_date("o_orderdate")))
    return table(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("strategy")).agg(F.when(age <= 90, "fresh").when(age <= 365, "aging").otherwise("stale").alias("decay"))


@query("D40_multiple_distribution", "WITH m AS (SELECT p_brand AS peer_group, l_extendedprice / nullif(l_quantity * p_size, 0) AS x, l_discount AS d FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount > 0) SELECT peer_group, round(min(x), 6) AS lo, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS hi, count(x) AS n, count(x) < 5 AS few FROM m GROUP BY ALL")
def _dist(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_discount > 0").join(table(spark, sf_dir, "part"), C("l_partkey") == C("p_partkey")).select(C("p_brand").alias("peer_group"), F.try_divide(C("l_extendedprice"), C("l_quantity") * C("p_size")).alias("x"))
    q = lambda p: F.percentile("x", F.lit(p))
    return rounded(rows.groupBy("peer_group").agg(F.min("x").alias("lo"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.max("x").alias("hi"), F.count("x").alias("n"), (F.count("x") < 5).alias("few")))


# ---- set operations


@query("H01_query_events", "WITH u AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, 'a' AS feed FROM events UNION ALL SELECT user_id, CAST(ts AS DATE), event_type, 'b' FROM events WHERE event_id % 2 = 0) SELECT DISTINCT user_id, day, event_type FROM u WHERE day <= DATE '2024-01-20'")
def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id")
    both = e.select("user_id", "day", "event_type").unionByName(e.filter("event_id % 2 = 0").select("user_id", "day", "event_type"))
    return both.filter(C("day") <= F.lit("2024-01-20").cast("date")).dropDuplicates(["user_id", "day", "event_type"])


@query("H02_pit_cut", f"WITH {FILINGS}, v AS (SELECT entity, period, coalesce(CASE WHEN filing_id % 5 = 0 THEN NULL ELSE filed END, period) AS known, val FROM filings) SELECT entity, period, known, round(val, 2) AS val FROM v WHERE known <= DATE '1998-06-30'")
def _pit(spark, sf_dir):
    f = filings(spark, sf_dir).select("entity", "period", F.coalesce(F.when(C("filing_id") % 5 != 0, C("filed")), C("period")).alias("known"), F.round("val", 2).alias("val"))
    return f.filter(C("known") <= F.lit("1998-06-30").cast("date"))


# ---- scalar functions

_POS, _NEG = ("the", "and", "is", "en", "de"), ("of", "to", "la", "le", "der")
_TRIMMED = """list_transform(regexp_split_to_array(replace(lower(text), '/', ' '), '\\s+'), lambda x: trim(x, '.,;:!?"''()'))"""
_COUNT = lambda words: f"CAST(len(list_filter(w, lambda x: x IN {words})) AS DOUBLE)"


@query("I01_score_text", f"WITH w AS (SELECT doc_id, {_TRIMMED} AS w FROM documents), c AS (SELECT doc_id, {_COUNT(_POS)} AS p, {_COUNT(_NEG)} AS n FROM w) SELECT doc_id, round(coalesce((p - n) / nullif(p + n, 0), 0), 6) AS score FROM c")
def _score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", r6(scalar.lexicon_score(C("text"), _POS, _NEG)).alias("score"))


@query("I02_headline_score", f"WITH w AS (SELECT conv_id, turn, {_TRIMMED} AS w FROM conversations), c AS (SELECT conv_id, turn, {_COUNT(_POS)} AS p, {_COUNT(_NEG)} AS n FROM w) SELECT conv_id, turn, round(greatest(least(coalesce((p - n) / nullif(p + n, 0), 0), 0.5), -0.5), 6) AS score FROM c")
def _headline(spark, sf_dir):
    s = scalar.lexicon_score(C("text"), _POS, _NEG)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r6(F.greatest(F.least(s, F.lit(0.5)), F.lit(-0.5))).alias("score"))


@query("I03_knowable_date", "SELECT event_id, CAST(ts AS DATE) + CASE WHEN hour(ts) >= 15 THEN 1 ELSE 0 END AS known FROM events")
def _known(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.knowable_date(C("ts"), 15).alias("known"))


@query("I04_safe_divide", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / nullif(l_discount, 0), 2) AS q FROM lineitem")
def _safe(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(scalar.safe_divide(C("l_extendedprice"), C("l_discount")), 2).alias("q"))


@query("I05_normalize_currency", "WITH c AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN ' x ' ELSE ' ' || lower(substr(c_mktsegment, 1, 3)) || ' ' END AS c FROM customer) SELECT CASE WHEN upper(trim(c)) SIMILAR TO '[A-Z0-9]{3}' THEN upper(trim(c)) END AS code, count(*) AS n FROM c GROUP BY ALL")
def _currency(spark, sf_dir):
    raw = F.when(C("c_custkey") % 10 == 0, " x ").otherwise(F.concat(F.lit(" "), F.lower(F.substring("c_mktsegment", 1, 3)), F.lit(" ")))
    return table(spark, sf_dir, "customer").groupBy(scalar.normalize_currency(raw).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("I06_year_fraction", "WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 1000 AS INTEGER) AS b FROM orders), e AS (SELECT *, least(day(a), 30) AS d1 FROM d) SELECT o_orderkey, round((b - a) / 365.0, 6) AS act365, round((b - a) / 360.0, 6) AS act360, round(((year(b) - year(a)) * 360 + (month(b) - month(a)) * 30 + (CASE WHEN day(b) = 31 AND d1 = 30 THEN 30 ELSE day(b) END - d1)) / 360.0, 6) AS thirty FROM e")
def _fraction(spark, sf_dir):
    a = F.to_date("o_orderdate")
    b = F.date_add(a, (C("o_orderkey") % 1000).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(scalar.year_fraction(a, b, "ACT/365")).alias("act365"), r6(scalar.year_fraction(a, b, "ACT/360")).alias("act360"), r6(scalar.year_fraction(a, b, "30/360")).alias("thirty"))


@query("I07_bars_per_year", "SELECT CASE event_type WHEN 'click' THEN 390 * 252 WHEN 'view' THEN 24 * 365 ELSE 244 END AS bars, count(*) AS n FROM events GROUP BY ALL")
def _bpy(spark, sf_dir):
    t = C("event_type")
    i = F.when(t == "click", "1m").when(t == "view", "1H").otherwise("1D")
    s = F.when(t == "click", "us").when(t == "view", "crypto").otherwise("cn")
    return table(spark, sf_dir, "events").groupBy(scalar.bars_per_year(i, s).alias("bars")).agg(F.count(F.lit(1)).alias("n"))


_IMPACT = "FROM lineitem"


@query("I08_sqrt_impact", f"SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 + CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * 0.1 * 0.02 * sqrt(l_quantity / 1000)), 4) AS price {_IMPACT}")
def _sqrt(spark, sf_dir):
    side = F.when(C("l_returnflag") == "R", -1).otherwise(1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(scalar.sqrt_impact(C("l_extendedprice"), side, C("l_quantity"), F.lit(1000.0), F.lit(0.02), 0.1), 4).alias("price"))


@query("I09_linear_impact", f"SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 + CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * 0.1 * l_quantity / 1000), 4) AS price {_IMPACT}")
def _linear(spark, sf_dir):
    side = F.when(C("l_returnflag") == "R", -1).otherwise(1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(scalar.linear_impact(C("l_extendedprice"), side, C("l_quantity"), F.lit(1000.0), 0.1), 4).alias("price"))


@query("I10_fixed_slippage", f"SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 + CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * 7.0 / 10000), 4) AS price {_IMPACT}")
def _slip(spark, sf_dir):
    side = F.when(C("l_returnflag") == "R", -1).otherwise(1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(scalar.fixed_slippage(C("l_extendedprice"), side, 7.0), 4).alias("price"))


@query("I11_exact", "SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_discount AS DECIMAL(6, 2))) AS DOUBLE) AS total FROM lineitem GROUP BY ALL")
def _exact(spark, sf_dir):
    x = C("l_extendedprice").cast("decimal(18,2)") * C("l_discount").cast("decimal(6,2)")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(x).cast("double").alias("total"))


# ---- regimes

_DENSITY = f"""{_SECTOR}, pr AS (SELECT a.sector AS a, b.sector AS b, a.date, a.r AS x, b.r AS y FROM sr a JOIN sr b ON a.date = b.date AND a.sector < b.sector),
rc AS (SELECT date, CASE WHEN count(*) OVER w = 12 THEN covar_samp(x, y) OVER w / nullif(stddev_samp(x) OVER w * stddev_samp(y) OVER w, 0) END AS c FROM pr WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
den AS (SELECT date, avg(CASE WHEN abs(c) >= 0.3 THEN 1.0 WHEN c IS NOT NULL THEN 0 END) AS density FROM rc GROUP BY date)"""


def density(spark, sf_dir) -> DataFrame:
    rc = pairs.rolling_correlations(sector_returns(spark, sf_dir), "sector", 12)
    return rc.groupBy("date").agg(F.avg((F.abs("corr") >= 0.3).cast("double")).alias("density"))


@query("E48_edge_density", f"WITH {_DENSITY} SELECT date, round(density, 6) AS density FROM den")
def _density(spark, sf_dir):
    return rounded(density(spark, sf_dir))


_STATE = f"{_DENSITY}, sm AS (SELECT date, round(avg(density) OVER (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) AS s FROM den), st AS (SELECT date, s, coalesce(last_value(CASE WHEN s >= 0.37 THEN 1 WHEN s <= 0.33 THEN 0 END IGNORE NULLS) OVER (ORDER BY date), 0) AS fused FROM sm)"


def regimes(spark, sf_dir) -> DataFrame:
    d = density(spark, sf_dir).withColumn("k", F.lit(0))
    d = d.withColumn("s", F.round(F.avg("density").over(Window.partitionBy("k").orderBy("date").rowsBetween(-2, 0)), 9))
    return chains.hysteresis(d, "s", 0.37, 0.33, ["k"], state="fused")


@query("E49_detect_regimes", f"WITH {_STATE} SELECT date, round(s, 6) AS smoothed, fused FROM st")
def _regimes(spark, sf_dir):
    return regimes(spark, sf_dir).select("date", r6("s").alias("smoothed"), "fused")


@query("E50_fused_episodes", f"WITH {_STATE}, n AS (SELECT *, CASE WHEN fused = lag(fused) OVER (ORDER BY date) THEN 0 ELSE 1 END AS new FROM st), r AS (SELECT *, sum(new) OVER (ORDER BY date) AS run FROM n), g AS (SELECT run, any_value(fused) AS fused, min(date) AS start FROM r GROUP BY run), h AS (SELECT *, lead(start) OVER (ORDER BY run) AS stop FROM g) SELECT start, stop FROM h WHERE fused = 1")
def _episodes(spark, sf_dir):
    return chains.runs(regimes(spark, sf_dir), C("fused"), ["k"]).filter("state = 1").select("start", "stop")


_LABEL = f"{PANEL}, lb AS (SELECT symbol, date, close / lag(close, 12) OVER ({S}) - 1 AS t FROM panel), lg AS (SELECT symbol, date, CASE WHEN t > 0.2 THEN 'bull' WHEN t < -0.2 THEN 'bear' WHEN t IS NOT NULL THEN 'structural' END AS regime FROM lb)"


def labels(spark, sf_dir) -> DataFrame:
    t = ts.pct_change(C("close"), 12)
    return panel(spark, sf_dir).select("symbol", "date", F.when(t > 0.2, "bull").when(t < -0.2, "bear").when(t.isNotNull(), "structural").alias("regime"))


@query("E51_label_regimes", f"WITH {_LABEL} SELECT symbol, date, regime FROM lg")
def _labels(spark, sf_dir):
    return labels(spark, sf_dir)


@query("E52_month_spans", f"WITH {_LABEL}, n AS (SELECT *, CASE WHEN regime IS NOT DISTINCT FROM lag(regime) OVER ({S}) AND row_number() OVER ({S}) > 1 THEN 0 ELSE 1 END AS new FROM lg), r AS (SELECT *, sum(new) OVER ({S}) AS run FROM n) SELECT symbol, any_value(regime) AS regime, strftime(min(date), '%Y-%m') AS first, strftime(max(date), '%Y-%m') AS last FROM r WHERE regime IS NOT NULL GROUP BY symbol, run")
def _spans(spark, sf_dir):
    r = chains.runs(labels(spark, sf_dir), C("regime"), ["symbol"]).filter("state is not null")
    return r.select("symbol", C("state").alias("regime"), F.date_format("start", "yyyy-MM").alias("first"), F.date_format("last", "yyyy-MM").alias("last"))


@query("E53_ttm_flows", f"WITH {FILINGS}, q AS (SELECT entity, period, max(filed) AS filed, sum(val) AS val FROM filings GROUP BY ALL), w AS (SELECT *, count(*) OVER x AS n, sum(val) OVER x AS ttm, max(filed) OVER x AS known FROM q WINDOW x AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT entity, period, CASE WHEN n = 4 THEN round(ttm, 2) END AS ttm, CASE WHEN n = 4 THEN known END AS known FROM w")
def _ttm(spark, sf_dir):
    q = filings(spark, sf_dir).groupBy("entity", "period").agg(F.max("filed").alias("filed"), F.sum("val").alias("val"))
    w = Window.partitionBy("entity").orderBy("period").rowsBetween(-3, 0)
    four = F.count(F.lit(1)).over(w) == 4
    return q.select("entity", "period", F.when(four, F.round(F.sum("val").over(w), 2)).alias("ttm"), F.when(four, F.max("filed").over(w)).alias("known"))
