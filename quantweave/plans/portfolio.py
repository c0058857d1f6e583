"""Queries on ingest, filters, joins and portfolio statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..data import BARS, CASHFLOWS, FILINGS, FX, PANEL, TICKS, bars, cashflows, filings, fx_rates, panel, ticks
from ..functions import scalar
from ..operators import asof, metrics, ts
from ..sources import readers
from ..sources.journals import detect_format, parse_journal
from .registry import query, r6, table

C = F.col
S = "PARTITION BY symbol ORDER BY date"


def rounded(df: DataFrame, *plain: str) -> DataFrame:
    """Doubles to six places; other columns as they are."""
    return df.select(*[r6(n).alias(n) if t == "double" else C(n) for n, t in df.dtypes])


# ---- A: scans and cleaning

_LINES = {"symbol": "l_suppkey", "date": "l_shipdate", "open": "l_extendedprice", "high": "l_extendedprice", "low": "l_extendedprice", "close": "l_extendedprice", "volume": "l_quantity"}
_LINES_SQL = "SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, round(l_extendedprice, 6) AS close, round(l_quantity, 6) AS volume FROM lineitem"


@query("A02_read_parquet", _LINES_SQL)
def _a02(spark, sf_dir):
    return readers.read_parquet(spark, f"{sf_dir}/lineitem.parquet", _LINES).select("symbol", F.to_date("date").alias("date"), r6("close").alias("close"), r6("volume").alias("volume"))


@query("A01_read_csv", _LINES_SQL.replace("lineitem", "lineitem WHERE l_linenumber = 1"))
def _a01(spark, sf_dir):
    """The lines are written as CSV to the shared folder and read back with a column map and a date format."""
    from ..scratch import new_path

    path = new_path(spark, "lines-csv")
    table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select("l_suppkey", F.date_format("l_shipdate", "dd/MM/yyyy").alias("l_shipdate"), "l_extendedprice", "l_quantity").write.option("header", True).csv(path)
    rows = readers.read_csv(spark, path, _LINES, "dd/MM/yyyy")
    return rows.select(C("symbol").cast("long").alias("symbol"), F.to_date("date").alias("date"), r6("close").alias("close"), r6("volume").alias("volume"))


@query("A03_read_query", _LINES_SQL.replace("lineitem", "lineitem WHERE l_returnflag = 'R'"))
def _a03(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("qw_lines")
    rows = readers.read_query(spark, "SELECT * FROM qw_lines WHERE l_returnflag = 'R'", _LINES)
    return rows.select("symbol", F.to_date("date").alias("date"), r6("close").alias("close"), r6("volume").alias("volume"))


@query("A04_normalize_columns", "SELECT user_id AS symbol, CAST(ts AS DATE) AS date, round(value, 6) AS close, CAST(0 AS DOUBLE) AS volume FROM events WHERE value IS NOT NULL")
def _a04(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("user_id", C("ts").cast("string").alias("when"), C("value").cast("string").alias("v"))
    rows = readers.normalize_columns(raw, {"symbol": "user_id", "date": "when", "open": "v", "high": "v", "low": "v", "close": "v"})
    return rows.select("symbol", F.to_date("date").alias("date"), r6("close").alias("close"), "volume")


@query("A05_validate_ohlc", f"WITH bars AS ({BARS}), odd AS (SELECT symbol, date, open, high, CASE WHEN (symbol + month(date)) % 17 = 0 THEN high + 1 ELSE low END AS low, close FROM bars) SELECT symbol, date, (high < low OR high < greatest(open, close) OR low > least(open, close) OR open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS invalid FROM odd")
def _a05(spark, sf_dir):
    odd = bars(spark, sf_dir).withColumn("low", F.when((C("symbol") + F.month("date")) % 17 == 0, C("high") + 1).otherwise(C("low")))
    return readers.validate_ohlc(odd, "flag").select("symbol", "date", "invalid")


@query("A06_resample", f"""WITH {TICKS} SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2000-01-01') AS bar, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2""")
def _a06(spark, sf_dir):
    return readers.resample(ticks(spark, sf_dir), "4H").withColumnRenamed("ts", "bar")


@query("A07_forward_adjust", f"""WITH bars AS ({BARS}), f AS (SELECT symbol, date, CASE WHEN month(date) % 3 = 0 THEN 1 + (symbol % 5) * 0.1 + year(date) * 0.01 END AS factor FROM bars),
  j AS (SELECT b.*, coalesce(last_value(factor IGNORE NULLS) OVER ({S.replace('symbol', 'b.symbol').replace('date', 'b.date')} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(factor IGNORE NULLS) OVER ({S.replace('symbol', 'b.symbol').replace('date', 'b.date')} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1) AS f FROM bars b JOIN f ON f.symbol = b.symbol AND f.date = b.date)
  SELECT symbol, date, round(close * f / last_value(f) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS close FROM j""")
def _a07(spark, sf_dir):
    b = bars(spark, sf_dir)
    factors = b.filter(F.month("date") % 3 == 0).select("symbol", "date", (1 + (C("symbol") % 5) * 0.1 + F.year("date") * 0.01).alias("factor"))
    return readers.forward_adjust(b, factors).select("symbol", "date", r6("close").alias("close"))


@query("A08_load_cashflows", f"WITH {CASHFLOWS} SELECT date, round(amount, 2) AS amount, kind, currency, CAST(fund AS VARCHAR) AS fund FROM cashflows")
def _a08(spark, sf_dir):
    raw = cashflows(spark, sf_dir).select(
        F.date_format("date", "yyyy-MM-dd").alias("Value Date"), F.regexp_replace(F.format_string("%.2f", "amount"), r"\.", ",").alias("Cash Amount"), F.initcap("kind").alias("Type"), F.lower("currency").alias("CCY"), C("fund").cast("string").alias("fund"),
    )
    good, _ = readers.load_cashflows(raw, decimal=",")
    return good.select("date", F.round("amount", 2).alias("amount"), "kind", "currency", C("metadata")["fund"].alias("fund"))


@query("A09_long_panel", "WITH r AS (SELECT o_custkey AS entity_id, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS metric, o_totalprice AS value FROM orders) SELECT entity_id, date, metric, round(min(value), 6) AS value FROM r GROUP BY ALL HAVING count(*) = 1")
def _a09(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(C("o_custkey").alias("entity_id"), F.to_date("o_orderdate").alias("date"), C("o_orderstatus").alias("metric"), r6("o_totalprice").alias("value"))
    return readers.long_panel(rows)[0]


@query("A10_wide_panel", f"WITH bars AS ({BARS}) SELECT symbol, date, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT symbol, date, open, high, low, close FROM bars) ON open, high, low, close INTO NAME metric VALUE value)")
def _a10(spark, sf_dir):
    return rounded(readers.melt_panel(bars(spark, sf_dir).select("symbol", "date", "open", "high", "low", "close"), ["symbol", "date"]))


#: The lines of orders as journals of the four layouts, by line number; some sides are no sides.
_SIDES = {"tonghuashun": ("证券卖出", "买入"), "eastmoney": ("S", "B"), "futu": ("Sell Short", "Buy"), "generic": ("short", "LONG")}
_LAYOUT = "CASE l_linenumber % 4 WHEN 0 THEN 'tonghuashun' WHEN 1 THEN 'eastmoney' WHEN 2 THEN 'futu' ELSE 'generic' END"


def journals(spark, sf_dir) -> dict[str, DataFrame]:
    """Each layout's part of the lines, under that layout's own columns."""
    rows, out = table(spark, sf_dir, "lineitem"), {}
    code = F.lpad((C("l_suppkey") % 1000).cast("string"), 3, "0")
    day = C("l_shipdate").cast("date")
    for k, (name, (sell, buy)) in enumerate(_SIDES.items()):
        side = F.when(C("l_returnflag") == "R", sell).when(C("l_returnflag") == "N", buy).when(C("l_orderkey") % 2 == 0, "dividend")
        iso, amount = day.cast("string"), F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))
        columns = {
            "tonghuashun": {"成交时间": F.concat(iso, F.lit(" 10:30:00")), "证券代码": F.concat(F.lit("600"), code), "证券名称": F.lit("n"), "操作": side, "成交数量": C("l_quantity"), "成交价格": F.lit(None).cast("double"), "成交金额": amount, "手续费": C("l_tax"), "印花税": F.lit("1.5"), "过户费": F.lit("x")},
            "eastmoney": {"成交日期": F.date_format(day, "yyyyMMdd"), "成交时间": F.lit("10:30:00"), "股票代码": F.concat(F.lit("1"), code), "股票名称": F.lit("n"), "买卖标志": side, "成交数量": C("l_quantity"), "成交均价": F.lit("0"), "成交金额": amount, "佣金": C("l_tax"), "印花税": F.lit("1.5")},
            "futu": {"Date": (F.datediff(day, F.lit("1899-12-30").cast("date"))).cast("string"), "Time": F.lit("0.4375"), "Symbol": F.concat(F.lit("x"), code, F.lit(".hk")), "Side": side, "Quantity": C("l_quantity"), "Amount": amount, "Commission": C("l_tax"), "Platform Fee": F.lit("1.5")},
            "generic": {"TIME": F.concat(iso, F.lit(" 10:30")), "Ticker": F.concat(F.lit("c"), code, F.lit("-usdt")), "action": side, "QTY": C("l_quantity"), "Notional": amount, "Commission": C("l_tax") + 1.5},
        }[name]
        out[name] = rows.filter(C("l_linenumber") % 4 == k).select(*[c.alias(n) for n, c in columns.items()])
    return out


_JOURNAL = f"""SELECT layout, CAST(l_shipdate AS DATE) + INTERVAL '10 hours 30 minutes' AS ts, CASE layout WHEN 'tonghuashun' THEN '600' || code || '.SH' WHEN 'eastmoney' THEN '001' || code || '.SZ' WHEN 'futu' THEN 'X' || code || '.HK' ELSE 'C' || code || '-USDT' END AS symbol,
  CASE l_returnflag WHEN 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS quantity, round(l_extendedprice / l_quantity, 6) AS price, round(l_extendedprice, 6) AS amount, round(l_tax + 1.5, 6) AS fee, CASE layout WHEN 'futu' THEN 'hk' WHEN 'generic' THEN 'crypto' ELSE 'china_a' END AS market
  FROM (SELECT *, {_LAYOUT} AS layout, lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0') AS code FROM lineitem) WHERE l_returnflag <> 'A'"""


@query("A11_detect_format", f"SELECT {_LAYOUT} AS layout, count(*) AS n FROM lineitem GROUP BY 1")
def _a11(spark, sf_dir):
    parts = [part.groupBy(F.lit(detect_format(part.columns)).alias("layout")).agg(F.count(F.lit(1)).alias("n")) for part in journals(spark, sf_dir).values()]
    return reduce(DataFrame.unionByName, parts)


@query("A12_parse_journal", _JOURNAL)
def _a12(spark, sf_dir):
    parts = [parse_journal(part)[0].withColumn("layout", F.lit(name)) for name, part in journals(spark, sf_dir).items()]
    out = reduce(DataFrame.unionByName, parts)
    return out.select("layout", C("ts").cast("timestamp_ntz").alias("ts"), "symbol", "side", "quantity", r6("price").alias("price"), r6("amount").alias("amount"), r6("fee").alias("fee"), "market")


@query("A13_concept_series", f"WITH {FILINGS}, r AS (SELECT entity, period, filed, val, row_number() OVER (PARTITION BY entity, period ORDER BY CAST(filed AS VARCHAR), CASE WHEN filing_id % 2 = 0 THEN 1 ELSE 2 END, val) AS k FROM filings) SELECT entity, CAST(period AS VARCHAR) AS period, CAST(filed AS VARCHAR) AS filed, round(val, 6) AS val FROM r WHERE k = 1")
def _a13(spark, sf_dir):
    """Filings are put into nested company facts and flattened again."""
    f = filings(spark, sf_dir)
    point = F.struct(F.lit(None).cast("string").alias("start"), C("period").cast("string").alias("end"), C("filed").cast("string").alias("filed"), C("val"), F.lit("10-Q").alias("form"))
    f = f.select("entity", F.when(C("filing_id") % 2 == 0, "Revenues").otherwise("SalesRevenueNet").alias("concept"), point.alias("p"))
    f = f.groupBy("entity", "concept").agg(F.collect_list("p").alias("ps"))
    tree = f.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct(F.create_map(F.lit("USD"), C("ps")).alias("units"))))).alias("m"))
    facts = tree.select("entity", F.to_json(F.create_map(F.lit("us-gaap"), C("m"))).alias("facts"))
    return readers.concept_series(facts, ["Revenues", "SalesRevenueNet"]).select("entity", C("end").alias("period"), "filed", r6("val").alias("val"))


_BRANDS = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]
_BRAND_BARS = "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, p_brand AS symbol, last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS close FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL"


@query("A14_wide_fields", f"WITH s AS ({_BRAND_BARS}) SELECT date, " + ", ".join(f"round(max(CASE WHEN symbol = '{b}' THEN close END), 6) AS s{b[-2:]}" for b in _BRANDS) + " FROM s GROUP BY date")
def _a14(spark, sf_dir):
    """Long to wide, for a fixed list of symbols (brands): the edge where a matrix is wanted."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(C("p_partkey").alias("l_partkey"), C("p_brand").alias("symbol")), "l_partkey")
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    wide = lines.groupBy(F.trunc("l_shipdate", "month").alias("date")).pivot("symbol", _BRANDS).agg(F.max_by(C("l_extendedprice") / C("l_quantity"), at))
    return wide.select("date", *[r6(C(f"`{b}`")).alias(f"s{b[-2:]}") for b in _BRANDS])


@query("A15_sanitize", f"WITH bars AS ({BARS}), odd AS (SELECT symbol, date, CASE WHEN symbol % 7 = 0 AND month(date) = 1 THEN NULL ELSE close END AS close FROM bars) SELECT symbol, date, round(close, 6) AS close FROM odd WHERE close IS NOT NULL")
def _a15(spark, sf_dir):
    january = (C("symbol") % 7 == 0) & (F.month("date") == 1)
    odd = bars(spark, sf_dir).withColumn("close", F.when(january, F.when(C("symbol") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(C("close")))
    return readers.finite_rows(odd, ["close"]).select("symbol", "date", r6("close").alias("close"))


@query("A16_write_artifacts", f"WITH bars AS ({BARS}) SELECT year(date) AS year, count(*) AS n, round(sum(close), 4) AS total FROM bars GROUP BY ALL")
def _a16(spark, sf_dir):
    """Bars are written by year to the shared folder; what is read back is summed."""
    from ..scratch import new_path

    folder = new_path(spark, "artifacts")
    path = readers.write_artifacts({"bars": bars(spark, sf_dir).withColumn("year", F.year("date"))}, folder, partition_by={"bars": ["year"]})[0]
    return spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("total"))


_RET = f"""rets AS (SELECT symbol, date, close, coalesce(close / CASE WHEN prev > 0 THEN prev END - 1, 0) AS ret, CASE WHEN lag1 IS NOT NULL THEN close / lag1 - 1 END AS r FROM (SELECT *, lag(close) OVER ({S}) AS lag1,
  last_value(close IGNORE NULLS) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM panel))"""
_EQ = f"""{PANEL}, {_RET}, mkt AS (SELECT date, quantile_cont(ret, 0.5) AS m, quantile_cont(CASE WHEN symbol % 2 = 0 THEN ret END, 0.5) AS b FROM rets GROUP BY date),
eq AS (SELECT date, 1e6 * exp(sum(ln(1 + m)) OVER (ORDER BY date)) AS equity, b FROM mkt)"""


def returns(spark, sf_dir) -> DataFrame:
    """symbol, date, close, ret (0 where undefined), r (null where undefined)."""
    return panel(spark, sf_dir).select("symbol", "date", "close", ts.bar_returns(C("close")).alias("ret"), ts.pct_change(C("close")).alias("r"))


def equity(spark, sf_dir) -> DataFrame:
    """date, equity that earns the median symbol's return, b (the median of the even ones): one row a date."""
    half = F.lit(0.5)
    mkt = returns(spark, sf_dir).groupBy("date").agg(F.percentile("ret", half).alias("m"), F.percentile(F.when(C("symbol") % 2 == 0, C("ret")), half).alias("b"))
    return mkt.select("date", (1e6 * F.exp(F.sum(F.log(1 + C("m"))).over(Window.partitionBy(F.lit(0)).orderBy("date")))).alias("equity"), "b")


@query("A17_read_equity", f"WITH {_EQ} SELECT date, round(equity, 4) AS equity FROM eq WHERE month(date) <> 6")
def _a17(spark, sf_dir):
    raw = equity(spark, sf_dir).select(C("date").alias("Timestamp"), F.when(F.month("date") == 6, "n/a").otherwise(C("equity").cast("string")).alias("NAV"))
    good, _ = readers.read_equity(raw)
    return good.select(F.to_date("date").alias("date"), F.round("equity", 4).alias("equity"))


@query("A18_canonical_label", "SELECT regexp_replace(lower(trim(o_orderpriority)), '[\\s_-]+', '_', 'g') AS kind, count(*) AS n FROM orders GROUP BY ALL")
def _a18(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(readers.canonical_label(C("o_orderpriority")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _element(name: str, value) -> list:
    return [F.lit(f"<{name}>"), value if not isinstance(value, str) else F.lit(value), F.lit(f"</{name}>")]


@query("A19_parse_holdings", "SELECT s_nationkey AS id, 'S' || s_nationkey AS series_id, DATE '2024-03-31' AS as_of, s_name AS name, CAST(s_suppkey AS VARCHAR) AS cusip, 'US' || s_suppkey AS isin, round(s_acctbal, 6) AS value_usd, round(s_acctbal / 100, 6) AS pct_of_net_assets, CASE WHEN s_suppkey % 2 = 0 THEN 'EC' END AS asset_category FROM supplier")
def _a19(spark, sf_dir):
    """Suppliers as the holdings of their nation's fund, written as portfolio reports and read back."""
    key = C("s_suppkey").cast("string")
    category = F.when(C("s_suppkey") % 2 == 0, "<assetCat>EC</assetCat>").otherwise("")
    one = F.concat(*[F.lit("<invstOrSec>"), *_element("name", C("s_name")), *_element("cusip", key), F.lit('<identifiers><isin value="US'), key, F.lit('"/></identifiers>'), *_element("valUSD", C("s_acctbal").cast("string")), *_element("pctVal", (C("s_acctbal") / 100).cast("string")), category, F.lit("</invstOrSec>")])
    head = F.concat(F.lit('<?xml version="1.0"?><edgarSubmission xmlns="http://www.sec.gov/edgar/nport"><headerData><submissionType>NPORT-P</submissionType></headerData><formData><genInfo><seriesId>S'), C("id").cast("string"), F.lit("</seriesId><repPdDate>2024-03-31</repPdDate></genInfo><invstOrSecs>"))
    xml = table(spark, sf_dir, "supplier").groupBy(C("s_nationkey").alias("id")).agg(F.array_join(F.collect_list(one), "").alias("body")).select("id", F.concat(head, "body", F.lit("</invstOrSecs></formData></edgarSubmission>")).alias("xml"))
    return readers.parse_holdings(xml).select("id", "series_id", "as_of", "name", "cusip", "isin", r6("value_usd").alias("value_usd"), r6("pct_of_net_assets").alias("pct_of_net_assets"), "asset_category")


@query("A20_parse_information_table", "SELECT s_nationkey AS id, s_name AS name, 'X' || CAST(s_suppkey AS VARCHAR) AS cusip, round(s_acctbal, 6) AS value, CAST(s_suppkey * 1000 AS DOUBLE) AS shares, 'SH' AS share_type, CASE WHEN s_suppkey % 3 = 0 THEN 'Put' ELSE '' END AS put_call, 2 AS entries FROM supplier")
def _a20(spark, sf_dir):
    """Suppliers as positions, each split over two managers, written as information tables, read back and added up."""
    half = lambda share, comma: [
        F.lit("<ns1:infoTable>"), *_element("ns1:nameOfIssuer", C("s_name")), *_element("ns1:titleOfClass", "COM"), F.lit("<ns1:cusip>x"), C("s_suppkey").cast("string"), F.lit("</ns1:cusip>"), *_element("ns1:value", (C("s_acctbal") / 2).cast("string")),
        F.lit("<ns1:shrsOrPrnAmt><ns1:sshPrnamt>"), F.format_number(C("s_suppkey") * share, 0) if comma else (C("s_suppkey") * share).cast("string"), F.lit("</ns1:sshPrnamt><ns1:sshPrnamtType>SH</ns1:sshPrnamtType></ns1:shrsOrPrnAmt>"),
        F.when(C("s_suppkey") % 3 == 0, "<ns1:putCall>Put</ns1:putCall>").otherwise(""), F.lit("<ns1:investmentDiscretion>SOLE</ns1:investmentDiscretion></ns1:infoTable>"),
    ]
    one = F.concat(*[*half(400, True), *half(600, False)])
    xml = table(spark, sf_dir, "supplier").groupBy(C("s_nationkey").alias("id")).agg(F.concat(F.lit('<ns1:informationTable xmlns:ns1="http://www.sec.gov/edgar/document/thirteenf/informationtable">'), F.array_join(F.collect_list(one), ""), F.lit("</ns1:informationTable>")).alias("xml"))
    out = readers.by_cusip(readers.parse_information_table(xml))
    return out.select("id", "name", "cusip", r6("value").alias("value"), "shares", "share_type", "put_call", C("entries").cast("int").alias("entries"))


_PLAIN = "trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))"


@query("A21_parse_feed", f"SELECT conv_id AS code, DATE '2024-03-01' + CAST(turn % 20 AS INTEGER) + CASE WHEN turn % 24 >= 15 THEN 1 ELSE 0 END AS knowable_date, coalesce({_PLAIN}, '') AS summary FROM conversations")
def _a21(spark, sf_dir):
    """Whole turns of conversations as feed items, written as XML and read back."""
    at = F.date_format(F.to_timestamp(F.date_add(F.lit("2024-03-01").cast("date"), (C("turn") % 20).cast("int"))) + F.make_dt_interval(hours=(C("turn") % 24).cast("int")), "yyyy-MM-dd HH:mm:ss")
    words = F.coalesce(F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " ")), F.lit(""))
    one = F.concat(F.lit("<item><title>"), words, F.lit("</title><description>d</description><pubDate>"), at, F.lit("</pubDate></item>"))
    xml = table(spark, sf_dir, "conversations").groupBy(C("conv_id").alias("code")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(one), ""), F.lit("</channel></rss>")).alias("xml"))
    return readers.parse_feed(xml, 15).select("code", "knowable_date", F.coalesce("summary", F.lit("")).alias("summary"))


# ---- B: filters

@query("B01_apply_filter", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-03-01' AND l_shipdate < TIMESTAMP '1997-07-01' AND upper(l_returnflag) = 'R'")
def _b01(spark, sf_dir):
    from ..operators.journal import apply_filter

    rows = table(spark, sf_dir, "lineitem")
    return apply_filter(apply_filter(rows, "1997-03 to 1997-06", "l_shipdate"), "l_returnflag=r", "l_shipdate").select("l_orderkey", "l_linenumber", "l_shipdate")


@query("B04_infer_market", "SELECT CASE WHEN p_partkey % 4 = 0 THEN 'equity_cn' WHEN p_partkey % 4 = 1 THEN 'equity_hk' WHEN p_partkey % 4 = 2 THEN 'crypto' ELSE 'equity_us' END AS market, count(*) AS n FROM part GROUP BY ALL")
def _b04(spark, sf_dir):
    k = C("p_partkey")
    symbol = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(".SZ"))).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(".hk"))).when(k % 4 == 2, F.lit("BTC-USDT")).otherwise(F.substring(F.upper(F.regexp_replace("p_name", "[^a-z]", "")), 1, 4))
    return table(spark, sf_dir, "part").groupBy(scalar.infer_market(symbol).alias("market")).agg(F.count(F.lit(1)).alias("n"))


@query("B06_form_allowed", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY ALL")
def _b06(spark, sf_dir):
    form = F.when(C("o_orderpriority") == "1-URGENT", "10-K").when(C("o_orderpriority") == "3-MEDIUM", "20-F").otherwise("8-K")
    return table(spark, sf_dir, "orders").filter(scalar.form_allowed(form, "annual")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("B07_validate_output", f"WITH {PANEL}, f AS (SELECT close / lag(close, 3) OVER ({S}) - 1 AS f FROM panel) SELECT count(*) AS n, sum(CASE WHEN f IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_null, false AS has_infinite, avg(CASE WHEN f IS NULL THEN 1.0 ELSE 0 END) <= 0.95 AS valid FROM f")
def _b07(spark, sf_dir):
    f = panel(spark, sf_dir).select(ts.pct_change(C("close"), 3).alias("f"))
    out = f.agg(F.count(F.lit(1)).alias("n"), F.sum(C("f").isNull().cast("long")).alias("n_null"), F.coalesce(F.max(F.abs("f") == float("inf")), F.lit(False)).alias("has_infinite"))
    return out.withColumn("valid", ~C("has_infinite") & (C("n_null") / C("n") <= 0.95))


@query("B08_classify_span", "SELECT CASE WHEN d BETWEEN 80 AND 100 THEN 'quarter' WHEN d BETWEEN 350 AND 380 THEN 'annual' ELSE 'other' END AS span, count(*) AS n FROM (SELECT date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 400 AS d FROM orders) GROUP BY ALL")
def _b08(spark, sf_dir):
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) % 400
    return table(spark, sf_dir, "orders").groupBy(scalar.classify_span(days).alias("span")).agg(F.count(F.lit(1)).alias("n"))


# ---- C: joins

_ENTITY_BARS = f"eb AS (SELECT symbol AS entity, CAST(date AS DATE) AS date, close FROM ({BARS}))"


@query("C01_enrich_statements", f"""WITH {FILINGS}, {_ENTITY_BARS}, up AS (SELECT * FROM (SELECT *, max(period) OVER (PARTITION BY entity ORDER BY filed, period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM filings) WHERE period = top),
  best AS (SELECT entity, filed, max(period) AS period, arg_max(val, (period, val, filing_id)) AS val FROM up GROUP BY entity, filed)
  SELECT b.entity, b.date, round(b.close, 6) AS close, s.period, round(s.val, 6) AS val FROM eb b ASOF LEFT JOIN best s ON b.entity = s.entity AND b.date >= s.filed""")
def _c01(spark, sf_dir):
    b = bars(spark, sf_dir).select(C("symbol").alias("entity"), "date", "close")
    s = asof.no_regress(filings(spark, sf_dir), ["entity"], "period", "filed")
    return rounded(asof.asof_join(b, s.select("entity", "filed", "period", "val", "filing_id"), ["entity"], "date", "filed").select("entity", "date", "close", "period", "val"))


@query("C02_ffill_pit", f"""WITH {FILINGS}, {_ENTITY_BARS}, best AS (SELECT entity, filed, arg_max(val, (val, filing_id)) AS val FROM filings GROUP BY entity, filed)
  SELECT b.entity, b.date, round(s.val, 6) AS val FROM eb b ASOF LEFT JOIN best s ON b.entity = s.entity AND b.date >= s.filed""")
def _c02(spark, sf_dir):
    b = bars(spark, sf_dir).select(C("symbol").alias("entity"), "date")
    return rounded(asof.asof_join(b, filings(spark, sf_dir).select("entity", "filed", "val", "filing_id"), ["entity"], "date", "filed").select("entity", "date", "val"))


_RATED = f"""WITH {CASHFLOWS}, {FX}, rated AS (SELECT c.*, f.date AS rate_date, f.rate, date_diff('day', f.date, c.date) AS age FROM cashflows c ASOF LEFT JOIN fx f ON c.currency = f.base AND c.date >= f.date)"""


def _rated(spark, sf_dir) -> DataFrame:
    fx = fx_rates(spark, sf_dir).select(C("base").alias("currency"), C("date").alias("rate_date"), "rate")
    return asof.asof_join(cashflows(spark, sf_dir), fx, ["currency"], "date", "rate_date").withColumn("age", F.datediff("date", "rate_date"))


@query("C03_get_rate", f"{_RATED} SELECT flow_id, rate_date, round(rate, 6) AS rate, age > 0 AS stale FROM rated WHERE age <= 45")
def _c03(spark, sf_dir):
    return rounded(_rated(spark, sf_dir).filter("age <= 45").select("flow_id", "rate_date", "rate", (C("age") > 0).alias("stale")))


@query("C04_translate_cashflows", f"{_RATED} SELECT flow_id, round(amount * rate, 4) AS amount, 'USD' AS currency, round(amount, 4) AS original_amount, currency AS original_currency FROM rated WHERE rate IS NOT NULL")
def _c04(spark, sf_dir):
    out = _rated(spark, sf_dir).filter("rate is not null").select("flow_id", F.round(C("amount") * C("rate"), 4).alias("amount"), F.lit("USD").alias("currency"), F.struct("amount", "currency").alias("original"))
    return out.select("flow_id", "amount", "currency", F.round("original.amount", 4).alias("original_amount"), C("original.currency").alias("original_currency"))


_EVENTS = "scored AS (SELECT user_id AS symbol, CAST(ts AS DATE) + CASE WHEN hour(ts) >= 15 THEN 1 ELSE 0 END AS day, CASE event_type WHEN 'error' THEN -0.3 ELSE 0.3 END AS s FROM events WHERE event_type IN ('error', 'purchase'))"
_POINTS = "points AS (SELECT DISTINCT user_id AS symbol, CAST(ts AS DATE) AS day FROM events)"


def scored_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(C("event_type").isin("error", "purchase"))
    return e.select(C("user_id").alias("symbol"), scalar.knowable_date(C("ts"), 15).alias("known"), F.when(C("event_type") == "error", -0.3).otherwise(0.3).alias("s"))


@query("C05_enrich_events", f"WITH {_EVENTS}, {_POINTS} SELECT p.symbol, p.day, round(greatest(least(coalesce(sum(s * exp(-0.4 * date_diff('day', e.day, p.day))), 0), 1), -1), 6) AS score, count(e.s) AS n_events FROM points p LEFT JOIN scored e ON e.symbol = p.symbol AND e.day <= p.day AND e.day > p.day - 5 GROUP BY ALL")
def _c05(spark, sf_dir):
    points = table(spark, sf_dir, "events").select(C("user_id").alias("symbol"), F.to_date("ts").alias("day")).distinct()
    out = asof.window_sum(points, scored_events(spark, sf_dir), ["symbol"], "day", "known", 5, C("s") * F.exp(-0.4 * C("_age")))
    return out.select("symbol", "day", r6(F.greatest(F.least("score", F.lit(1.0)), F.lit(-1.0))).alias("score"), C("n_events").cast("long").alias("n_events"))


_ALIGN = f"""WITH bars AS ({BARS}), grid AS (SELECT symbol, CAST(date AS DATE) AS date FROM (SELECT DISTINCT symbol FROM bars), (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS date FROM bars)),
  sig AS (SELECT symbol, date, lag(sign(close - open) * 0.8) OVER ({S}) AS s FROM bars), j AS (SELECT g.symbol, g.date, last_value(s IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s FROM grid g LEFT JOIN sig ON sig.symbol = g.symbol AND sig.date = g.date),
  w AS (SELECT symbol, date, coalesce(least(greatest(s, -1), 1), 0) AS w FROM j)
  SELECT symbol, date, round(w / greatest(sum(abs(w)) OVER (PARTITION BY date), 1), 6) AS weight FROM w"""


def aligned_weights(spark, sf_dir) -> DataFrame:
    """symbol, date, weight from the sign of each bar, known one bar later."""
    from ..operators.signals import align

    b = bars(spark, sf_dir)
    return align(b, b.select("symbol", "date", (F.signum(C("close") - C("open")) * 0.8).alias("signal")), limit=5)


@query("C06_align", _ALIGN)
def _c06(spark, sf_dir):
    return rounded(aligned_weights(spark, sf_dir))


_WEIGHTS = _ALIGN.replace("SELECT symbol, date, round(w / greatest", "SELECT symbol, date, (w / greatest").replace(", 6) AS weight FROM w", ") AS weight FROM w")
_W = f"weights AS ({_WEIGHTS})"


@query("C07_aligned_returns", f"WITH {PANEL}, {_RET}, full_ AS (SELECT date FROM rets GROUP BY date HAVING count(r) = count(*)) SELECT symbol, date, round(r, 6) AS r FROM rets SEMI JOIN full_ USING (date)")
def _c07(spark, sf_dir):
    w = Window.partitionBy("date")
    rows = returns(spark, sf_dir).select("symbol", "date", "r").withColumn("full", F.count("r").over(w) == F.count(F.lit(1)).over(w))
    return rounded(rows.filter("full").select("symbol", "date", "r"))


_POS = lambda year: f"SELECT l_suppkey AS cusip, l_returnflag AS put_call, sum(l_quantity) AS shares FROM lineitem WHERE year(l_shipdate) = {year} GROUP BY ALL HAVING sum(l_quantity) % 3 <> 0"


def _positions(spark, sf_dir, year: int) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").filter(F.year("l_shipdate") == year)
    return t.groupBy(C("l_suppkey").alias("cusip"), C("l_returnflag").alias("put_call")).agg(F.sum("l_quantity").alias("shares")).filter(C("shares") % 3 != 0)


@query("C08_diff_positions", f"WITH a AS ({_POS(1998)}), b AS ({_POS(1997)}) SELECT cusip, put_call, a.shares AS now, b.shares AS before, CASE WHEN b.shares IS NULL THEN 'new' WHEN a.shares IS NULL THEN 'closed' WHEN a.shares > b.shares THEN 'increased' WHEN a.shares < b.shares THEN 'reduced' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (cusip, put_call)")
def _c08(spark, sf_dir):
    from ..operators.holdings import diff_positions

    return diff_positions(_positions(spark, sf_dir, 1998), _positions(spark, sf_dir, 1997))


_FLOWS = f"q AS (SELECT entity, period, sum(val) AS val FROM (WITH {FILINGS} SELECT * FROM filings) GROUP BY ALL)"


@query("C09_quarterly_flows", f"""WITH {_FLOWS}, y AS (SELECT entity, year(period) AS year, sum(val) * 1.1 AS val FROM q GROUP BY ALL),
  j AS (SELECT y.entity, y.year, y.val - sum(q.val) AS val FROM y JOIN q ON q.entity = y.entity AND year(q.period) = y.year AND month(q.period) < 12 GROUP BY y.entity, y.year, y.val HAVING count(*) = 3)
  SELECT entity, period, round(val, 4) AS val FROM q WHERE month(period) < 12 UNION ALL SELECT entity, make_date(year, 12, 31), round(val, 4) FROM j""")
def _c09(spark, sf_dir):
    from ..operators.holdings import fourth_quarters

    q = filings(spark, sf_dir).groupBy("entity", "period").agg(F.sum("val").alias("val"))
    year = q.groupBy("entity", F.year("period").alias("y")).agg((F.sum("val") * 1.1).alias("val"))
    annual = year.select("entity", F.make_date("y", F.lit(1), F.lit(1)).alias("start"), F.make_date("y", F.lit(12), F.lit(31)).alias("end"), "val")
    quarters = q.filter(F.month("period") < 12).select("entity", F.trunc("period", "quarter").alias("start"), C("period").alias("end"), "val")
    return quarters.unionByName(fourth_quarters(annual, quarters)).select("entity", C("end").alias("period"), F.round("val", 4).alias("val"))


@query("C10_inject_fundamentals", f"WITH {PANEL}, {FILINGS}, q AS (SELECT entity AS symbol, CAST(date_trunc('month', filed) AS DATE) AS date, max(val) AS val FROM filings GROUP BY ALL) SELECT symbol, date, round(close, 6) AS close, round(val, 6) AS fund_val FROM panel LEFT JOIN q USING (symbol, date)")
def _c10(spark, sf_dir):
    q = filings(spark, sf_dir).groupBy(C("entity").alias("symbol"), F.trunc("filed", "month").alias("date")).agg(F.max("val").alias("fund_val"))
    return rounded(panel(spark, sf_dir).select("symbol", "date", "close").join(q, ["symbol", "date"], "left"))


@query("C11_style_exposure", f"WITH {_W}, x AS (SELECT s_suppkey AS symbol, s_acctbal AS x FROM supplier WHERE s_suppkey % 9 <> 0), j AS (SELECT w.date, weight, x, 1.0 / count(*) OVER (PARTITION BY w.date) AS b FROM weights w LEFT JOIN x USING (symbol)) SELECT date, round(sum(weight * x), 6) AS exposure, round(sum(weight * x) - sum(b * x), 6) AS active, round(coalesce(sum(CASE WHEN x IS NULL THEN abs(weight) END), 0), 6) AS unmatched FROM j GROUP BY date")
def _c11(spark, sf_dir):
    x = table(spark, sf_dir, "supplier").filter(C("s_suppkey") % 9 != 0).select(C("s_suppkey").alias("symbol"), C("s_acctbal").alias("x"))
    w = aligned_weights(spark, sf_dir).join(x, "symbol", "left").withColumn("b", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("date")))
    own = F.sum(C("weight") * C("x"))
    return rounded(w.groupBy("date").agg(own.alias("exposure"), (own - F.sum(C("b") * C("x"))).alias("active"), F.coalesce(F.sum(F.when(C("x").isNull(), F.abs("weight"))), F.lit(0.0)).alias("unmatched")))


@query("C12_attach_features", f"""WITH bars AS ({BARS}), f AS (SELECT symbol, CAST(date AS TIMESTAMP) AS date, avg(close) OVER ({S} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM bars),
  t AS (SELECT l_suppkey AS symbol, l_orderkey, l_linenumber, l_partkey, l_shipdate AS ts FROM lineitem) SELECT t.symbol, t.l_orderkey, t.l_linenumber, t.l_partkey, round(m, 6) AS m FROM t ASOF LEFT JOIN f ON t.symbol = f.symbol AND t.ts > f.date""")
def _c12(spark, sf_dir):
    f = bars(spark, sf_dir).select("symbol", C("date").cast("timestamp").alias("at"), F.avg("close").over(ts.last(3)).alias("m"))
    t = table(spark, sf_dir, "lineitem").select(C("l_suppkey").alias("symbol"), "l_orderkey", "l_linenumber", "l_partkey", C("l_shipdate").cast("timestamp").alias("ts"))
    return rounded(asof.asof_join(t, f, ["symbol"], "ts", "at", strict=True).select("symbol", "l_orderkey", "l_linenumber", "l_partkey", "m"))


@query("C13_evidence_by_regime", f"""WITH {_EQ}, reg AS (SELECT date, CASE WHEN t > 0.05 THEN 'bull' WHEN t < -0.05 THEN 'bear' ELSE 'structural' END AS regime FROM (SELECT date, equity / lag(equity, 12) OVER (ORDER BY date) - 1 AS t FROM eq) WHERE t IS NOT NULL),
  t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice AS pnl FROM orders) SELECT regime, count(*) AS n, round(avg(pnl), 4) AS avg_pnl FROM t ASOF JOIN reg ON t.date >= reg.date GROUP BY ALL""")
def _c13(spark, sf_dir):
    e = equity(spark, sf_dir)
    t = F.try_divide(C("equity"), F.lag("equity", 12).over(Window.partitionBy(F.lit(0)).orderBy("date"))) - 1
    reg = e.select("date", t.alias("t")).filter("t is not null").select(C("date").alias("start"), F.when(C("t") > 0.05, "bull").when(C("t") < -0.05, "bear").otherwise("structural").alias("regime"))
    # regimes are spans of one short calendar: a broadcast range join keeps the trades where they are
    spans = reg.withColumn("stop", F.lead("start").over(Window.partitionBy(F.lit(0)).orderBy("start")))
    trades = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), C("o_totalprice").alias("pnl"))
    hit = trades.join(F.broadcast(spans), (C("date") >= C("start")) & (C("stop").isNull() | (C("date") < C("stop"))))
    return hit.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pnl"), 4).alias("avg_pnl"))


# ---- D: aggregates

_TRADES = f"""WITH {CASHFLOWS}, tr AS (SELECT fund AS symbol, flow_id AS trade_id, date AS exit_time, round(amount - 20000 * (flow_id % 11 - 5), 2) AS pnl, flow_id % 9 AS holding_bars, CASE flow_id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'target' ELSE 'signal' END AS exit_reason FROM cashflows WHERE kind <> 'valuation')"""


def round_trips(spark, sf_dir) -> DataFrame:
    k = C("flow_id")
    return cashflows(spark, sf_dir).filter("kind <> 'valuation'").select(
        C("fund").alias("symbol"), k.alias("trade_id"), C("date").alias("exit_time"), F.round(C("amount") - 20000 * (k % 11 - 5), 2).alias("pnl"), (k % 9).alias("holding_bars"),
        F.when(k % 3 == 0, "stop").when(k % 3 == 1, "target").otherwise("signal").alias("exit_reason"),
    )


@query("D01_trade_stats", f"""{_TRADES}, runs AS (SELECT *, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY exit_time, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM tr),
  st AS (SELECT symbol, max(k) AS k FROM (SELECT symbol, run, count(*) AS k FROM runs WHERE pnl < 0 GROUP BY ALL) GROUP BY symbol)
  SELECT tr.symbol, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(coalesce(avg(CASE WHEN pnl > 0 THEN pnl END) / abs(avg(CASE WHEN pnl < 0 THEN pnl END)), 0), 4) AS profit_loss_ratio, round(coalesce(sum(CASE WHEN pnl > 0 THEN pnl END) / abs(sum(CASE WHEN pnl < 0 THEN pnl END)), 0), 4) AS profit_factor,
  coalesce(max(st.k), 0) AS max_consecutive_loss, round(coalesce(avg(CASE WHEN holding_bars > 0 THEN holding_bars END), 0), 1) AS avg_holding_bars, count(*) AS n FROM tr LEFT JOIN st ON st.symbol = tr.symbol GROUP BY tr.symbol""")
def _d01(spark, sf_dir):
    return rounded(metrics.trade_stats(round_trips(spark, sf_dir), ["symbol"]))


@query("D02_by_symbol", f"{_TRADES} SELECT symbol, count(*) AS n, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END), 4) AS win_rate, round(sum(pnl), 2) AS total_pnl, round(avg(pnl), 2) AS avg_pnl FROM tr GROUP BY symbol")
def _d02(spark, sf_dir):
    return round_trips(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((C("pnl") > 0).cast("double")), 4).alias("win_rate"), F.round(F.sum("pnl"), 2).alias("total_pnl"), F.round(F.avg("pnl"), 2).alias("avg_pnl"))


@query("D03_by_exit_reason", f"{_TRADES} SELECT exit_reason, count(*) AS n, round(sum(pnl), 2) AS total_pnl FROM tr GROUP BY exit_reason")
def _d03(spark, sf_dir):
    return round_trips(spark, sf_dir).groupBy("exit_reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pnl"), 2).alias("total_pnl"))


@query("D04_performance", f"""WITH {_EQ}, c AS (SELECT date, equity, b, coalesce(equity / lag(equity) OVER (ORDER BY date) - 1, 0) AS r, greatest(max(equity) OVER (ORDER BY date), 1e6) AS peak FROM eq),
  a AS (SELECT count(*) AS n, arg_max(equity, date) / 1e6 - 1 AS total_return, avg(r) AS mean, stddev_samp(r) AS vol, stddev_samp(CASE WHEN r < 0 THEN r END) AS down, min(equity / peak - 1) AS dd, avg(r - b) AS active, stddev_samp(r - b) AS te, covar_samp(r, b) / var_samp(b) AS beta, exp(sum(ln(1 + b))) - 1 AS bench_return FROM c)
  SELECT n, round(total_return, 6) AS total_return, round(pow(1 + total_return, 12.0 / n) - 1, 6) AS annual_return, round(vol, 6) AS volatility, round(mean / (vol + 1e-10) * sqrt(12), 6) AS sharpe, round(mean / (down + 1e-10) * sqrt(12), 6) AS sortino, round(dd, 6) AS max_drawdown,
  round((pow(1 + total_return, 12.0 / n) - 1) / abs(dd), 6) AS calmar, round(bench_return, 6) AS bench_return, round(total_return - bench_return, 6) AS excess_return, round(beta, 6) AS beta, round(te * sqrt(12), 6) AS tracking_error, round(active / (te + 1e-10) * sqrt(12), 6) AS information_ratio FROM a""")
def _d04(spark, sf_dir):
    return rounded(metrics.performance(equity(spark, sf_dir).withColumn("k", F.lit(0)), ["k"], 1e6, 12).drop("k"))


_TURN = f"{_W}, turn AS (SELECT date, 0.5 * sum(abs(weight - coalesce(pw, 0))) AS turnover FROM (SELECT *, lag(weight) OVER ({S}) AS pw FROM weights) GROUP BY date)"


@query("D05_turnover", f"WITH {_TURN} SELECT date, round(turnover, 6) AS turnover FROM turn")
def _d05(spark, sf_dir):
    return rounded(metrics.turnover(aligned_weights(spark, sf_dir)))


_FILLS = "fills AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS margin FROM orders)"


def _fills(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("date"), F.when(C("o_orderkey") % 13 != 0, C("o_totalprice")).alias("margin"))


@query("D06_fill_turnover", f"WITH {_EQ}, {_FILLS}, t AS (SELECT date, sum(margin) AS m FROM fills WHERE margin > 0 GROUP BY date) SELECT date, round(coalesce(m / (2 * abs(equity)), 0), 6) AS turnover FROM eq LEFT JOIN t USING (date)")
def _d06(spark, sf_dir):
    return rounded(metrics.traded_turnover(_fills(spark, sf_dir), equity(spark, sf_dir).select("date", "equity")))


@query("D07_trade_turnover", f"WITH {_EQ}, {_FILLS}, legs AS (SELECT * FROM fills UNION ALL SELECT CAST(date + INTERVAL 2 MONTH AS DATE), margin * 1.01 FROM fills), t AS (SELECT date, sum(margin) AS m FROM legs WHERE margin > 0 GROUP BY date) SELECT date, round(coalesce(m / (2 * abs(equity)), 0), 6) AS turnover FROM eq LEFT JOIN t USING (date)")
def _d07(spark, sf_dir):
    entry = _fills(spark, sf_dir)
    exits = entry.select(F.add_months("date", 2).alias("date"), (C("margin") * 1.01).alias("margin"))
    return rounded(metrics.traded_turnover(entry.unionByName(exits), equity(spark, sf_dir).select("date", "equity")))


@query("D08_buy_and_hold", f"WITH bars AS ({BARS}) SELECT symbol, CASE WHEN count(*) >= 2 AND arg_min(close, date) > 0 THEN round(arg_max(close, date) / arg_min(close, date) - 1, 6) END AS ret FROM bars GROUP BY symbol")
def _d08(spark, sf_dir):
    first, last = F.min_by("close", "date"), F.max_by("close", "date")
    return bars(spark, sf_dir).groupBy("symbol").agg(r6(F.when((F.count(F.lit(1)) >= 2) & (first > 0), F.try_divide(last, first) - 1)).alias("ret"))


_PORT = f"""{PANEL}, {_RET}, w AS (SELECT s_suppkey AS symbol, (s_suppkey % 7 + 1) / sum(s_suppkey % 7 + 1) OVER () AS w FROM supplier),
port AS (SELECT date, sum(w * ret) AS r FROM rets JOIN w USING (symbol) GROUP BY date)"""


def holdings_weights(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    total = s.agg(F.sum(C("s_suppkey") % 7 + 1).alias("t"))
    return s.join(F.broadcast(total)).select(C("s_suppkey").alias("symbol"), ((C("s_suppkey") % 7 + 1) / C("t")).alias("w"))


def portfolio_returns(spark, sf_dir) -> DataFrame:
    return returns(spark, sf_dir).join(holdings_weights(spark, sf_dir), "symbol").groupBy("date").agg(F.sum(C("w") * C("ret")).alias("r"))


@query("D10_concentration", "WITH w AS (SELECT (s_suppkey % 7 + 1) / sum(s_suppkey % 7 + 1) OVER () AS w, row_number() OVER (ORDER BY s_suppkey % 7 DESC, s_suppkey) AS k FROM supplier) SELECT round(sum(w * w), 6) AS hhi, round(1 / sum(w * w), 6) AS effective_n, round(max(w), 6) AS top1, round(sum(CASE WHEN k <= 3 THEN w END), 6) AS top3 FROM w")
def _d10(spark, sf_dir):
    w = holdings_weights(spark, sf_dir)
    top = w.orderBy(F.desc("w")).limit(3).agg(F.sum("w").alias("top3"))
    return rounded(w.agg(F.sum(C("w") * C("w")).alias("hhi"), (1 / F.sum(C("w") * C("w"))).alias("effective_n"), F.max("w").alias("top1")).join(F.broadcast(top)))


@query("D11_drawdown", f"WITH {_PORT}, c AS (SELECT date, exp(sum(ln(1 + r)) OVER (ORDER BY date)) AS e FROM port), d AS (SELECT date, e, e / greatest(max(e) OVER (ORDER BY date), 1) - 1 AS dd FROM c), t AS (SELECT arg_min(date, (dd, date)) AS trough, min(dd) AS dd FROM d) SELECT round(t.dd, 6) AS max_drawdown, t.trough, CASE WHEN max(c.e) < 1 THEN min(c.date) ELSE arg_max(c.date, (c.e, -epoch(c.date))) END AS start FROM t JOIN c ON c.date <= t.trough GROUP BY ALL")
def _d11(spark, sf_dir):
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    c = portfolio_returns(spark, sf_dir).select("date", F.exp(F.sum(F.log(1 + C("r"))).over(w)).alias("e"))
    d = c.withColumn("dd", C("e") / F.greatest(F.max("e").over(w), F.lit(1.0)) - 1)
    t = d.agg(F.min_by("date", F.struct("dd", "date")).alias("trough"), F.min("dd").alias("max_drawdown"))
    # one row beside one short series
    out = c.join(F.broadcast(t), C("date") <= C("trough")).groupBy("max_drawdown", "trough").agg(F.max("e").alias("top"), F.min("date").alias("first"), F.max_by("date", F.struct("e", F.negative(F.unix_date("date")))).alias("at"))
    return rounded(out.select("max_drawdown", "trough", F.when(C("top") < 1, C("first")).otherwise(C("at")).alias("start")))


@query("D12_tail_risk", f"WITH {_PORT}, v AS (SELECT quantile_cont(-r, 0.95) AS v FROM port) SELECT round(v, 6) AS var, round(avg(-r), 6) AS es FROM port, v WHERE -r >= v GROUP BY v")
def _d12(spark, sf_dir):
    return rounded(metrics.tail_risk(portfolio_returns(spark, sf_dir).withColumn("k", F.lit(0)), ["k"], 0.95).drop("k"))


@query("D13_diversification", f"WITH {_PORT}, v AS (SELECT symbol, stddev_samp(ret) AS v FROM rets GROUP BY symbol) SELECT round((SELECT sum(w * v) FROM v JOIN w USING (symbol)) / stddev_samp(r), 6) AS ratio FROM port")
def _d13(spark, sf_dir):
    v = returns(spark, sf_dir).groupBy("symbol").agg(F.stddev_samp("ret").alias("v")).join(holdings_weights(spark, sf_dir), "symbol").agg(F.sum(C("w") * C("v")).alias("a"))
    p = portfolio_returns(spark, sf_dir).agg(F.stddev_samp("r").alias("p"))
    return rounded(v.join(F.broadcast(p)).select(F.try_divide("a", "p").alias("ratio")))


_SECTOR = f"""{PANEL}, {_RET}, sr AS (SELECT s_nationkey AS sector, date, avg(ret) AS r FROM rets JOIN supplier ON s_suppkey = symbol GROUP BY ALL)"""


def sector_returns(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("symbol"), C("s_nationkey").alias("sector"))
    return returns(spark, sf_dir).join(s, "symbol").groupBy("sector", "date").agg(F.avg("ret").alias("r"))


@query("D14_correlation", f"WITH {_SECTOR}, p AS (SELECT a.sector AS a, b.sector AS b, corr(a.r, b.r) AS c FROM sr a JOIN sr b ON a.date = b.date AND a.sector < b.sector GROUP BY ALL) SELECT round(avg(abs(c)), 6) AS avg_abs, round(max(abs(c)), 6) AS top, count(*) AS pairs FROM p")
def _d14(spark, sf_dir):
    from ..operators.pairs import correlations

    c = correlations(sector_returns(spark, sf_dir), "sector")
    return rounded(c.agg(F.avg(F.abs("corr")).alias("avg_abs"), F.max(F.abs("corr")).alias("top"), F.count(F.lit(1)).alias("pairs")))


@query("D09_risk_xray", f"WITH {_PORT}, a AS (SELECT stddev_samp(r) * sqrt(12) AS vol, quantile_cont(-r, 0.99) AS var99, count(*) AS n FROM port), h AS (SELECT sum(w * w) AS hhi FROM w) SELECT n, round(vol, 6) AS vol, round(var99, 6) AS var99, round(hhi, 6) AS hhi FROM a, h")
def _d09(spark, sf_dir):
    a = portfolio_returns(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp("r") * 12**0.5).alias("vol"), F.percentile(-C("r"), F.lit(0.99)).alias("var99"))
    return rounded(a.join(F.broadcast(holdings_weights(spark, sf_dir).agg(F.sum(C("w") * C("w")).alias("hhi")))))


@query("D15_average_weights", f"WITH {_W} SELECT symbol, round(avg(weight), 6) AS weight FROM weights GROUP BY symbol HAVING avg(weight) > 0")
def _d15(spark, sf_dir):
    return rounded(aligned_weights(spark, sf_dir).groupBy("symbol").agg(F.avg("weight").alias("weight")).filter("weight > 0"))


@query("D16_rebalance_notes", f"""WITH {_W}, m AS (SELECT symbol, date, weight, coalesce(lag(weight) OVER ({S}), 0) AS before FROM weights), n AS (SELECT *, weight - before AS move, row_number() OVER (PARTITION BY date ORDER BY round(abs(weight - before), 9) DESC, symbol) AS k FROM m)
  SELECT date, round(0.5 * sum(abs(move)), 6) AS turnover, sum(CASE WHEN abs(before) <= 1e-9 AND abs(weight) > 1e-9 THEN 1 ELSE 0 END)::BIGINT AS entries, sum(CASE WHEN abs(before) > 1e-9 AND abs(weight) <= 1e-9 THEN 1 ELSE 0 END)::BIGINT AS exits, string_agg(CASE WHEN k <= 3 THEN CAST(symbol AS VARCHAR) END, ',' ORDER BY k) AS top FROM n GROUP BY date HAVING sum(abs(move)) > 1e-9""")
def _d16(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("date")
    m = aligned_weights(spark, sf_dir).withColumn("before", F.coalesce(F.lag("weight").over(w), F.lit(0.0))).withColumn("move", C("weight") - C("before"))
    m = m.withColumn("k", F.row_number().over(Window.partitionBy("date").orderBy(F.round(F.abs("move"), 9).desc(), "symbol")))
    held, had = F.abs("weight") > 1e-9, F.abs("before") > 1e-9
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(C("k") <= 3, F.struct("k", "symbol")))), lambda s: s["symbol"].cast("string")), ",")
    out = m.groupBy("date").agg((0.5 * F.sum(F.abs("move"))).alias("turnover"), F.sum((held & ~had).cast("long")).alias("entries"), F.sum((had & ~held).cast("long")).alias("exits"), top.alias("top"))
    return rounded(out.filter("turnover > 5e-10"))


@query("D36_walk_forward", f"""WITH {_EQ}, c AS (SELECT *, coalesce(equity / lag(equity) OVER (ORDER BY date) - 1, 0) AS r, (row_number() OVER (ORDER BY date) - 1) * 5 // count(*) OVER () AS win FROM eq),
  d AS (SELECT *, equity / max(equity) OVER (PARTITION BY win ORDER BY date) - 1 AS dd FROM c) SELECT win AS "window", count(*) AS n, round(arg_max(equity, date) / arg_min(equity, date) - 1, 6) AS ret, round(avg(r) / (stddev_samp(r) + 1e-10) * sqrt(12), 6) AS sharpe, round(min(dd), 6) AS max_drawdown FROM d GROUP BY win""")
def _d36(spark, sf_dir):
    w = Window.partitionBy(F.lit(0))
    e = equity(spark, sf_dir)
    r = F.coalesce(F.try_divide(C("equity"), F.lag("equity").over(w.orderBy("date"))) - 1, F.lit(0.0))
    e = e.withColumn("r", r).withColumn("window", F.floor((F.row_number().over(w.orderBy("date")) - 1) * 5 / F.count(F.lit(1)).over(w)).cast("long"))
    e = e.withColumn("dd", C("equity") / F.max("equity").over(Window.partitionBy("window").orderBy("date")) - 1)
    return rounded(e.groupBy("window").agg(F.count(F.lit(1)).alias("n"), (F.max_by("equity", "date") / F.min_by("equity", "date") - 1).alias("ret"), (F.avg("r") / (F.stddev_samp("r") + 1e-10) * 12**0.5).alias("sharpe"), F.min("dd").alias("max_drawdown")))


# ---- drawdowns and regimes of equity curves, one per symbol

_SYM = f"{PANEL}, {_RET}, se AS (SELECT symbol, date, round(exp(sum(ln(1 + ret)) OVER ({S})), 9) AS equity FROM rets)"


def symbol_equity(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    return returns(spark, sf_dir).select("symbol", "date", F.round(F.exp(F.sum(F.log(1 + C("ret"))).over(w)), 9).alias("equity"))


_DD = f"{_SYM}, dd AS (SELECT symbol, date, equity, 1 - equity / max(equity) OVER ({S}) AS dd FROM se)"


@query("E43_drawdown_series", f"WITH {_DD} SELECT symbol, date, round(dd, 6) AS dd FROM dd")
def _e43(spark, sf_dir):
    return rounded(metrics.curve(symbol_equity(spark, sf_dir), ["symbol"]).select("symbol", "date", (-C("dd")).alias("dd")))


@query("E44_ulcer_index", f"WITH {_DD} SELECT symbol, round(sqrt(avg(dd * dd)), 6) AS ulcer FROM dd GROUP BY symbol")
def _e44(spark, sf_dir):
    return rounded(metrics.curve(symbol_equity(spark, sf_dir), ["symbol"]).groupBy("symbol").agg(F.sqrt(F.avg(C("dd") * C("dd"))).alias("ulcer")))


@query("E45_pain_index", f"WITH {_DD} SELECT symbol, round(avg(dd), 6) AS pain FROM dd GROUP BY symbol")
def _e45(spark, sf_dir):
    return rounded(metrics.curve(symbol_equity(spark, sf_dir), ["symbol"]).groupBy("symbol").agg(F.avg(-C("dd")).alias("pain")))


_EPI = f"""{_SYM}, p AS (SELECT *, max(equity) OVER ({S}) AS peak, lag(date) OVER ({S}) AS before, lead(date) OVER ({S}) AS after FROM se),
q AS (SELECT *, sum(CASE WHEN equity >= peak THEN 1 ELSE 0 END) OVER ({S}) AS episode FROM p),
epi AS (SELECT symbol, episode, min(before) AS peak_date, arg_min(date, (equity, date)) AS trough_date, arg_max(after, date) AS recovery_date, 1 - min(equity / peak) AS depth, count(*) + 1 AS bars,
  max(after IS NULL) AS open FROM q WHERE equity < peak GROUP BY symbol, episode)"""
_REC = "CASE WHEN open THEN NULL ELSE recovery_date END"


@query("E46_drawdown_episodes", f"WITH {_EPI} SELECT symbol, episode::BIGINT AS episode, peak_date, trough_date, {_REC} AS recovery_date, round(depth, 6) AS depth, CASE WHEN open THEN NULL ELSE bars END AS bars FROM epi")
def _e46(spark, sf_dir):
    return rounded(metrics.drawdown_episodes(symbol_equity(spark, sf_dir), ["symbol"]))


@query("E47_max_drawdown", f"WITH {_EPI}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY depth DESC, episode) AS k FROM epi) SELECT symbol, peak_date, trough_date, {_REC} AS recovery_date, round(depth, 6) AS depth FROM k WHERE k = 1")
def _e47(spark, sf_dir):
    d = metrics.drawdown_episodes(symbol_equity(spark, sf_dir), ["symbol"])
    best = d.groupBy("symbol").agg(F.max_by(F.struct("peak_date", "trough_date", "recovery_date", "depth"), F.struct("depth", -C("episode"))).alias("x"))
    return rounded(best.select("symbol", "x.*"))
