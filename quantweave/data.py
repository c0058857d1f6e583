"""Inputs of the registered queries, derived from the tables: bars, ticks, trades, filings, cash flows.

The same derivations stand here as SQL, for the queries' SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars: a symbol is a supplier, prices are paid per unit, in the order of shipment."""
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", F.trunc("l_shipdate", "month").alias("date"), price.alias("price"), order.alias("at"))
    return rows.groupBy(F.col("l_suppkey").alias("symbol"), "date").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"),
    )


def densify(rows: DataFrame, unit: str = "1 month") -> DataFrame:
    """Every symbol on every date of the shared calendar: a bar that is missing is a row of nulls."""
    span = rows.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    # one wrong date would make a calendar of millions of rows: a span over 500 years is refused
    hi = F.when(F.datediff("hi", "lo") > 500 * 366, F.raise_error(F.lit("the dates span more than 500 years"))).otherwise(F.col("hi"))
    dates = span.select(F.explode(F.sequence("lo", hi, F.expr(f"interval {unit}"))).alias("date"))
    # one calendar, as large as the calendar is long, is sent to the symbols
    grid = rows.select("symbol").distinct().join(F.broadcast(dates))
    return grid.join(rows, ["symbol", "date"], "left")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense monthly bars with the sector (nation) of the symbol."""
    sector = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("sector"))
    return densify(bars(spark, sf_dir)).join(sector, "symbol", "left")


BARS = """
  SELECT l_suppkey AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
    first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    first(l_extendedprice / l_quantity ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC) AS close,
    sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM lineitem GROUP BY ALL"""
PANEL = f"""bars AS ({BARS}),
grid AS (SELECT symbol, CAST(date AS DATE) AS date FROM (SELECT DISTINCT symbol FROM bars) s,
  (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS date FROM bars) d),
panel AS (SELECT g.symbol, g.date, open, high, low, close, volume, amount, s_nationkey AS sector
  FROM grid g LEFT JOIN bars b ON g.symbol = b.symbol AND g.date = b.date LEFT JOIN supplier ON s_suppkey = g.symbol)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"), "event_id", "event_type")


TICKS = "ticks AS (SELECT user_id AS symbol, ts, value AS price, 1.0 AS volume, event_id, event_type FROM events)"


def trades(spark: SparkSession, sf_dir: str, key: str = "l_partkey") -> DataFrame:
    """A trade journal: returned lines are sales, others buys; seq orders trades of a symbol."""
    t = _table(spark, sf_dir, "lineitem")
    rows = t.select(
        F.col(key).alias("symbol"), F.col("l_shipdate").alias("ts"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_extendedprice").alias("amount"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
    )
    w = Window.partitionBy("symbol").orderBy("ts", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "quantity", "amount")
    return rows.withColumn("seq", F.row_number().over(w)).select("symbol", "seq", "ts", "side", "quantity", "price", "amount", "fee")


def trades_sql(key: str = "l_partkey") -> str:
    return f"""trades AS (SELECT {key} AS symbol,
  row_number() OVER (PARTITION BY {key} ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS seq,
  l_shipdate AS ts, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS quantity,
  l_extendedprice / l_quantity AS price, l_extendedprice AS amount, l_extendedprice * l_tax AS fee FROM lineitem)"""


#: Days between an order and its filing, by the first character of its priority.
FILING_DAYS = {"1": 10, "2": 25, "3": 45, "4": 70, "5": 100}


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements: an entity (customer) reports a value for a quarter on a filing date; restatements occur."""
    o = _table(spark, sf_dir, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    days = F.coalesce(*[F.when(first == k, v) for k, v in FILING_DAYS.items()], F.lit(30))
    day = F.to_date("o_orderdate")
    return o.select(
        F.col("o_custkey").alias("entity"), F.last_day(F.add_months(F.trunc(day, "quarter"), 2)).alias("period"), F.date_add(day, days).alias("filed"),
        F.col("o_totalprice").alias("val"), F.col("o_orderkey").alias("filing_id"),
    )


FILINGS = f"""filings AS (SELECT o_custkey AS entity, CAST(last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS period,
  CAST(o_orderdate AS DATE) + CASE substr(o_orderpriority, 1, 1) {" ".join(f"WHEN '{k}' THEN {v}" for k, v in FILING_DAYS.items())} ELSE 30 END AS filed,
  o_totalprice AS val, o_orderkey AS filing_id FROM orders)"""


def cashflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of a fund (customer): F orders are contributions (negative), O distributions, P valuations; currency by nation."""
    o = _table(spark, sf_dir, "orders")
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    kind = F.when(F.col("o_orderstatus") == "F", "contribution").when(F.col("o_orderstatus") == "O", "distribution").otherwise("valuation")
    amount = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"])
    currency = F.concat(F.lit("C"), F.lpad((F.col("c_nationkey") % 5).cast("string"), 2, "0"))
    return rows.select(F.col("o_custkey").alias("fund"), F.to_date("o_orderdate").alias("date"), amount.alias("amount"), kind.alias("kind"), currency.alias("currency"), F.col("o_orderkey").alias("flow_id"))


CASHFLOWS = """cashflows AS (SELECT o_custkey AS fund, CAST(o_orderdate AS DATE) AS date,
  CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amount,
  CASE o_orderstatus WHEN 'F' THEN 'contribution' WHEN 'O' THEN 'distribution' ELSE 'valuation' END AS kind,
  'C' || lpad(CAST(c_nationkey % 5 AS VARCHAR), 2, '0') AS currency, o_orderkey AS flow_id
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate of each currency on the first of every second month in which there are orders."""
    months = _table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("date")).distinct().filter(F.month("date") % 2 == 1)
    base = _table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).alias("k")).distinct()
    rate = 1 + F.col("k") * 0.25 + (F.year("date") * 12 + F.month("date")) % 7 * 0.01
    return months.join(F.broadcast(base)).select(F.concat(F.lit("C"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("base"), "date", rate.alias("rate"))


FX = """fx AS (SELECT 'C' || lpad(CAST(k AS VARCHAR), 2, '0') AS base, date, 1 + k * 0.25 + (year(date) * 12 + month(date)) % 7 * 0.01 AS rate
  FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders) m, (SELECT DISTINCT n_nationkey % 5 AS k FROM nation) n
  WHERE month(date) % 2 = 1)"""


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense weekly bars of part brands (a long calendar of few symbols), with vwap and a sector."""
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = _table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = rows.select(F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("symbol"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), price.alias("price"), order.alias("at"), "l_quantity", "l_extendedprice")
    out = rows.groupBy("symbol", "date").agg(
        F.round(F.min_by("price", "at"), 6).alias("open"), F.round(F.max("price"), 6).alias("high"), F.round(F.min("price"), 6).alias("low"), F.round(F.max_by("price", "at"), 6).alias("close"),
        F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("vwap"), F.round(F.sum("l_extendedprice"), 2).alias("amount"),
    )
    return densify(out, "7 days").withColumn("sector", F.col("symbol") % 5)


WEEKLY = """wb AS (SELECT CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
    round(first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice), 6) AS open,
    round(max(l_extendedprice / l_quantity), 6) AS high, round(min(l_extendedprice / l_quantity), 6) AS low,
    round(first(l_extendedprice / l_quantity ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC), 6) AS close,
    sum(l_quantity) AS volume, round(sum(l_extendedprice) / sum(l_quantity), 6) AS vwap, round(sum(l_extendedprice), 2) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
panel AS (SELECT s.symbol, CAST(d.date AS DATE) AS date, open, high, low, close, volume, vwap, amount, s.symbol % 5 AS sector FROM (SELECT DISTINCT symbol FROM wb) s
  CROSS JOIN (SELECT unnest(generate_series(min(date), max(date), INTERVAL 7 DAY)) AS date FROM wb) d LEFT JOIN wb ON wb.symbol = s.symbol AND wb.date = d.date)"""
