"""Readers and writers of bars, journals, flows and panels, and the cleaning that they share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, str], date_format: str | None = None) -> DataFrame:
    """Bars from CSV files; columns maps a name of ours to the file's."""
    return normalize_columns(spark.read.csv(path, header=True), columns, date_format)


def read_parquet(spark: SparkSession, path: str, columns: Mapping[str, str], date_format: str | None = None) -> DataFrame:
    return normalize_columns(spark.read.parquet(path), columns, date_format)


def read_query(spark: SparkSession, text: str, columns: Mapping[str, str], date_format: str | None = None) -> DataFrame:
    """Bars from SQL over registered views."""
    return normalize_columns(spark.sql(text), columns, date_format)


def normalize_columns(rows: DataFrame, columns: Mapping[str, str], date_format: str | None = None) -> DataFrame:
    """symbol (if mapped), date, prices and volume as doubles; rows without a date or a price are dropped, volume is 0 if missing."""
    source = {name: columns.get(name, name) for name in ("symbol", "date", *PRICES, "volume")}
    have = set(rows.columns)
    missing = [n for n in ("date", *PRICES) if source[n] not in have]
    if missing:
        raise ValueError(f"no columns for {missing}")
    text = F.col(source["date"]).cast("string")
    date = F.try_to_timestamp(text, F.lit(date_format)) if date_format else F.col(source["date"]).try_cast("timestamp")
    number = lambda n: F.col(source[n]).try_cast("double")
    out = rows.select(
        *([F.col(source["symbol"]).alias("symbol")] if source["symbol"] in have else []), date.alias("date"), *[number(n).alias(n) for n in PRICES],
        (F.coalesce(number("volume"), F.lit(0.0)) if source["volume"] in have else F.lit(0.0)).alias("volume"),
    )
    return out.na.drop(subset=["date", *PRICES])


def is_bad_bar(allow_nonpositive: bool = False) -> Column:
    """High below low, prices outside high and low, or prices at or below 0 (with allow_nonpositive: at 0)."""
    o, h, low, c = (F.col(x) for x in PRICES)
    floor = [x == 0 for x in (o, h, low, c)] if allow_nonpositive else [x <= 0 for x in (o, h, low, c)]
    bad = (h < low) | (h < F.greatest(o, c)) | (low > F.least(o, c))
    for x in floor:
        bad = bad | x
    return F.coalesce(bad, F.lit(True))


def validate_ohlc(rows: DataFrame, strategy: str = "drop", allow_nonpositive: bool = False) -> DataFrame:
    """drop bad bars, flag them in a column `invalid`, or raise on the first."""
    bad = is_bad_bar(allow_nonpositive)
    if strategy == "drop":
        return rows.filter(~bad)
    if strategy == "flag":
        return rows.withColumn("invalid", bad)
    if strategy == "raise":
        return rows.filter(F.assert_true(~bad, "bad bar").isNull())
    raise ValueError(f"unknown strategy {strategy}")


#: Intervals by name, in seconds.
INTERVALS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1H": 3600, "4H": 14400, "1D": 86400}


def resample(rows: DataFrame, interval: str, ts: str = "ts", price: Sequence[str] = ("price",) * 4) -> DataFrame:
    """Tumbling bars of ticks or finer bars: symbol, ts (start), open, high, low, close, volume."""
    o, h, low, c = price
    window = F.window(ts, f"{INTERVALS[interval]} seconds")
    at = F.struct(ts, *(["event_id"] if "event_id" in rows.columns else []))
    return rows.groupBy("symbol", window.alias("w")).agg(
        F.min_by(o, at).alias("open"), F.max(h).alias("high"), F.min(low).alias("low"), F.max_by(c, at).alias("close"), F.sum("volume").alias("volume"),
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def median_gap(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """symbol, gap: the median number of seconds between a symbol's rows; what is coarser than an interval isn't resampled to it."""
    w = Window.partitionBy("symbol").orderBy(ts)
    seconds = F.unix_micros(F.col(ts)) / 1e6
    return rows.select("symbol", (seconds - F.lag(seconds).over(w)).alias("g")).groupBy("symbol").agg(F.percentile("g", F.lit(0.5)).alias("gap"))


def forward_adjust(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Prices times factor over the symbol's last factor; a day without a factor takes the last one before it, else the first after."""
    w = Window.partitionBy("symbol").orderBy("date")
    so_far, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    joined = rows.join(factors.select("symbol", "date", "factor"), ["symbol", "date"], "left")
    f = F.coalesce(F.last("factor", True).over(so_far), F.first("factor", True).over(whole), F.lit(1.0))
    filled = joined.withColumn("f", f).withColumn("newest", F.last("f").over(whole))
    ratio = F.try_divide("f", "newest")
    return filled.select("symbol", "date", *[(F.col(p) * ratio).alias(p) for p in PRICES], "volume")


def finite_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose values are all there and finite."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return rows.filter(keep)


def canonical_label(x: Column) -> Column:
    """snake_case from any spelling."""
    return F.regexp_replace(F.lower(F.trim(x)), r"[\s_-]+", "_")


CASHFLOW_ALIASES = {
    "date": ("date", "value_date", "posting_date"),
    "amount": ("amount", "cash_amount", "value"),
    "kind": ("kind", "type", "category"),
    "currency": ("currency", "ccy"),
}


def load_cashflows(rows: DataFrame, currency: str | None = None, default_kind: str = "other", decimal: str = ".", invert: bool = False, date_format: str = "yyyy-MM-dd") -> tuple[DataFrame, DataFrame]:
    """(good, rejected) flows from raw text columns: date, amount, kind, currency; what isn't named is kept in a map."""
    by_label = {c.strip().lower().replace(" ", "_"): c for c in rows.columns}
    found = {k: next((by_label[a] for a in names if a in by_label), None) for k, names in CASHFLOW_ALIASES.items()}
    rest = [c for c in rows.columns if c not in found.values()]
    text = F.trim(F.col(found["amount"]).cast("string"))
    text = F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".") if decimal == "," else F.regexp_replace(text, ",", "")
    amount = text.try_cast("double") * (-1 if invert else 1)
    out = rows.select(
        F.to_date(F.try_to_timestamp(F.col(found["date"]).cast("string"), F.lit(date_format))).alias("date"), amount.alias("amount"),
        (F.coalesce(canonical_label(F.col(found["kind"])), F.lit(default_kind)) if found["kind"] else F.lit(default_kind)).alias("kind"),
        (F.upper(F.trim(F.col(found["currency"]))) if found["currency"] else F.lit(currency)).alias("currency"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(c).cast("string") for c in rest])).alias("metadata"),
    )
    good = F.col("date").isNotNull() & F.col("amount").isNotNull() & F.coalesce(F.col("currency").rlike("^[A-Z0-9]{3}$"), F.lit(False))
    if currency:
        good = good & (F.col("currency") == currency)
    return out.filter(good), out.filter(~good)


def melt_panel(rows: DataFrame, ids: Sequence[str], name: str = "metric") -> DataFrame:
    """Wide to long: ids, metric, value; blank cells are dropped."""
    values = [c for c in rows.columns if c not in ids]
    return rows.unpivot(list(ids), values, name, "value").na.drop(subset=["value"])


def long_panel(rows: DataFrame, keys: Sequence[str] = ("entity_id", "date", "metric")) -> tuple[DataFrame, DataFrame]:
    """(panel, duplicates): rows whose keys are there once, and keys that are there more often with their count."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    twice = n.filter("n > 1")
    return rows.join(twice.select(*keys), list(keys), "left_anti"), twice


def write_artifacts(frames: Mapping[str, DataFrame], folder: str, form: str = "parquet", partition_by: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """Each frame in a folder of its name; the paths."""
    out = []
    for name, df in frames.items():
        writer = df.write.mode("overwrite").format(form)
        if by := (partition_by or {}).get(name):
            writer = writer.partitionBy(*by)
        writer = writer.option("header", True) if form == "csv" else writer
        writer.save(f"{folder}/{name}")
        out.append(f"{folder}/{name}")
    return out


EQUITY_ALIASES = {"date": ("date", "timestamp", "time"), "equity": ("equity", "value", "nav"), "benchmark": ("benchmark", "bench_equity"), "exposure": ("exposure", "invested")}


def read_equity(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): date, equity, benchmark, exposure from aliased columns; unusable rows apart."""
    lower = {c.lower(): c for c in rows.columns}
    pick = {k: next((lower[a] for a in names if a in lower), None) for k, names in EQUITY_ALIASES.items()}
    out = rows.select(*[(F.col(pick[k]).try_cast("timestamp" if k == "date" else "double") if pick[k] else F.lit(None).cast("double")).alias(k) for k in EQUITY_ALIASES])
    good = F.col("date").isNotNull() & F.col("equity").isNotNull() & ~F.isnan("equity") & (F.abs("equity") < float("inf"))
    return out.filter(good), out.filter(~F.coalesce(good, F.lit(False)))


FACTS = "map<string, map<string, struct<units: map<string, array<struct<start: string, end: string, filed: string, val: double, form: string>>>>>>"


def concept_series(facts: DataFrame, concepts: Sequence[str], pit: bool = True, taxonomy: str = "us-gaap") -> DataFrame:
    """entity, start, end, filed, val from nested company facts (JSON in `facts`): of a period the first filing (pit) or the last;
    among concepts the earlier of the list."""
    tree = F.from_json("facts", FACTS)
    rows = facts.select("entity", F.explode(F.map_filter(tree[taxonomy], lambda k, v: k.isin(list(concepts)))).alias("concept", "body"))
    rows = rows.select("entity", "concept", F.explode("body.units").alias("unit", "points"))
    rows = rows.select("entity", F.array_position(F.array(*[F.lit(c) for c in concepts]), F.col("concept")).alias("priority"), F.inline("points"))
    order = [F.col("filed") if pit else F.desc("filed"), F.col("priority"), F.col("val")]
    w = Window.partitionBy("entity", "start", "end").orderBy(*order)
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select("entity", "start", "end", "filed", "val")


#: The elements of a fund's portfolio report, nested as they are filed. Identifiers are attributes.
_VALUED = "struct<_value: string>"
PORTFOLIO_XML = (
    "formData struct<genInfo: struct<regName: string, seriesId: string, seriesName: string, repPdDate: string, repPdEnd: string>, fundInfo: struct<totAssets: string, netAssets: string>, "
    f"invstOrSecs: struct<invstOrSec: array<struct<name: string, title: string, cusip: string, identifiers: struct<isin: {_VALUED}, ticker: {_VALUED}>, balance: string, units: string, curCd: string, "
    "valUSD: string, pctVal: string, payoffProfile: string, assetCat: string, issuerCat: string, invCountry: string>>>>"
)
#: The elements of an information table of institutional holdings.
INFO_XML = (
    "infoTable array<struct<nameOfIssuer: string, titleOfClass: string, cusip: string, value: string, shrsOrPrnAmt: struct<sshPrnamt: string, sshPrnamtType: string>, putCall: string, "
    "investmentDiscretion: string, otherManager: string, votingAuthority: struct<Sole: string, Shared: string, None: string>>>"
)
_ANY_NAMESPACE = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def _text(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def parse_holdings(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """Holdings out of fund portfolio reports (one XML text a row, with its id): what the fund is, and a row a holding.

    What a filer left out is null. Texts that are no XML have no holdings.
    """
    x = F.from_xml(F.col(xml), PORTFOLIO_XML, _ANY_NAMESPACE)["formData"]
    general = rows.select("id", x.alias("x")).select(
        "id", _text(F.col("x.genInfo.seriesId")).alias("series_id"), _text(F.col("x.genInfo.seriesName")).alias("series_name"), _text(F.col("x.genInfo.regName")).alias("registrant"),
        F.col("x.genInfo.repPdDate").try_cast("date").alias("as_of"), F.col("x.genInfo.repPdEnd").try_cast("date").alias("fiscal_year_end"), _number(F.col("x.fundInfo.netAssets")).alias("net_assets_usd"),
        F.explode("x.invstOrSecs.invstOrSec").alias("h"),
    )
    h = lambda name: F.col(f"h.{name}")
    return general.select(
        "id", "series_id", "series_name", "registrant", "as_of", "fiscal_year_end", "net_assets_usd", _text(h("name")).alias("name"), _text(h("title")).alias("title"), _text(h("cusip")).alias("cusip"),
        _text(h("identifiers.isin._value")).alias("isin"), _text(h("identifiers.ticker._value")).alias("ticker"), _number(h("pctVal")).alias("pct_of_net_assets"), _number(h("valUSD")).alias("value_usd"),
        _number(h("balance")).alias("balance"), _text(h("units")).alias("balance_units"), _text(h("curCd")).alias("currency"), _text(h("payoffProfile")).alias("payoff_profile"),
        _text(h("assetCat")).alias("asset_category"), _text(h("issuerCat")).alias("issuer_category"), _text(h("invCountry")).alias("country"),
    )


def parse_information_table(rows: DataFrame, cusips: Sequence[str] | None = None) -> DataFrame:
    """id, name, title, cusip, value, shares, share_type, put_call, discretion out of information-table XML texts, a row an entry."""
    out = rows.select("id", F.from_xml(F.col("xml"), INFO_XML, _ANY_NAMESPACE).alias("x")).select("id", F.inline("x.infoTable"))
    out = out.select(
        "id", _text(F.col("nameOfIssuer")).alias("name"), _text(F.col("titleOfClass")).alias("title"), F.upper(_text(F.col("cusip"))).alias("cusip"), _number(F.col("value")).alias("value"),
        _number(F.col("shrsOrPrnAmt.sshPrnamt")).alias("shares"), _text(F.col("shrsOrPrnAmt.sshPrnamtType")).alias("share_type"), F.coalesce(_text(F.col("putCall")), F.lit("")).alias("put_call"), _text(F.col("investmentDiscretion")).alias("discretion"),
    )
    return out.filter(F.col("cusip").isin([c.upper() for c in cusips])) if cusips else out


def by_cusip(entries: DataFrame) -> DataFrame:
    """Entries of an information table that were split over managers, one row a position: value and shares add up."""
    return entries.groupBy("id", "cusip", "put_call", "share_type").agg(F.min("name").alias("name"), F.sum("value").alias("value"), F.sum("shares").alias("shares"), F.count("*").alias("entries"))


FEED_XML = "channel struct<item: array<struct<title: string, description: string, pubDate: string>>>"


def parse_feed(rows: DataFrame, cutoff_hour: int, kind: str = "news") -> DataFrame:
    """code, knowable_date, event_type, score, summary out of feed XML texts."""
    from ..functions.scalar import knowable_date, lexicon_score

    items = rows.select("code", F.from_xml("xml", FEED_XML).alias("x")).select("code", F.inline("x.channel.item"))
    at = F.try_to_timestamp("pubDate")
    return items.select("code", knowable_date(at, cutoff_hour).alias("knowable_date"), F.lit(kind).alias("event_type"), lexicon_score(F.concat_ws(" ", "title", "description")).alias("score"), F.col("title").alias("summary"))
