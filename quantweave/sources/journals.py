"""Trade journals: broker layouts told apart by their columns, and their rows in one form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns by which a layout is known (any one of the sets), and what its columns mean. Fees add up.
SIGNATURES = {
    "tonghuashun": ({"成交时间", "证券代码", "操作"},),
    "eastmoney": ({"买卖标志", "股票代码"}, {"买卖标志", "成交均价"}),
    "futu": ({"Date", "Symbol", "Side"}, {"Date", "Symbol", "Direction"}),
}
COLUMNS = {
    "tonghuashun": {"time": ("成交时间",), "symbol": ("证券代码",), "name": ("证券名称",), "side": ("操作",), "quantity": ("成交数量",), "price": ("成交价格",), "amount": ("成交金额",), "fee": ("手续费", "印花税", "过户费")},
    "eastmoney": {"date": ("成交日期",), "time": ("成交时间",), "symbol": ("股票代码",), "name": ("股票名称",), "side": ("买卖标志",), "quantity": ("成交数量",), "price": ("成交均价",), "amount": ("成交金额",), "fee": ("佣金", "印花税")},
    "futu": {"date": ("Date",), "time": ("Time",), "symbol": ("Symbol",), "name": ("Name",), "side": ("Side", "Direction"), "quantity": ("Quantity",), "price": ("Price",), "amount": ("Amount",), "fee": ("Commission", "Platform Fee"), "market": ("Market",)},
    "generic": {"time": ("datetime", "time", "date"), "symbol": ("symbol", "ticker", "code"), "name": ("name", "instrument"), "side": ("side", "direction", "action"), "quantity": ("quantity", "qty", "size", "volume"), "price": ("price",), "amount": ("amount", "value", "notional"), "fee": ("fee", "commission", "fees")},
}
#: How sides are written. Anything else is no side.
BUY = ("buy", "b", "purchase", "buy to cover", "buy-to-cover", "buy_to_cover", "买入", "证券买入", "融资买入", "做多", "long")
SELL = ("sell", "s", "sell short", "sell-short", "sell_short", "卖出", "证券卖出", "融券卖出", "做空", "short")
#: First digit of a mainland code -> its exchange; currency marks that may stand around a number.
EXCHANGES = {"6": ".SH", "0": ".SZ", "3": ".SZ", "4": ".BJ", "8": ".BJ"}
CURRENCY = r"(?i)(?<![A-Za-z])(?:USDT|USDC|USD|EUR|GBP|JPY|CNY|HKD)(?![A-Za-z])"
SIGNS = "$€£¥￥"
HINTS = {"hk": "hk", "us": "us", "cn": "china_a"}


def detect_format(columns: Sequence[str]) -> str | None:
    """The layout of these columns: a broker's by exact names, else generic by a time and a symbol in any case; None if unknown."""
    have = {c.strip() for c in columns}
    for name, options in SIGNATURES.items():
        if any(needed <= have for needed in options):
            return name
    lower = {c.lower() for c in have}
    return "generic" if lower & set(COLUMNS["generic"]["time"]) and lower & set(COLUMNS["generic"]["symbol"]) else None


def text(c: Column) -> Column:
    """A trimmed text; null if blank."""
    t = F.trim(c.cast("string"))
    return F.when(t != "", t)


def once(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """These columns as a table of their own, each worked once a row.

    Spark puts what a later filter or step uses in place of its name, once for every use, and all steps into one method,
    which Java leaves uncompiled beyond 8,000 bytes. Neither reaches through a generator.
    """
    return rows.select(F.inline(F.array(F.struct(*columns))))


def number(c: Column, kind: str) -> Column:
    """A column of this type as a number, texts without thousands marks and currency signs; may be null or not finite."""
    if kind in ("tinyint", "smallint", "int", "bigint", "double") or kind.startswith("decimal"):
        return c.cast("double")
    t = c.cast("string")
    plain = F.translate(F.when(t.rlike("[A-Za-z]"), F.regexp_replace(t, CURRENCY, "")).otherwise(t), "−," + SIGNS, "-")
    return F.when(t.rlike("[0-9]"), F.trim(plain).try_cast("double"))  # a text that can't be read costs Java an exception


def finite(x: Column) -> Column:
    """A finite number; 0 if there is none."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(0.0)


def with_base(rows: DataFrame) -> DataFrame:
    """Adds the timestamp `base` of a `date` (ISO text, yyyymmdd, or a spreadsheet's day number) with a `time` of day that is a share of a day.

    A time of day as text is left in `clock`; `day` is its date as text, where that is at hand.
    """
    date, time, n, share, ymd, day = (F.col(c) for c in ("date", "time", "n", "share", "ymd", "day"))
    rows = rows.withColumns({"n": F.when(~date.rlike("[/:-]"), date.try_cast("double")), "share": F.when(~time.rlike("[/:-]"), time.try_cast("double")), "clock": F.when(time.rlike(":"), time)})
    rows = rows.withColumn("ymd", F.when(n.between(19_000_001, 21_001_231), n.cast("long").cast("string")))
    rows = rows.withColumn("day", F.concat(ymd.substr(1, 4), F.lit("-"), ymd.substr(5, 2), F.lit("-"), ymd.substr(7, 2)))
    serial = n + F.when(share.between(0, 0.9999999999), share).otherwise(0.0)
    seconds = F.round((serial - 25569) * 86_400).cast("long")
    return rows.withColumn("base", F.when(n.between(1, 99_999.999999), F.timestamp_seconds(seconds)).otherwise(F.coalesce(day, date).try_cast("timestamp")))


def at_clock(base: Column, day: Column, clock: Column) -> Column:
    """The timestamp with this time of day, if it can be read."""
    whole = F.concat(F.coalesce(day, F.date_format(base, "yyyy-MM-dd")), F.lit(" "), clock).try_cast("timestamp")
    return F.when(clock.isNull(), base).otherwise(F.coalesce(whole, base))


def with_mainland(rows: DataFrame) -> DataFrame:
    """Adds `symbol`, a six-digit `code` with its exchange; codes that name one stay."""
    code, whole, padded = F.col("code"), F.col("whole"), F.col("padded")
    rows = rows.withColumn("whole", code.try_cast("double"))
    rows = rows.withColumn("padded", F.when((whole == F.floor(whole)) & (whole < 10_000_000), whole.cast("long").cast("string")).otherwise(code))
    rows = rows.withColumn("padded", F.when(F.length(padded) < 6, F.lpad(padded, 6, "0")).otherwise(padded))
    exchange = F.coalesce(*[F.when(padded.startswith(d), e) for d, e in EXCHANGES.items()], F.lit(""))
    return rows.withColumn("symbol", F.when(padded.contains("."), F.upper(padded)).otherwise(F.concat(padded, exchange)))


def market_of(symbol: Column) -> Column:
    pair = symbol.rlike("[-/]") & symbol.rlike("USDT|USDC|BTC|USD")
    return (
        F.when(symbol.endswith(".HK"), "hk").when(symbol.rlike(r"\.(SH|SZ|BJ)$"), "china_a").when(pair | symbol.rlike(r"^\p{L}{2,}(USDT|USDC|BUSD)$"), "crypto")
        .when(symbol.rlike(r"^\p{L}+$"), "us").otherwise("other")
    )


def parse_journal(rows: DataFrame, columns: Mapping[str, Sequence[str]] | None = None, sides: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): ts, symbol, name, side, quantity, price, amount, fee, market of a journal.

    The layout is known by the columns, or given as `columns` (meaning -> names). A missing amount is quantity times
    price; where only the amount is given, the price follows. Rows without a symbol are no trades and are dropped.
    Rejected are rows, as they came and with a `reason`, whose side is missing or none of the known ones (`sides` adds
    to them), or whose time can't be read.
    """
    layout = None if columns else detect_format(rows.columns)
    if not columns and layout is None:
        raise ValueError("unknown layout")
    exact = layout in SIGNATURES
    have = {(c.strip() if exact else c.strip().lower()): c for c in rows.columns}
    meaning = columns or COLUMNS[layout]

    def every(k: str) -> list[str]:
        return [have[c] for c in meaning.get(k, ()) if c in have]

    def first(k: str) -> Column:
        return next((F.col(f"`{c}`") for c in every(k)), F.lit(None).cast("string"))

    if not every("side"):
        raise ValueError("a journal needs a column of sides")
    known = {s: "buy" for s in BUY} | {s: "sell" for s in SELL} | {k.lower(): v for k, v in (sides or {}).items()}
    dated, types = bool(meaning.get("date")), dict(rows.dtypes)
    numbers = {k: (every(k) or [None])[0] for k in ("quantity", "price", "amount")} | {f"fee{i}": c for i, c in enumerate(every("fee"))}
    texts = [
        text(first("symbol")).alias("code"), F.coalesce(text(first("name")), F.lit("")).alias("name"), F.lower(text(first("side"))).alias("given"), text(first("date" if dated else "time")).alias("date"),
        (text(first("time")) if dated else F.lit(None).cast("string")).alias("time"), F.lower(text(first("market"))).alias("hint"), *[(F.col(f"`{c}`") if c else F.lit(None).cast("double")).alias(k) for k, c in numbers.items()],
    ]
    given = F.col("given")
    side = F.when(given.isin([s for s, v in known.items() if v == "buy"]), "buy").when(given.isin([s for s, v in known.items() if v == "sell"]), "sell")

    bad = once(rows, F.struct(*[F.col(f"`{c}`") for c in rows.columns if c.lower() != "reason"]).alias("row"), *texts).filter("code is not null").withColumn("side", side)
    reason = F.when(given.isNull(), "no side").when(F.col("side").isNull(), "unknown side").when(F.col("base").isNull(), "no time")
    bad = once(with_base(bad), "row", reason.alias("reason")).filter("reason is not null").select("row.*", "reason")

    # Rows without a known side leave before the rest is worked.
    traded = rows.filter(F.lower(F.trim(F.col(f"`{every('side')[0]}`").cast("string"))).isin(list(known)))
    good = once(traded, *texts).filter("code is not null").withColumn("side", side).filter("side is not null")
    good = once(good, "code", "name", "side", "hint", "date", "time", *[number(F.col(k), types[c] if c else "double").alias(k) for k, c in numbers.items()])
    good = with_base(good.withColumns({k: finite(F.col(k)) for k in numbers}))
    good = once(good, "code", "name", "side", "hint", "base", "day", "clock", *numbers).filter("base is not null")
    mainland = layout in ("tonghuashun", "eastmoney")
    good = with_mainland(good) if mainland else good.withColumn("symbol", F.upper("code"))
    symbol, hint, quantity, price, amount = (F.col(c) for c in ("symbol", "hint", "quantity", "price", "amount"))
    market = F.lit("china_a") if mainland else market_of(symbol)
    if meaning.get("market"):
        market = F.coalesce(*[F.when(hint == h, m) for h, m in HINTS.items()], F.when(symbol.endswith(".HK"), "hk").when(~symbol.contains("."), "us").otherwise("other"))
    good = good.select(
        at_clock(F.col("base"), F.col("day"), F.col("clock")).alias("ts"), "symbol", "name", "side", "quantity", F.when(price != 0, price).otherwise(F.coalesce(F.try_divide(amount, quantity), F.lit(0.0))).alias("price"),
        F.when(amount != 0, amount).otherwise(quantity * price).alias("amount"), sum((F.col(k) for k in numbers if k.startswith("fee")), F.lit(0.0)).alias("fee"), market.alias("market"),
    )
    return good, bad
