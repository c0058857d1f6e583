"""Column expressions without windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words of a headline that count for and against, unless others are given.
POSITIVE = (
    "beat", "beats", "surge", "surges", "soar", "record", "growth", "profit", "upgrade", "upgraded", "outperform", "bullish", "approval", "approved", "win", "wins", "buyback", "dividend", "expansion", "breakthrough",
)
NEGATIVE = (
    "miss", "misses", "plunge", "plunges", "fall", "falls", "loss", "losses", "downgrade", "downgraded", "underperform", "bearish", "fraud", "probe", "lawsuit", "recall", "default", "bankruptcy", "halt", "warning", "decline",
)
#: Fixed value: what is trimmed from both ends of a word.
MARKS = ".,;:!?\"'()"


def lexicon_score(text: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    """(positive - negative) / (positive + negative) words, between white space or slashes and without marks around them; 0 without either."""
    words = F.split(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("/"), F.lit(" ")), r"\s+")
    words = F.transform(words, lambda w: F.btrim(w, F.lit(MARKS)))
    n = lambda of: F.size(F.filter(words, lambda w: w.isin(list(of)))).cast("double")
    return F.coalesce(F.try_divide(n(positive) - n(negative), n(positive) + n(negative)), F.lit(0.0))


def knowable_date(published: Column, cutoff_hour: int) -> Column:
    """The day of publication, or the next from the cutoff hour on."""
    return F.date_add(F.to_date(published), F.when(F.hour(published) >= cutoff_hour, 1).otherwise(0))


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def normalize_currency(x: Column) -> Column:
    """Upper-case code of three letters or digits; null if it is none."""
    code = F.upper(F.trim(x))
    return F.when(code.rlike("^[A-Z0-9]{3}$"), code)


def year_fraction(start: Column, end: Column, day_count: str) -> Column:
    """ACT/365, ACT/360, ACT/365.25 or 30/360 (US) fraction of a year."""
    days = F.datediff(end, start)
    if day_count in ("ACT/365", "ACT/360", "ACT/365.25"):
        return days / float(day_count.split("/")[1])
    if day_count == "30/360":
        d1 = F.least(F.dayofmonth(start), F.lit(30))
        d2 = F.when((F.dayofmonth(end) == 31) & (d1 == 30), 30).otherwise(F.dayofmonth(end))
        return ((F.year(end) - F.year(start)) * 360 + (F.month(end) - F.month(start)) * 30 + (d2 - d1)) / 360.0
    raise ValueError(f"unknown day count {day_count}")


#: Bars of a day by interval and source: trading hours differ.
BARS_A_DAY = {"1m": {"cn": 240, "us": 390, "crypto": 1440}, "1H": {"cn": 4, "us": 7, "crypto": 24}, "1D": {"cn": 1, "us": 1, "crypto": 1}}
DAYS_A_YEAR = {"cn": 244, "us": 252, "crypto": 365}


def bars_per_year(interval: Column, source: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, by in BARS_A_DAY.items():
        for s, n in by.items():
            out = F.when((interval == i) & (source == s), n * DAYS_A_YEAR[s]).otherwise(out)
    return out


def _signed(direction: Column) -> Column:
    return F.signum(direction)


def fixed_slippage(price: Column, direction: Column, bps: float) -> Column:
    return price * (1 + _signed(direction) * bps / 10_000)


def linear_impact(price: Column, direction: Column, volume: Column, adv: Column, coefficient: float) -> Column:
    return price * (1 + _signed(direction) * coefficient * F.try_divide(volume, adv))


def sqrt_impact(price: Column, direction: Column, volume: Column, adv: Column, volatility: Column, eta: float) -> Column:
    return price * (1 + _signed(direction) * eta * volatility * F.sqrt(F.try_divide(volume, adv)))


def exact(x: Column) -> Column:
    """A number as a decimal."""
    return x.cast("decimal(38,18)")


def figures(text: Column) -> Column:
    """Numbers in a text, with signs, thousands separators, decimals and a percent sign."""
    return F.regexp_extract_all(text, F.lit(r"[-+]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?"), F.lit(0))


#: Rules of a symbol's market, first match wins.
MARKETS = ((r"\.(SZ|SH|BJ)$", "equity_cn"), (r"\.HK$", "equity_hk"), (r"\.(NS|BO)$", "equity_in"), (r"\.(KS|KQ)$", "equity_kr"), (r"[-/]USDT?$", "crypto"), (r"^[A-Z]{6}$", "forex"), (r"^[A-Z]{1,5}$", "equity_us"))


def infer_market(symbol: Column) -> Column:
    out = F.lit("unknown")
    for pattern, market in reversed(MARKETS):
        out = F.when(F.upper(symbol).rlike(pattern), market).otherwise(out)
    return out


def classify_span(days: Column) -> Column:
    return F.when(days.between(80, 100), "quarter").when(days.between(350, 380), "annual").otherwise("other")


def form_allowed(form: Column, frequency: str) -> Column:
    return form.isin(["10-K", "10-K/A", "20-F"] if frequency == "annual" else ["10-Q", "10-Q/A", "10-K", "10-K/A"])


def first_digit(x: Column) -> Column:
    return F.when(x > 0, F.floor(x / F.pow(F.lit(10.0), F.floor(F.log10(x)))).cast("int"))
