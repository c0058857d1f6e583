"""Time-series operators: Column expressions over a symbol's rows in date order.

Rows are a dense panel: a missing bar is a row of nulls and counts as a bar. Results are null until a window is
full, and where a window has a null, as declared for each operator. No frame is unbounded ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, Window
from pyspark.sql import functions as F

BY, AT = "symbol", "date"


def series() -> WindowSpec:
    return Window.partitionBy(BY).orderBy(AT)


def last(n: int) -> WindowSpec:
    return series().rowsBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, x: Column, n: int) -> Column:
    """value where the last n rows have n values of x."""
    return F.when(F.count(x).over(last(n)) == n, value)


def _positive(n: int, least: int = 1) -> None:
    if n < least:
        raise ValueError(f"the window must be at least {least}, got {n}")


def ts_mean(x: Column, n: int) -> Column:
    _positive(n)
    return full(F.avg(x).over(last(n)), x, n)


def ts_sum(x: Column, n: int) -> Column:
    _positive(n)
    return full(F.sum(x).over(last(n)), x, n)


def ts_std(x: Column, n: int) -> Column:
    _positive(n, 2)
    return full(F.stddev_samp(x).over(last(n)), x, n)


def ts_max(x: Column, n: int) -> Column:
    _positive(n)
    return full(F.max(x).over(last(n)), x, n)


def ts_min(x: Column, n: int) -> Column:
    _positive(n)
    return full(F.min(x).over(last(n)), x, n)


def window_values(x: Column, n: int) -> Column:
    """The last n values, oldest first (nulls are left out)."""
    return F.collect_list(x).over(last(n))


#: Up to this length a window is compared term by term, which stays in generated code; beyond it an array is faster.
TERMS = 12


def ts_rank(x: Column, n: int) -> Column:
    """Percentile rank of the newest value in its window; ties take the mean rank."""
    _positive(n)
    if n <= TERMS:
        # twice as much for a smaller value as for an equal one
        before = [F.lag(x, k).over(series()) for k in range(1, n)]
        points = sum((F.when(b < x, 2).when(b == x, 1).otherwise(0) for b in before), F.lit(0))
        return full((points * 0.5 + 1) / n, x, n)
    values = window_values(x, n)
    less = F.size(F.filter(values, lambda v: v < x))
    equal = F.size(F.filter(values, lambda v: v == x))
    return full((less + 0.5 * (equal + 1)) / n, x, n)


def _both(x: Column, y: Column) -> tuple[Column, Column]:
    """x and y on rows that have both."""
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def ts_cov(x: Column, y: Column, n: int) -> Column:
    _positive(n, 2)
    x, y = _both(x, y)
    return full(F.covar_samp(x, y).over(last(n)), x, n)


def ts_corr(x: Column, y: Column, n: int) -> Column:
    """Pearson correlation; null where either side is constant in the window."""
    _positive(n, 2)
    x, y = _both(x, y)
    w = last(n)
    moves = (F.min(x).over(w) < F.max(x).over(w)) & (F.min(y).over(w) < F.max(y).over(w))
    spread = F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)
    return full(F.when(moves & (spread > 0), F.try_divide(F.covar_samp(x, y).over(w), spread)), x, n)


def ts_argmax(x: Column, n: int) -> Column:
    """Place of the largest value in the window from the oldest (0); the earliest of equals."""
    _positive(n)
    if n <= TERMS:
        return _place_of(F.max(x).over(last(n)), x, n)
    values = window_values(x, n)
    return full((F.array_position(values, F.array_max(values)) - 1).cast("double"), x, n)


def _place_of(best: Column, x: Column, n: int) -> Column:
    """Place of the first value of the window that equals `best`."""
    return full(F.coalesce(*[F.when(F.lag(x, n - 1 - k).over(series()) == best, float(k)) for k in range(n)]), x, n)


def ts_argmin(x: Column, n: int) -> Column:
    _positive(n)
    if n <= TERMS:
        return _place_of(F.min(x).over(last(n)), x, n)
    values = window_values(x, n)
    return full((F.array_position(values, F.array_min(values)) - 1).cast("double"), x, n)


def ts_quantile(x: Column, q: float, n: int) -> Column:
    """Quantile with linear interpolation."""
    _positive(n)
    return full(F.percentile(x, F.lit(q)).over(last(n)), x, n)


def ts_skew(x: Column, n: int) -> Column:
    """Sample skewness, adjusted for bias."""
    _positive(n, 3)
    w = last(n)
    moves = F.min(x).over(w) < F.max(x).over(w)
    return full(F.when(moves, F.skewness(x).over(w) * ((n * (n - 1)) ** 0.5 / (n - 2))), x, n)


def delay(x: Column, d: int) -> Column:
    _positive(d)
    return F.lag(x, d).over(series())


def delta(x: Column, d: int) -> Column:
    """x minus x of d bars ago. A lag below 1 would look ahead and is refused."""
    _positive(d)
    return x - F.lag(x, d).over(series())


def decay_linear(x: Column, n: int, newest_first: bool = False) -> Column:
    """Mean of the window with weights n for the oldest value to 1 for the newest; newest_first turns them round."""
    _positive(n)
    terms = [(F.lag(x, k).over(series()) if k else x) * float(n - k if newest_first else k + 1) for k in range(n)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total / (n * (n + 1) / 2)


def slope(x: Column, n: int) -> Column:
    """Least-squares slope on the bar number in the window."""
    _positive(n, 2)
    number = F.row_number().over(series()).cast("double")
    at = F.when(x.isNotNull(), number)
    return full(F.try_divide(F.covar_samp(x, at).over(last(n)), F.var_samp(at).over(last(n))), x, n)


def r_squared(x: Column, n: int) -> Column:
    """Squared correlation with the bar number."""
    number = F.row_number().over(series()).cast("double")
    c = ts_corr(x, number, n)
    return c * c


def forward_fill(x: Column, limit: int | None = None) -> Column:
    w = so_far() if limit is None else series().rowsBetween(-limit, 0)
    return F.last(x, ignorenulls=True).over(w)


def pct_change(x: Column, d: int = 1) -> Column:
    return F.try_divide(x, F.lag(x, d).over(series())) - 1


def signed_power(x: Column, p: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(p))


def safe_div(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """a / (b + eps sign b); null where b is 0."""
    return F.try_divide(a, b + eps * F.signum(b))


def vwap(market: str, **fields: Column) -> Column:
    """The panel's vwap if it has one; for equity_cn amount in thousands over volume in hundreds; else the mean of the four prices."""
    if "vwap" in fields:
        return fields["vwap"]
    if market == "equity_cn":
        return safe_div(fields["amount"] * 1000.0, fields["volume"] * 100.0 + 1.0)
    return (fields["open"] + fields["high"] + fields["low"] + fields["close"]) / 4.0


def bar_returns(close: Column) -> Column:
    """Return on the last known price if that is positive; else 0. Use it as a value, not inside another window."""
    before = F.last(close, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.try_divide(close, F.when(before > 0, before)) - 1, F.lit(0.0))


def forward_returns(close: Column) -> Column:
    """The next bar's return: a label, never an input."""
    return F.try_divide(F.lead(close, 1).over(series()), close) - 1


def peaks(x: Column, w: int) -> Column:
    """True where x is the largest of the 2w + 1 rows around it, all of which must exist."""
    around = series().rowsBetween(-w, w)
    return F.coalesce((F.count(F.lit(1)).over(around) == 2 * w + 1) & (x == F.max(x).over(around)), F.lit(False))


def valleys(x: Column, w: int) -> Column:
    around = series().rowsBetween(-w, w)
    return F.coalesce((F.count(F.lit(1)).over(around) == 2 * w + 1) & (x == F.min(x).over(around)), F.lit(False))
