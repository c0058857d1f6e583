"""Cross-sectional operators: Column expressions over the symbols of a date."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

AT = "date"


def section(*more: str | Column) -> WindowSpec:
    return Window.partitionBy(AT, *more)


def rank(x: Column) -> Column:
    """Percentile rank with mean ranks for ties; nulls stay null and don't count."""
    low = F.rank().over(section().orderBy(x.asc_nulls_last()))
    same = F.count(F.lit(1)).over(section(x))
    return F.when(x.isNotNull(), (low + (same - 1) / 2) / F.count(x).over(section()))


def mean_rank(x: Column) -> Column:
    """As rank(), but as a place from 1."""
    low = F.rank().over(section().orderBy(x.asc_nulls_last()))
    return F.when(x.isNotNull(), low + (F.count(F.lit(1)).over(section(x)) - 1) / 2)


def zscore(x: Column) -> Column:
    """Null where the date's values don't differ."""
    w = section()
    spread = F.when(F.min(x).over(w) < F.max(x).over(w), F.stddev_samp(x).over(w))
    return F.try_divide(x - F.avg(x).over(w), spread)


def scale(x: Column, a: float = 1.0) -> Column:
    """Absolute values of a date add up to a; null where they are all 0."""
    total = F.sum(F.abs(x)).over(section())
    return F.try_divide(x * a, F.when(total > 0, total))


def neutralize(x: Column, sector: Column | None = None) -> Column:
    """x less the mean of its sector on that date (of all symbols without sectors)."""
    return x - F.avg(x).over(section() if sector is None else section(sector))


def winsorise(x: Column, share: float) -> Column:
    """Values beyond the date's share and 1 - share quantiles are moved to them."""
    low, high = F.percentile(x, F.lit(share)).over(section()), F.percentile(x, F.lit(1 - share)).over(section())
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))
