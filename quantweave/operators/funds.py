"""Distribution waterfalls by fund, deal and date, clawback, and all rates of return of a fund's flows.

A flow is (date, amount, kind): contributions are negative, distributions positive. What a hurdle has grown to is a sum over contributions
of (1 + rate) to the years since, so the balances of all dates are running sums of amounts carried to one date; the four tiers
then follow from totals by least and greatest, without a loop. Every amount is split to the last cent: the tiers add up to what
was distributed, on every date.

Defined cases: flows without a date or an amount are left out, and so are other kinds; a fund without contributions has no hurdle; rates
are by years of 365 days unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

TIERS = ("capital", "preferred_paid", "catch_up", "carry")


def _checked(carry: float, catch_up: float, rate: float) -> None:
    if rate < 0 or not 0 <= carry < 1 or not 0 <= catch_up <= 1 or 0 < catch_up <= carry:
        raise ValueError("a rate of 0 or more, a carry below 1, and a catch-up of 0 or above the carry")


def split(paid: Column, contributed: Column, preferred: Column, carry: float, catch_up: float) -> dict[str, Column]:
    """The tiers of an amount, what each side gets, and what is still owed."""
    capital = F.least(paid, contributed)
    hurdle = F.least(paid - capital, preferred)
    most = hurdle * (carry / (catch_up - carry)) if catch_up > 0 and carry > 0 else F.lit(0.0)
    third = F.least(paid - capital - hurdle, most)
    rest = paid - capital - hurdle - third
    general = third * catch_up + rest * carry
    return {"capital": capital, "preferred_paid": hurdle, "catch_up": third, "carry": rest, "lp": paid - general, "gp": general, "unreturned": contributed - capital, "unpaid": preferred - hurdle}


def _sides(flows: DataFrame) -> DataFrame:
    flows = flows.filter("date is not null and amount is not null and kind in ('contribution', 'distribution')")
    return flows.withColumns({"_in": F.when(F.col("kind") == "contribution", -F.col("amount")).otherwise(0.0), "_out": F.when(F.col("kind") == "distribution", F.col("amount")).otherwise(0.0)})


def _owed(years: Column, rate: float, compound: bool) -> Column:
    return F.col("_in") * ((F.pow(F.lit(1.0 + rate), years) - 1) if compound else rate * years)


def waterfall(flows: DataFrame, keys: list[str], rate: float, carry: float, catch_up: float = 1.0, compound: bool = True, days: float = 365.0, last: DataFrame | None = None) -> DataFrame:
    """keys, paid, contributed, preferred, the tiers, lp, gp, unreturned, unpaid: one waterfall a key, at the date of its last flow.

    `last` (keys, last) gives other dates of measurement.
    """
    _checked(carry, catch_up, rate)
    x = _sides(flows)
    ends = last if last is not None else flows.filter("date is not null").groupBy(*keys).agg(F.max("date").alias("last"))
    x = x.join(ends, keys)
    years = F.datediff("last", "date") / days
    early = F.when((years < 0) & (F.col("_in") > 0), F.raise_error(F.lit("a contribution after the date of measurement"))).otherwise(years)
    s = x.groupBy(*keys).agg(F.sum("_out").alias("paid"), F.sum("_in").alias("contributed"), F.sum(_owed(early, rate, compound)).alias("preferred"))
    return s.select(*keys, "paid", "contributed", "preferred", *[c.alias(n) for n, c in split(F.col("paid"), F.col("contributed"), F.col("preferred"), carry, catch_up).items()])


def waterfall_by_date(flows: DataFrame, keys: list[str], rate: float, carry: float, catch_up: float = 1.0, days: float = 365.0) -> DataFrame:
    """As waterfall(), of all flows so far, for every key and date on which there was one: balances by prefix sums."""
    _checked(carry, catch_up, rate)
    daily = _sides(flows).groupBy(*keys, "date").agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"))
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    years = F.datediff("date", F.min("date").over(whole)) / days
    x = daily.withColumn("_g", F.pow(F.lit(1.0 + rate), years))
    x = x.withColumns({"paid": F.sum("_out").over(w), "contributed": F.sum("_in").over(w), "_carried": F.sum(F.col("_in") / F.col("_g")).over(w)})
    x = x.withColumn("preferred", F.greatest(F.col("_g") * F.col("_carried") - F.col("contributed"), F.lit(0.0)))
    return x.select(*keys, "date", "paid", "contributed", "preferred", *[c.alias(n) for n, c in split(F.col("paid"), F.col("contributed"), F.col("preferred"), carry, catch_up).items()])


def clawback(flows: DataFrame, fund: str, deal: str, rate: float, carry: float, catch_up: float = 1.0, tax: float | None = None) -> DataFrame:
    """fund, received, entitled, clawback: carry paid deal by deal, each at its own end, beside that of all deals as one."""
    if tax is not None and not 0 <= tax < 1:
        raise ValueError("a tax rate from 0 to below 1")
    own = waterfall(flows, [fund, deal], rate, carry, catch_up).groupBy(fund).agg(F.sum("gp").alias("received"))
    pooled = waterfall(flows, [fund], rate, carry, catch_up).select(fund, F.col("gp").alias("entitled"))
    owed = F.greatest(F.col("received") - F.col("entitled"), F.lit(0.0)) * (1 - (tax or 0.0))
    return own.join(pooled, fund).select(fund, "received", "entitled", owed.alias("clawback"))


def all_rates(flows: DataFrame, key: str, low: float = -0.99, high: float = 100.0, days: float = 365.0, cells: int = 64, parts: int = 8, width: float = 1e-10, tolerance: float = 1e-12, most: int = 40) -> DataFrame:
    """key, rate: every yearly rate between `low` and `high` at which a key's flows (date, amount) have no value.

    With u = log(1 + rate) the value is a sum of amounts times exp(-years u). The range is cut into cells, and each round takes six sums a
    cell: value and slope at its middle, values at its ends, and bounds of the slope and its change. A cell whose value
    can't reach 0 goes; one whose slope can't has one root if its ends differ in sign, else none; all others are cut again. Only cells
    in doubt are kept, so no root between two grid points is overlooked. A root where the value only touches 0 is one whose cell has become
    as narrow as `width` with a value below `tolerance` of the gross flows.
    """
    # flows of a day are one flow: a key's history has at most a row a day
    daily = flows.filter("date is not null and amount is not null and amount <> 0").groupBy(key, "date").agg(F.sum("amount").cast("double").alias("_a"))
    held = daily.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("date", "_a"))).alias("_f"), F.max("_a").alias("_hi"), F.min("_a").alias("_lo")).filter("_hi > 0 and _lo < 0")
    years = F.transform("_f", lambda f: F.datediff(f["date"], F.get("_f", F.lit(0))["date"]) / days)
    held = held.select(key, years.alias("_t"), F.col("_f._a").alias("_a"))
    target = StructType([held.schema[key], StructField("rate", DoubleType())])
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch["_t"].value_lengths())
            t, a = np.asarray(batch["_t"].flatten()), np.asarray(batch["_a"].flatten())
            first, order = np.cumsum(sizes) - sizes, np.argsort(sizes, kind="stable")
            i = 0
            while i < len(order):
                # keys of like length side by side; a flow of 0 adds nothing
                many = min(2000, max(1, 1_000_000 // (cells * int(sizes[order[min(i + 2000, len(order) - 1)]]))))
                some = order[i : i + many]
                place = np.arange(sizes[some].max())
                there = place < sizes[some][:, None]
                at = np.where(there, first[some][:, None] + place, 0)
                own, rate = rates(np.where(there, t[at], 0.0), np.where(there, a[at], 0.0), low, high, cells, parts, width, tolerance, most)
                yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(some[own])), pa.array(rate)], schema=arrow)
                i += many

    # few bytes, much work: as many tasks as asked for
    tasks = int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held.repartition(tasks, key).mapInArrow(run, target)


def rates(t: np.ndarray, a: np.ndarray, low: float, high: float, cells: int, parts: int, width: float, tolerance: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, rate) of all_rates() for rows of flows a at years t (keys, flows)."""
    ends = np.log1p(low) + (np.log1p(high) - np.log1p(low)) * np.arange(cells + 1) / cells
    gross = np.abs(a).sum(axis=1)
    own, one = np.repeat(np.arange(len(a)), cells), np.zeros(len(a) * cells, bool)
    lower, upper = np.tile(ends[:-1], len(a)), np.tile(ends[1:], len(a))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    piece = max(1, 1_000_000 // a.shape[1])
    for _ in range(most):
        sums = []
        for k in range(0, len(own), piece):
            x, y, lo, up = t[own[k : k + piece]], a[own[k : k + piece]], lower[k : k + piece, None], upper[k : k + piece, None]
            at, left = y * np.exp(-x * ((lo + up) / 2)), np.exp(-x * lo)
            top = x * np.abs(y) * left
            sums.append([at.sum(axis=1), -(x * at).sum(axis=1), (y * left).sum(axis=1), (y * np.exp(-x * up)).sum(axis=1), top.sum(axis=1), (x * top).sum(axis=1)])
        f, d, fl, fu, b1, b2 = (np.concatenate(c) for c in zip(*sums))
        half = (upper - lower) / 2
        # the right end belongs to the next cell
        crossed = ((fl <= 0) & (fu > 0)) | ((fl >= 0) & (fu < 0))
        now = one | (np.abs(d) > b2 * half)
        keep = np.where(one, crossed, ~(np.abs(f) > b1 * half * (1 + 1e-9)) & (~now | crossed))
        own, lower, upper, one, f, half, crossed = (c[keep] for c in (own, lower, upper, now, f, half, crossed))
        narrow = half <= width
        over = narrow & (crossed | (np.abs(f) <= tolerance * gross[own]))
        found.append((own[over], np.expm1((lower[over] + upper[over]) / 2)))
        own, lower, upper, one = (c[~narrow] for c in (own, lower, upper, one))
        if not len(own):
            break
        step, k = np.repeat((upper - lower) / parts, parts), np.tile(np.arange(parts), len(own))
        own, one, left, right = (np.repeat(c, parts) for c in (own, one, lower, upper))
        lower, upper = left + k * step, np.where(k == parts - 1, right, left + (k + 1) * step)
    own, rate = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((rate, own))
    own, rate = own[order], rate[order]
    # a root that only touches, or lies at an end, may be told by two cells that meet there
    near = np.zeros(len(own), bool)
    near[1:] = (own[1:] == own[:-1]) & (rate[1:] - rate[:-1] <= 100 * width * (1 + np.abs(rate[1:])))
    return own[~near], rate[~near]
