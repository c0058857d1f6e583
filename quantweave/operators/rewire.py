"""Rewiring: how much each symbol's correlations with all others have changed between a recent window and the calm one before it.

Dates are numbered and dealt to stretches as long as both windows; a row goes to the stretches whose windows hold it, two at most.
A stretch is a matrix of symbols and some 280 dates, and each of its dates takes two matrix products, by blocks of symbols, of which
only the row means are kept: no table of pairs is made.

Defined cases: within a window a symbol's deviations are from the mean of what is there, and missing values add nothing; with fewer than
`coverage` of a window's dates, or without any movement, a symbol has no correlations; with fewer than `peers` of them no score. More
than `most` symbols are refused, since a stretch is held in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scaled(x: np.ndarray, least: int) -> np.ndarray:
    """Deviations (symbols, dates) by their norm; nan where there are too few or nothing moves."""
    there = np.isfinite(x)
    n = there.sum(axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        d = np.where(there, x - np.where(there, x, 0.0).sum(axis=1, keepdims=True) / np.maximum(n, 1), 0.0)
        norm = np.sqrt((d * d).sum(axis=1, keepdims=True))
        return np.where((n >= least) & (norm > 0), d / norm, np.nan)


def scores(event: np.ndarray, calm: np.ndarray, least_event: int, least_calm: int, peers: int, block: int = 512) -> np.ndarray:
    """Mean change of each symbol's correlations."""
    e, c = scaled(event, least_event), scaled(calm, least_calm)
    good = np.flatnonzero(~np.isnan(e[:, 0]) & ~np.isnan(c[:, 0]))
    out = np.full(len(e), np.nan)
    if len(good) - 1 < max(peers, 1):
        return out
    e, c = e[good], c[good]
    for a in range(0, len(good), block):
        change = np.abs(e[a : a + block] @ e.T - c[a : a + block] @ c.T)
        change[np.arange(len(change)), np.arange(a, a + len(change))] = 0.0
        out[good[a : a + block]] = change.sum(axis=1) / (len(good) - 1)
    return out


def rewiring(rows: DataFrame, event: int = 20, calm: int = 120, coverage: float = 0.9, peers: int = 2, most: int = 20_000) -> DataFrame:
    """symbol, date, score of rows symbol, date, r (a return or null), one a symbol and date; only dates with a full past."""
    span = event + calm
    dates = rows.select("date").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)  # one row a date
    x = rows.select("symbol", "date", F.col("r").cast("double").alias("r")).join(F.broadcast(dates), "date")
    # the stretch of a date, and the next one, which looks back on it
    x = x.withColumn("_k", F.explode(F.array(F.floor(F.col("_i") / span), F.floor(F.col("_i") / span) + 1)))
    kind = dict(rows.dtypes)["symbol"]
    least_event, least_calm = int(np.ceil(coverage * event - 1e-9)), int(np.ceil(coverage * calm - 1e-9))

    def stretch(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["_k"].iloc[0])
        names, at = np.unique(pdf["symbol"].to_numpy(), return_inverse=True)
        if len(names) > most:
            raise ValueError(f"more than {most} symbols")
        m = np.full((len(names), 2 * span), np.nan)
        place = pdf["_i"].to_numpy() - (k - 1) * span
        m[at, place] = pdf["r"].to_numpy(float)
        own = pdf[(pdf["_i"] // span == k) & (pdf["_i"] >= span - 1)]
        out = []
        for i, part in own.groupby("_i", sort=True):
            end = int(i) - (k - 1) * span + 1
            s = scores(m[:, end - event : end], m[:, end - span : end - event], least_event, least_calm, peers)
            which = np.searchsorted(names, part["symbol"].to_numpy())
            out.append(pd.DataFrame({"symbol": part["symbol"].to_numpy(), "date": part["date"].to_numpy(), "score": s[which]}))
        return pd.concat(out) if out else pd.DataFrame({"symbol": pdf["symbol"][:0], "date": pdf["date"][:0], "score": np.zeros(0)})

    found = x.groupBy("_k").applyInPandas(stretch, f"symbol {kind}, date date, score double")
    return found.select("symbol", "date", F.when(~F.isnan("score"), F.col("score")).alias("score"))
