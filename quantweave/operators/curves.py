"""Yield curves by date: Nelson and Siegel's three factors, or four with Svensson's second hump.

For given decays a curve is linear in its factors, so only decays are searched: a ladder of them meets every key's yields, the linear part
of all comes from one aggregation of sums of products; from the best step of it on, rounds of such sums improve the decays. Decays are in the unit of maturities.

Defined cases: yields or maturities that are null, and maturities that aren't positive, are left out; a key with fewer yields than
parameters has no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored
from .leastsq import grams, solved, sweep, swept


def hump(maturity: Column, decay: Column) -> tuple[Column, Column]:
    """Loadings of slope and curvature."""
    x = maturity / decay
    slope = (1 - F.exp(-x)) / x
    return slope, slope - F.exp(-x)


def _fits(rows: DataFrame, keys: list[str], decays: list[str], maturity: str, value: str) -> DataFrame:
    """keys, decays, n, ssr, beta of each candidate."""
    slope, first = hump(F.col(maturity), F.col(decays[0]))
    variables = {"slope": slope, "curve": first}
    if len(decays) > 1:
        variables["second"] = hump(F.col(maturity), F.col(decays[1]))[1]
    k = len(variables) + 1
    sums = grams(rows, [*keys, *decays], variables | {"y": F.col(value)})

    def solve(m: np.ndarray, n: np.ndarray) -> dict:
        m, n = m[:, 0], n[:, 0]
        out = swept(sweep(m, 0, m), list(range(1, k)))
        return {"n": n.astype(np.int64), "ssr": np.maximum(out[:, k, k], 0.0), "beta": out[:, :k, k]}

    return solved(sums, [*keys, *decays], k, 0, "n long, ssr double, beta array<double>", solve)


def grid_fit(rows: DataFrame, keys: list[str], maturity: str, value: str, ladder: list[float], svensson: bool = False, each_first: bool = False) -> DataFrame:
    """keys, n, ssr, beta, lambda1 (lambda2): the best curve of a ladder of decays (of its pairs that are 5% apart), or that of each first decay."""
    rows = rows.filter(F.col(maturity).isNotNull() & F.col(value).isNotNull() & (F.col(maturity) > 0))
    decays = ["lambda1", "lambda2"] if svensson else ["lambda1"]
    pairs = [(a, b) for a in ladder for b in ladder if b > 1.05 * a] if svensson else [(a,) for a in ladder]
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(d) for v, d in zip(p, decays)]) for p in pairs]))
    crossed = rows.select(*keys, maturity, value, each.alias("_p")).select(*keys, maturity, value, "_p.*")
    if not each_first:
        return _best(crossed, keys, decays, maturity, value)
    fit = _fits(crossed, keys, decays, maturity, value).filter(f"beta is not null and n >= {len(decays) * 2 + 2}")
    best = F.min_by(F.struct("n", "ssr", "beta", *decays[1:]), F.struct("ssr", *decays)).alias("_f")
    return fit.groupBy(*keys, "lambda1").agg(best).select(*keys, "lambda1", "_f.*")


def _best(candidates: DataFrame, keys: list[str], decays: list[str], maturity: str, value: str) -> DataFrame:
    fit = _fits(candidates, keys, decays, maturity, value).filter(f"beta is not null and n >= {len(decays) * 2 + 2}")
    return fit.groupBy(*keys).agg(F.min_by(F.struct("n", "ssr", "beta", *decays), F.struct("ssr", *decays)).alias("_f")).select(*keys, "_f.*")


def _steps(rows: DataFrame, best: DataFrame, on: list[str], keys: list[str], decays: list[str], maturity: str, value: str) -> DataFrame:
    """keys, step array<double>: by how much the logarithms of the decays should change, with the linear part along (Gauss and Newton)."""
    x = rows.join(best, on)
    slope, curve = hump(F.col(maturity), F.col("lambda1"))
    # by the logarithm of its decay the slope's loading changes by the curvature's, and that by itself less x exp(-x)
    turn = lambda d: hump(F.col(maturity), F.col(d))[1] - F.col(maturity) / F.col(d) * F.exp(-F.col(maturity) / F.col(d))
    variables = {"slope": slope, "curve": curve}
    if len(decays) > 1:
        variables["second"] = hump(F.col(maturity), F.col("lambda2"))[1]
    linear = len(variables) + 1
    variables["g1"] = F.col("beta")[1] * curve + F.col("beta")[2] * turn("lambda1")
    if len(decays) > 1:
        variables["g2"] = F.col("beta")[3] * turn("lambda2")
    k = len(variables) + 1
    sums = grams(x, keys, variables | {"y": F.col(value)})

    def solve(m: np.ndarray, n: np.ndarray) -> dict:
        m = m[:, 0]
        out = swept(sweep(m, 0, m), list(range(1, k)))
        return {"step": np.clip(np.nan_to_num(out[:, linear:k, k]), -0.7, 0.7)}

    return solved(sums, keys, k, 0, "step array<double>", solve)


def fit(rows: DataFrame, keys: list[str], maturity: str, value: str, svensson: bool = False, low: float = 0.05, high: float = 30.0, points: int = 0, rounds: int = 8, starts: int = 8) -> DataFrame:
    """keys, n, rmse, beta (level, slope, curvature, second), lambda1 (lambda2) of the curve of least squares.

    After the ladder each round takes a step for every key and keeps the best of it, parts of it, and none.
    """
    points = points or (16 if svensson else 40)
    rows = rows.filter(F.col(maturity).isNotNull() & F.col(value).isNotNull() & (F.col(maturity) > 0)).select(*keys, maturity, value)
    decays = ["lambda1", "lambda2"] if svensson else ["lambda1"]
    # the likelihood has several valleys: of each first decay the best second one, and of those the best few are followed
    ladder = np.geomspace(low, high, points).tolist()
    every = grid_fit(rows, keys, maturity, value, ladder, svensson, each_first=True)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ssr", "lambda1"))
    best = stored(every.withColumn("_start", rank).filter(F.col("_start") <= starts))
    plain, keys = keys, [*keys, "_start"]
    for _ in range(rounds):
        steps = _steps(rows, best, plain, keys, decays, maturity, value)
        share = F.explode(F.array(*[F.lit(v) for v in (1.0, 0.5, 0.25, 0.1, 0.03, 0.0)])).alias("_share")
        moved = lambda d, i: F.least(F.greatest(F.col(d) * F.exp(F.col("_share") * F.col("step")[i]), F.lit(low)), F.lit(high)).alias(d)
        near = best.select(*keys, *decays).join(steps, keys).select(*keys, *decays, "step", share).select(*keys, *[moved(d, i) for i, d in enumerate(decays)]).distinct()
        best = stored(_best(rows.join(near, plain), keys, decays, maturity, value))
    best = best.groupBy(*plain).agg(F.min_by(F.struct("n", "ssr", "beta", *decays), F.struct("ssr", "_start")).alias("_f")).select(*plain, "_f.*")
    return best.select(*plain, "n", F.sqrt(F.col("ssr") / F.col("n")).alias("rmse"), "beta", *decays)


def at(fitted: DataFrame, maturity: Column, svensson: bool = False) -> Column:
    """The curve's yield at a maturity, from the columns of a fit."""
    slope, curve = hump(maturity, F.col("lambda1"))
    out = F.col("beta")[0] + F.col("beta")[1] * slope + F.col("beta")[2] * curve
    return out + F.col("beta")[3] * hump(maturity, F.col("lambda2"))[1] if svensson else out
