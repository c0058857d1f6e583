"""The factors without an SQL twin beside an evaluation of the same formulas on pandas frames, operator by operator."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from quantweave.operators import zoo
from quantweave.operators.expr import X, evaluate
from quantweave.plans import zoo as plans

N, K = 300, 6
SECTOR = np.arange(K) % 2


def frames(seed=0):
    rng = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, (N, K)), axis=0))
    open_ = close * np.exp(rng.normal(0, 0.01, (N, K)))
    f = {"open": open_, "close": close, "high": np.maximum(open_, close) * 1.01, "low": np.minimum(open_, close) * 0.99, "volume": rng.integers(100, 1000, (N, K)).astype(float)}
    f["vwap"] = (f["high"] + f["low"] + close) / 3
    f["amount"] = f["vwap"] * f["volume"]
    return f


def windows(x, n, f):
    """f of the last n values (last axis); nan until all are there."""
    out = np.full(x.shape, np.nan)
    if len(x) >= n:
        view = np.lib.stride_tricks.sliding_window_view(x, n, axis=0)
        good = ~np.isnan(view).any(axis=2)
        got = np.full(good.shape, np.nan)
        got[good] = f(view[good])
        out[n - 1 :] = got
    return out


def shifted(x, d):
    out = np.full(x.shape, np.nan)
    out[d:] = x[: len(x) - d] if d else x
    return out


def both_windows(x, y, n, kind):
    x, y = np.where(np.isnan(y), np.nan, x), np.where(np.isnan(x), np.nan, y)
    a, b = (np.lib.stride_tricks.sliding_window_view(v, n, axis=0) for v in (x, y))
    out = np.full(x.shape, np.nan)
    da, db = a - a.mean(axis=2, keepdims=True), b - b.mean(axis=2, keepdims=True)
    cov = (da * db).sum(axis=2) / (n - 1)
    if kind == "corr":
        moves = (a.min(axis=2) < a.max(axis=2)) & (b.min(axis=2) < b.max(axis=2))
        cov = np.where(moves, cov / (a.std(axis=2, ddof=1) * b.std(axis=2, ddof=1)), np.nan)
    out[n - 1 :] = cov
    return out


def by_row(x, f):
    return f(pd.DataFrame(x)).to_numpy()


def evaluated(x: X, f: dict[str, np.ndarray], held: dict[str, np.ndarray]) -> np.ndarray:
    if x.key in held:
        return held[x.key]
    a = [evaluated(y, f, held) for y in x.args]
    p = x.params
    t = {
        "col": lambda: f[p[0]], "lit": lambda: np.full((N, K), p[0]),
        "add": lambda: a[0] + a[1], "sub": lambda: a[0] - a[1], "mul": lambda: a[0] * a[1], "div": lambda: np.where(a[1] == 0, np.nan, a[0] / np.where(a[1] == 0, 1, a[1])),
        "lt": lambda: (a[0] < a[1]).astype(float), "le": lambda: (a[0] <= a[1]).astype(float), "where": lambda: np.where(a[0] == 1, a[1], a[2]),
        "abs": lambda: np.abs(a[0]), "sign": lambda: np.sign(a[0]), "log": lambda: np.log(np.where(a[0] > 0, a[0], np.nan)), "round": lambda: np.round(a[0], 8),
        "fmax": lambda: np.fmax(a[0], a[1]), "fmin": lambda: np.fmin(a[0], a[1]), "high2": lambda: np.maximum(a[0], a[1]), "low2": lambda: np.minimum(a[0], a[1]),
        "finite": lambda: np.where(np.isfinite(a[0]), a[0], np.nan), "fill": lambda: np.where(np.isnan(a[0]), a[1], a[0]), "power": lambda: np.sign(a[0]) * np.abs(a[0]) ** a[1],
        "mean": lambda: windows(a[0], p[0], lambda v: v.mean(axis=1)), "sum": lambda: windows(a[0], p[0], lambda v: v.sum(axis=1)), "std": lambda: windows(a[0], p[0], lambda v: v.std(axis=1, ddof=1)),
        "max": lambda: windows(a[0], p[0], lambda v: v.max(axis=1)), "min": lambda: windows(a[0], p[0], lambda v: v.min(axis=1)), "product": lambda: windows(a[0], p[0], lambda v: v.prod(axis=1)),
        "ts_rank": lambda: windows(a[0], p[0], lambda v: ((v < v[:, -1:]).sum(axis=1) + (v == v[:, -1:]).sum(axis=1) / 2 + 0.5) / p[0]),
        "argmax": lambda: windows(a[0], p[0], lambda v: v.argmax(axis=1).astype(float)), "argmin": lambda: windows(a[0], p[0], lambda v: v.argmin(axis=1).astype(float)),
        "decay": lambda: windows(a[0], p[0], lambda v: v @ np.arange(p[0], 0, -1.0) / (p[0] * (p[0] + 1) / 2)),
        "corr": lambda: both_windows(a[0], a[1], p[0], "corr"), "cov": lambda: both_windows(a[0], a[1], p[0], "cov"),
        "delay": lambda: shifted(a[0], p[0]), "delta": lambda: a[0] - shifted(a[0], p[0]), "number": lambda: np.repeat(np.arange(1.0, N + 1)[:, None], K, axis=1),
        "partial_sum": lambda: pd.DataFrame(a[0]).rolling(p[0], min_periods=p[1]).sum().to_numpy(),
        "running_product": lambda: np.where(np.isnan(a[0]), np.nan, np.where(np.isnan(a[0]), 1, a[0]).cumprod(axis=0)),
        "rank": lambda: by_row(a[0], lambda d: d.rank(axis=1, pct=True)), "scale": lambda: by_row(a[0], lambda d: d.div(d.abs().sum(axis=1).replace(0, np.nan), axis=0)), "market": lambda: np.repeat(np.nanmean(a[0], axis=1)[:, None], K, axis=1),
        "zscore": lambda: by_row(a[0], lambda d: d.sub(d.mean(axis=1), axis=0).div(d.std(axis=1).where(d.min(axis=1) < d.max(axis=1)), axis=0)),
        "neutral": lambda: by_row(a[0], lambda d: d - d.T.groupby(SECTOR).transform("mean").T),
        "ewm": lambda: pd.DataFrame(a[0]).ewm(alpha=p[0], adjust=False).mean().to_numpy(),
    }
    with np.errstate(all="ignore"):
        held[x.key] = t[x.op]()
    return held[x.key]


@pytest.fixture(scope="module")
def market():
    return frames()


def compared(spark, market, targets):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(N)]
    rows = [(s, days[i], *[float(v[i, s]) for v in market.values()], int(SECTOR[s])) for s in range(K) for i in range(N)]
    panel = spark.createDataFrame(rows, "symbol long, date date, " + ", ".join(f"{c} double" for c in market) + ", sector long")
    got = evaluate(panel, targets).toPandas()
    held: dict[str, np.ndarray] = {}
    for name, x in targets.items():
        want = np.asarray(evaluated(x, market, held), float)
        mine = got.pivot(index="date", columns="symbol", values=name).to_numpy(float)
        want = np.where(np.isfinite(want), want, np.nan)
        there, here = ~np.isnan(want), ~np.isnan(np.where(np.isfinite(mine), mine, np.nan))
        assert there.any() and (there != here).mean() < 0.01, (name, there.mean(), here.mean())
        both = there & here
        # a rounding may part a tie; then that cell and what is built on it differ
        off = ~np.isclose(mine[both], want[both], rtol=1e-6, atol=1e-8)
        assert off.mean() < 0.005, (name, off.mean())


def test_factors_apart_from_sql(spark, market):
    g = zoo.gtja191()
    compared(spark, market, {f"g{k:03d}": g[k] for k in plans._APART} | {"a084": zoo.alpha101()[84]})


def test_rewiring_beside_loops(spark):
    from quantweave.operators.rewire import rewiring

    rng = np.random.default_rng(4)
    n, event, calm = 75, 6, 15
    x = rng.normal(size=(n, 7)) * 0.02 + rng.normal(size=(n, 1)) * 0.01
    x[rng.random(x.shape) < 0.04] = np.nan
    x[20:, 6] = 0.0
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    rows = spark.createDataFrame([(f"s{s}", days[i], None if np.isnan(x[i, s]) else float(x[i, s])) for s in range(7) for i in range(n)], "symbol string, date date, r double")
    got = {(r.symbol, (r.date - days[0]).days): r.score for r in rewiring(rows, event, calm, 0.8).collect()}
    assert set(got) == {(f"s{s}", i) for s in range(7) for i in range(event + calm - 1, n)}

    def corr(part, least):
        out = np.full((7, 7), np.nan)
        for i in range(7):
            for j in range(7):
                a, b = (np.where(np.isnan(v), 0.0, v - np.nanmean(v)) if (~np.isnan(v)).sum() >= least else None for v in (part[:, i], part[:, j]))
                if a is not None and b is not None and (a @ a) > 0 and (b @ b) > 0:
                    out[i, j] = a @ b / np.sqrt((a @ a) * (b @ b))
        return out

    for t in range(event + calm - 1, n):
        change = np.abs(corr(x[t - event + 1 : t + 1], 5) - corr(x[t - event - calm + 1 : t - event + 1], 12))
        np.fill_diagonal(change, np.nan)
        for s in range(7):
            known = change[s][~np.isnan(change[s])]
            assert got[f"s{s}", t] == (pytest.approx(known.mean()) if len(known) >= 2 else None), (s, t)
    assert rewiring(rows.limit(0)).count() == 0
