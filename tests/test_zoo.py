"""Factor expressions: levels, equal parts, SQL text, values beside pandas, no look-ahead."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from quantweave.operators import zoo
from quantweave.operators.expr import Levels, average, col, corr, delta, evaluate, mean, rank, to_sql

N, K = 90, 6


def wide(seed=0, changed_from=None):
    rng = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, (N, K)), axis=0))
    open_ = close * np.exp(rng.normal(0, 0.01, (N, K)))
    f = {"open": open_, "close": close, "high": np.maximum(open_, close) * 1.01, "low": np.minimum(open_, close) * 0.99, "volume": rng.integers(100, 1000, (N, K)).astype(float)}
    f["vwap"] = (f["high"] + f["low"] + close) / 3
    f["amount"] = f["vwap"] * f["volume"]
    if changed_from is not None:
        for v in f.values():
            v[changed_from:] = v[changed_from:] * rng.uniform(2, 5, v[changed_from:].shape)
    return {k: pd.DataFrame(v) for k, v in f.items()}


def panel(spark, frames):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(N)]
    rows = [(s, days[i], *[float(f.iloc[i, s]) for f in frames.values()], s % 2) for s in range(K) for i in range(N)]
    return spark.createDataFrame(rows, "symbol long, date date, " + ", ".join(f"{c} double" for c in frames) + ", sector long").cache()


def values(df, name):
    p = df.select("symbol", "date", name).toPandas().pivot(index="date", columns="symbol", values=name)
    return p.to_numpy(float)


def test_levels_share_equal_parts():
    c, v = col("close"), col("volume")
    plan = Levels({"a": rank(corr(rank(c), rank(v), 5)), "b": rank(c) + 1, "m": mean(rank(c) * 2, 3)})
    assert plan.depth == 3
    assert sum(x.op == "rank" for x in plan.name) == 3  # of close, of volume, of the correlation
    assert "WITH" not in to_sql("panel", {"b": rank(c)}) and to_sql("panel", {"b": c}).startswith(" SELECT")


def test_values_beside_pandas(spark):
    f = wide()
    c, h, v, o = (f[x] for x in ("close", "high", "volume", "open"))
    a, g = zoo.alpha101(), zoo.gtja191()
    got = evaluate(panel(spark, f), {"a6": a[6], "a12": a[12], "a3": a[3], "g81": g[81], "g63": g[63], "g14": g[14], "own": average(delta(col("close"), 1), 0.2)})
    r = lambda x: x.rank(axis=1, pct=True)
    d = c.diff()
    want = {
        "a6": -o.rolling(10).corr(v), "a12": np.sign(v.diff()) * -d, "a3": -r(o).rolling(10).corr(r(v)), "g81": v.ewm(alpha=2 / 21, adjust=False).mean(),
        "g63": d.clip(lower=0).ewm(alpha=1 / 6, adjust=False).mean() / d.abs().ewm(alpha=1 / 6, adjust=False).mean() * 100, "g14": c.diff(5), "own": d.ewm(alpha=0.2, adjust=False).mean(),
    }
    for name, x in want.items():
        x = x.replace([np.inf, -np.inf], np.nan).to_numpy()
        mine = values(got, name)
        both = ~np.isnan(x) & ~np.isnan(mine)
        assert both.sum() > 0.4 * x.size, name  # a rank that stays the same has no correlation
        np.testing.assert_allclose(mine[both], x[both], rtol=1e-7, atol=1e-9, err_msg=name)


@pytest.mark.parametrize("part", ["qlib", "alpha", "gtja"])
def test_factors_do_not_look_ahead(spark, part):
    a, g = zoo.alpha101(), zoo.gtja191()
    targets = {"qlib": zoo.qlib(5), "alpha": {f"a{k}": a[k] for k in (1, 4, 9, 18, 21, 30, 41, 53, 60, 83, 101)}, "gtja": {f"g{k}": g[k] for k in (2, 3, 9, 21, 28, 43, 55, 69, 89, 116, 137, 150, 172, 187)}}[part]
    cut = 70
    one, two = (evaluate(panel(spark, wide(3, x)), targets) for x in (None, cut))
    one, two = one.toPandas(), two.toPandas()
    limit = dt.date(2024, 1, 1) + dt.timedelta(days=cut)
    key = ["symbol", "date"]
    x = one[one["date"] < limit].sort_values(key).reset_index(drop=True)
    y = two[two["date"] < limit].sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(x, y, check_exact=False, rtol=1e-9)
    assert x.drop(columns=key).notna().any().all()


def test_the_catalogue_is_whole():
    assert len(zoo.qlib(5)) * len(zoo.WINDOWS) + len(zoo.candles()) == 154
    assert sorted(zoo.alpha101()) == list(range(1, 102)) and sorted(zoo.gtja191()) == list(range(1, 192))
    assert len(zoo.academic()) == 11 and len(zoo.fundamental()) == 4
