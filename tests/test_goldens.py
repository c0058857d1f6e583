"""Sampled factors of every catalogue on seeded panels, against known values.

The values are those of the library that this one answers to: how many cells aren't missing, and the last date's row.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from quantweave.operators import zoo
from quantweave.operators.expr import evaluate

#: Factor -> (cells that aren't missing, values of the last date).
KNOWN = {
    "academic_carhart_mom": (384, [-0.817996879, 1.474143842, -0.9783247883, 1.367701281, -0.22124378, 0.004350761803, 0.2704376254, -1.099068063]),
    "alpha101_001": (30, [0.3, -0.1, -0.3, 0.3, 0.3]),
    "alpha101_005": (105, [-1.0, -0.24, -0.04, -0.64, -0.24]),
    "alpha101_011": (135, [0.08, 0.4, 2.0, 0.8, 0.96]),
    "alpha101_041": (150, [0.06155968888, -0.0190703421, 0.06152047076, 0.01156896358, -0.005840092459]),
    "alpha101_054": (150, [-0.6628822639, -0.2305392075, -0.1610866985, -0.6165298676, -0.87502049]),
    "gtja191_001": (120, [0.4873159231, -0.4455663943, -0.1084652289, -0.2891216548, -0.2491364396]),
    "gtja191_005": (98, [-0.3429971703, -0.272165527, -0.8215838363, -0.7222222222, -0.6546536707]),
    "gtja191_017": (80, [0.4897607269, 0.2235395217, 0.0003890478098, 1.0, 0.3426147696]),
    "gtja191_042": (105, [0.2870386108, 0.04210667318, -0.07577644719, 0.4989767435, -0.001299419461]),
    "gtja191_080": (125, [-67.10128841, -64.88163608, 11.08965103, -4.191616766, 107.8042685]),
    "gtja191_101": (400, [0.0, 0.0, 0.0, -1.0, 0.0]),
    "gtja191_130": (56, [1.0, None, 2.4, 0.8, 1.066666667]),
    "gtja191_150": (400, [123771769.7, 344962893.2, 113448262.7, 739492134.6, 70391649.81]),
    "gtja191_175": (370, [1.44586559, 1.908749495, 2.285385983, 2.039024594, 1.980489508]),
    "gtja191_191": (285, [1.098137207, 1.584406398, -0.7634753636, -0.7615957306, -1.164994355]),
    "qlib158_corr10": (105, [-0.4921427177, -0.1445613947, 0.01724789387, -0.4597241485, 0.2843813131]),
    "qlib158_kmid": (150, [0.00767870271, -0.01187836894, -0.01335240303, 0.005299514738, 0.003289796407]),
    "qlib158_ma5": (130, [0.9895537321, 1.004906458, 1.024209118, 0.9904206226, 1.003121437]),
    "qlib158_std20": (55, [0.01432519514, 0.01755788816, 0.01303039262, 0.01417965025, 0.0265904106]),
    "qlib158_vsumd20": (50, [-0.03561665955, -0.03112405392, 0.04777659746, 0.05338860236, 0.1018911767]),
}


def panel(n, k, volumes, lot):
    """Seeded bars: a random walk, opened at the close before, with a made-up range."""
    r = np.random.RandomState(42)
    close = np.abs(100 + np.cumsum(r.normal(0, 1, (n, k)), axis=0)) + 1
    open_ = np.vstack([close[:1], close[:-1]])
    high = np.maximum(close, open_) + r.uniform(0, 1, (n, k))
    low = np.abs(np.minimum(close, open_) - r.uniform(0, 1, (n, k))) + 0.01
    volume = volumes(r, (n, k))
    return {"open": open_, "high": high, "low": low, "close": close, "volume": volume, "amount": volume * close * lot}


def returns_panel(n, k):
    """Seeded bars of log-normal returns."""
    r = np.random.RandomState(42)
    close = 100 * np.exp(np.cumsum(r.normal(0, 0.02, (n, k)), axis=0))
    high, low = close * (1 + np.abs(r.normal(0, 0.005, (n, k)))), close * (1 - np.abs(r.normal(0, 0.005, (n, k))))
    volume = r.uniform(1e5, 1e7, (n, k))
    return {"open": np.vstack([close[:1], close[:-1]]), "high": high, "low": low, "close": close, "volume": volume, "amount": volume * close}


def whole(r, shape):
    return r.randint(1000, 100_000, size=shape).astype(float)


def wide(r, shape):
    return r.uniform(1e5, 1e7, shape)


def cases():
    a, g = zoo.alpha101(), zoo.gtja191()
    first = {f"alpha101_{i:03d}": a[i] for i in (1, 5, 11, 41, 54)} | {f"qlib158_{name}{n}": zoo.qlib(n)[name] for name, n in (("corr", 10), ("ma", 5), ("std", 20), ("vsumd", 20))} | {"qlib158_kmid": zoo.candles()["kmid"]}
    return {
        "typical": (panel(30, 5, whole, 1), "mean", first), "board lots": (panel(30, 5, whole, 100), "lots", {f"gtja191_{i:03d}": g[i] for i in (1, 5, 17, 42, 80)}),
        "long": (panel(80, 5, wide, 1), "lots", {f"gtja191_{i:03d}": g[i] for i in (101, 130, 150, 175, 191)}), "returns": (returns_panel(300, 8), "mean", {"academic_carhart_mom": zoo.academic()["carhart_mom"]}),
    }


@pytest.mark.parametrize("case", ["typical", "board lots", "long", "returns"])
def test_factors_have_the_known_values(spark, case):
    bars, vwap, factors = cases()[case]
    bars["vwap"] = (bars["high"] + bars["low"] + bars["close"] + bars["open"]) / 4 if vwap == "mean" else bars["amount"] * 1000 / (bars["volume"] * 100 + 1)
    n, k = bars["close"].shape
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), *[float(x[i, s]) for x in bars.values()], 0) for s in range(k) for i in range(n)]
    frame = spark.createDataFrame(rows, "symbol long, date date, " + ", ".join(f"{c} double" for c in bars) + ", sector long").cache()
    got = evaluate(frame, factors).toPandas()
    for name in factors:
        cells, last = KNOWN[name]
        table = got.pivot(index="date", columns="symbol", values=name).to_numpy(float)
        assert (~np.isnan(table)).sum() == cells, name
        np.testing.assert_allclose(table[-1], np.array([np.nan if x is None else x for x in last]), rtol=1e-6, atol=1e-9, err_msg=name)


def test_every_catalogue_is_sampled():
    assert set(KNOWN) == {name for *_, factors in cases().values() for name in factors} and len(KNOWN) == 21
