"""Waterfalls, clawback, all rates of return, and yield curves beside plain loops and made data."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantweave.operators import curves, funds

DAY = dt.date(2020, 1, 1)
SCHEMA = "fund long, deal long, date date, amount double, kind string"


def plain_split(paid, put_in, owed, carry, catch_up):
    left, out = paid, []
    for most in (put_in, owed):
        out.append(min(left, most))
        left -= out[-1]
    target = carry * out[1] / (catch_up - carry) if catch_up and carry else 0.0
    out.append(min(left, target))
    left -= out[-1]
    return [*out, left], out[2] * catch_up + left * carry


def plain(rows, carry, catch_up, rate, last=None, compound=True):
    last = last or max(d for d, *_ in rows)
    put_in = sum(-a for _, a, k in rows if k == "contribution")
    paid = sum(a for _, a, k in rows if k == "distribution")
    years = lambda d: (last - d).days / 365
    owed = sum(-a * ((1 + rate) ** years(d) - 1 if compound else rate * years(d)) for d, a, k in rows if k == "contribution")
    return paid, put_in, owed, *plain_split(paid, put_in, owed, carry, catch_up)


@pytest.fixture(scope="module")
def flows():
    rng = np.random.default_rng(0)
    out = []
    for fund in range(6):
        for deal in range(3):
            start = int(rng.integers(0, 300))
            for _ in range(int(rng.integers(1, 5))):
                out.append((fund, deal, DAY + dt.timedelta(days=start + int(rng.integers(0, 200))), -float(rng.integers(10, 90)), "contribution"))
            for _ in range(int(rng.integers(0, 5))):
                out.append((fund, deal, DAY + dt.timedelta(days=start + int(rng.integers(100, 1500))), float(rng.integers(10, 250)), "distribution"))
            out.append((fund, deal, DAY + dt.timedelta(days=1600 + deal), 33.0, "valuation"))
    return out


@pytest.mark.parametrize("carry, catch_up, compound", [(0.2, 1.0, True), (0.2, 0.5, True), (0.15, 0.0, False), (0.0, 1.0, True)])
def test_waterfalls_by_deal(spark, flows, carry, catch_up, compound):
    extra = [(0, 0, None, 5.0, "distribution"), (0, 0, DAY, None, "distribution"), (9, 0, DAY, 50.0, "distribution"), (10, 1, DAY, -5.0, "contribution")]
    got = {(r.fund, r.deal): r for r in funds.waterfall(spark.createDataFrame(flows + extra, SCHEMA), ["fund", "deal"], 0.08, carry, catch_up, compound).collect()}
    for key in {(f, d) for f, d, *_ in flows}:
        paid, put_in, owed, tiers, gp = plain([r[2:] for r in flows if r[:2] == key], carry, catch_up, 0.08, compound=compound)
        r = got[key]
        assert [r.paid, r.contributed, r.preferred] == pytest.approx([paid, put_in, owed]) and [r[t] for t in funds.TIERS] == pytest.approx(tiers, abs=1e-9)
        assert r.gp == pytest.approx(gp) and r.lp + r.gp == pytest.approx(paid) and sum(r[t] for t in funds.TIERS) == pytest.approx(paid)
        assert r.unreturned == pytest.approx(put_in - tiers[0]) and r.unpaid == pytest.approx(owed - tiers[1])
    assert got[9, 0].carry == 50 and got[9, 0].preferred == 0 and got[10, 1].paid == 0 and got[10, 1].unreturned == 5


def test_what_goes_in_comes_out_on_every_date(spark, flows):
    got = funds.waterfall_by_date(spark.createDataFrame(flows, SCHEMA), ["fund"], 0.08, 0.2).collect()
    assert len(got) == len({(f, d) for f, _, d, _, k in flows if k != "valuation"})
    for r in got:
        so_far = [x[2:] for x in flows if x[0] == r.fund and x[2] <= r.date and x[4] != "valuation"]
        paid, put_in, owed, tiers, gp = plain(so_far, 0.2, 1.0, 0.08, r.date)
        assert [r.paid, r.contributed, r.preferred, r.gp] == pytest.approx([paid, put_in, owed, gp], abs=1e-9)
        assert sum(r[t] for t in funds.TIERS) == pytest.approx(paid) and r.lp + r.gp == pytest.approx(paid)


def test_clawback_of_a_fund(spark, flows):
    frame = spark.createDataFrame(flows, SCHEMA)
    got = {r.fund: r for r in funds.clawback(frame, "fund", "deal", 0.08, 0.2).collect()}
    net = {r.fund: r for r in funds.clawback(frame, "fund", "deal", 0.08, 0.2, tax=0.4).collect()}
    for f in range(6):
        received = sum(plain([r[2:] for r in flows if r[:2] == (f, d)], 0.2, 1.0, 0.08)[4] for d in range(3))
        entitled = plain([r[2:] for r in flows if r[0] == f], 0.2, 1.0, 0.08)[4]
        assert [got[f].received, got[f].entitled, got[f].clawback] == pytest.approx([received, entitled, max(0, received - entitled)])
        assert net[f].clawback == pytest.approx(0.6 * got[f].clawback)
    assert any(r.clawback > 1 for r in got.values())
    with pytest.raises(ValueError):
        funds.clawback(frame, "fund", "deal", 0.08, 0.2, catch_up=0.1)


def test_all_rates_of_flows_with_several_roots(spark):
    year = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=365 * k)

    def of(roots):
        """Yearly flows whose value is 0 at these rates: the polynomial with those factors."""
        p = np.array([1.0])
        for r in roots:
            p = np.convolve(p, [1.0, -(1 + r)])  # in powers of 1 + rate, highest first
        return [(year(k), float(1000 * a)) for k, a in enumerate(p)]

    known = {1: [0.1], 2: [0.1, 0.4], 3: [0.05, 0.5, 1.5], 4: [0.2, 0.2004], 5: [-0.5, 3.0, 20.0]}
    rows = [(k, d, a) for k, roots in known.items() for d, a in of(roots)] + [(7, year(0), -1.0), (7, year(1), -2.0), (8, year(0), -1.0), (8, year(0), 1.0), (9, None, 1.0), (10, year(0), -100.0), (10, year(1), 60.0), (10, year(1), 50.0)]
    got = {}
    for r in funds.all_rates(spark.createDataFrame(rows, "fund long, date date, amount double"), "fund").collect():
        got.setdefault(r.fund, []).append(r.rate)
    assert got.keys() == {*known, 10}
    for k, roots in known.items():
        assert sorted(got[k]) == pytest.approx(roots, abs=1e-6), k
    assert got[10] == pytest.approx([0.1])
    touching = spark.createDataFrame([(6, d, a) for d, a in of([0.25, 0.25])], "fund long, date date, amount double")
    assert [r.rate for r in funds.all_rates(touching, "fund", tolerance=1e-10, width=1e-7).collect()] == pytest.approx([0.25], abs=1e-3)


@pytest.mark.parametrize("svensson", [False, True])
def test_made_curves_are_found_again(spark, svensson):
    taus = [0.25, 0.5, 1, 2, 3, 4, 5, 7, 8, 10, 12, 15, 20, 25, 30]
    shape = lambda t, lam: (1 - np.exp(-t / lam)) / (t / lam)
    made, rows = {1: (0.04, -0.02, 0.015, 1.7, 0.01, 6.5), 2: (0.03, 0.01, -0.02, 3.1, -0.015, 11.0)}, []
    for d, (a, b, c, lam, e, second) in made.items():
        for t in taus:
            y = a + b * shape(t, lam) + c * (shape(t, lam) - np.exp(-t / lam)) + (e * (shape(t, second) - np.exp(-t / second)) if svensson else 0)
            rows.append((d, float(t), float(y)))
    rows += [(3, 1.0, 0.02), (3, 2.0, 0.02), (1, None, 0.1), (1, -1.0, 0.1), (2, 1.0, None)]
    df = spark.createDataFrame(rows, "day long, tau double, y double")
    fit = curves.fit(df, ["day"], "tau", "y", svensson)
    got = {r.day: r for r in fit.collect()}
    assert set(got) == {1, 2}
    for d, (a, b, c, lam, e, second) in made.items():
        r = got[d]
        assert r.n == len(taus) and r.rmse < 1e-6
        if not svensson:
            assert [*r.beta, r.lambda1] == pytest.approx([a, b, c, lam], abs=1e-5)
    said = df.filter("tau > 0 and y is not null").join(fit, "day").select("y", curves.at(fit, F.col("tau"), svensson).alias("own")).collect()
    assert max(abs(r.y - r.own) for r in said) < (1e-5 if svensson else 1e-6)
