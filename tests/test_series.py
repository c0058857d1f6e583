"""Least squares by sums of products, and the tests that stand on it, beside plain numpy fits."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantweave.functions import tails
from quantweave.operators import extremes, leastsq, optimizers, regimes, volatility

DAY = dt.date(2024, 1, 1)


def fit(x, y):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    return b, float(e @ e)


def plain_unit_root(y, constant=True, lags=None):
    """(rows, lags, statistic): orders 0 to the most on the same rows, the best by criterion on all that it has."""
    d, n = np.diff(y), len(y)
    most = leastsq.default_lags(n, constant) if lags is None else min(lags, max(0, n // 2 - (2 if constant else 1)))

    def design(m, start):
        t = np.arange(start, len(d))
        columns = [y[t], *(d[t - j] for j in range(1, m + 1))] + ([np.ones(len(t))] if constant else [])
        return np.stack(columns, axis=1), d[t]

    best = None
    for m in range(most + 1):
        x, z = design(m, most)
        score = len(z) * (math.log(2 * math.pi * fit(x, z)[1] / len(z)) + 1) + 2 * x.shape[1]
        if best is None or score < best[0]:
            best = score, m
    x, z = design(best[1], best[1])
    b, rss = fit(x, z)
    return len(z), best[1], b[0] / math.sqrt(rss / (len(z) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])


def frame(spark, series, names="symbol long, date date, x double"):
    return spark.createDataFrame([(s, DAY + dt.timedelta(days=i), v) for s, x in series.items() for i, v in enumerate(x)], names)


def test_least_squares_of_many_groups(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for g in range(20):
        n = int(rng.integers(3, 60))
        x = rng.normal(size=(n, 3)) * [1, 1000, 1e-3] + [1e4, -5e5, 3]
        y = 7 + x @ [2, -0.01, 50] + rng.normal(size=n)
        rows += [(g, *map(float, a), float(b)) for a, b in zip(x, y)] + [(g, None, 1.0, 1.0, 1.0)]
        if n > 4:
            b, rss = fit(np.c_[np.ones(n), x], y)
            want[g] = n, b, rss
    rows += [(50, float(i), float(2 * i), 1.0 * i * i, float(i)) for i in range(9)]  # the second is twice the first
    rows += [(None, *map(float, a), float(a.sum())) for a in rng.normal(size=(9, 3))]
    got = {r.g: r for r in leastsq.least_squares(spark.createDataFrame(rows, "g long, a double, b double, c double, y double"), ["g"], "y", ["a", "b", "c"]).collect()}
    for g, (n, b, rss) in want.items():
        assert got[g].n == n and got[g].coef == pytest.approx(b.tolist(), rel=1e-6) and got[g].rss == pytest.approx(rss, rel=1e-6)
        assert 0 <= got[g].r2 <= 1
    assert got[50].coef is None
    few = spark.createDataFrame([(1, 1.0, 2.0)], "g long, a double, y double")
    assert leastsq.least_squares(few, ["g"], "y", ["a"]).first().coef is None
    assert leastsq.least_squares(few.limit(0), ["g"], "y", ["a"]).count() == 0
    one = leastsq.least_squares(spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(5)], "a double, y double"), [], "y", ["a"]).first()
    assert one.coef == pytest.approx([1, 3]) and one.r2 == pytest.approx(1)


@pytest.mark.parametrize("lags", [None, 3])
def test_unit_roots_of_fifty_series(spark, lags):
    rng = np.random.default_rng(1)
    series = {}
    for s in range(50):
        n, e = int(rng.integers(25, 160)), rng.normal(size=200)
        x = np.zeros(n)
        for i in range(1, n):
            x[i] = (1.0 if s % 2 else 0.6) * x[i - 1] + e[i] + (0.5 * e[i - 1] if s % 3 else 0)
        series[s] = (1000 + x).tolist()
    rows = frame(spark, series).unionByName(spark.createDataFrame([(s, DAY - dt.timedelta(days=1), None) for s in range(50)] + [(90, DAY, 1.0), (91, DAY, None)], "symbol long, date date, x double"))
    rows = rows.unionByName(frame(spark, {92: [5.0] * 40}))
    got = {r.symbol: r for r in leastsq.unit_root(rows, ["symbol"], "date", "x", lags).collect()}
    for s, x in series.items():
        n, m, t = plain_unit_root(np.array(x), lags=lags)
        assert (got[s].n, got[s].lags) == (n, m) and got[s].statistic == pytest.approx(t, rel=1e-6), s
        assert got[s].p_value == pytest.approx(float(tails.unit_root(np.array(t))), abs=1e-9)
    assert got[92].statistic is None and 91 not in got


def test_response_surfaces_at_their_critical_values():
    for k in (1, 2):
        for share, c in zip((0.01, 0.05, 0.1), tails.unit_root_critical(np.array([10**9]), k)[0]):
            assert tails.unit_root(np.array(c), k) == pytest.approx(share, rel=0.05)
    assert tails.unit_root(np.array([-30.0, 5.0])).tolist() == [0, 1]


def test_tails_of_f_and_chi_squared():
    rng = np.random.default_rng(2)
    for a, b in ((1, 10), (3, 40), (12, 5)):
        x = rng.chisquare(a, 400_000) / a / (rng.chisquare(b, 400_000) / b)
        for q in (0.5, 1.5, 3.0):
            assert tails.f_above(q, a, b) == pytest.approx((x > q).mean(), abs=4e-3)
    assert tails.chi2_above(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9) and tails.chi2_above(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert tails.chi2_above(0.0, 3) == 1 and math.isnan(tails.f_above(math.nan, 1, 2))


def pair_frame(spark, pairs):
    rows = [(s, DAY + dt.timedelta(days=i), float(a), float(b)) for s, (y, x) in pairs.items() for i, (a, b) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "symbol long, date date, y double, x double")


def test_cointegration_of_pairs(spark):
    rng = np.random.default_rng(3)
    pairs = {}
    for s in range(20):
        n = int(rng.integers(40, 120))
        x = 50 + np.cumsum(rng.normal(size=n))
        pairs[s] = (3 + 2 * x + rng.normal(size=n) if s % 2 else 9 + np.cumsum(rng.normal(size=n))), x
    pairs[30] = np.arange(30.0), np.ones(30)
    got = {r.symbol: r for r in leastsq.cointegration(pair_frame(spark, pairs), ["symbol"], "date", "y", "x").collect()}
    for s in range(20):
        y, x = pairs[s]
        b, _ = fit(np.c_[np.ones(len(x)), x], y)
        n, m, t = plain_unit_root(y - b[0] - b[1] * x, constant=False)
        assert (got[s].n, got[s].lags) == (n, m) and got[s].statistic == pytest.approx(t, rel=1e-6)
        assert got[s].critical_5 == pytest.approx(-3.33613 - 6.1101 / (len(x) - 1) - 6.823 / (len(x) - 1) ** 2)
    assert np.mean([got[s].p_value < 0.05 for s in range(1, 20, 2)]) == 1 and 30 not in got


def test_granger_equals_two_fits(spark):
    rng = np.random.default_rng(4)
    pairs = {}
    for s in range(8):
        x, y = rng.normal(size=90), rng.normal(size=90)
        y[2:] += 0.8 * x[:-2]
        pairs[s] = 100 + y, 5 + x
    pairs[20] = rng.normal(size=6), rng.normal(size=6)
    got = {(r.symbol, r.direction, r.lag): r for r in leastsq.granger(pair_frame(spark, pairs), ["symbol"], "date", "y", "x", 3).collect()}
    assert len(got) == 9 * 6
    for s, (y, x) in pairs.items():
        for direction, (a, b) in {"x->y": (y, x), "y->x": (x, y)}.items():
            for j in (1, 2, 3):
                t = np.arange(j, len(a))
                own, both = [np.ones(len(t)), *(a[t - k] for k in range(1, j + 1))], [b[t - k] for k in range(1, j + 1)]
                r = got[s, direction, j]
                free = len(t) - 2 * j - 1
                if free <= 0:
                    assert r.f is None and r.p_value is None
                    continue
                rss, full = fit(np.stack(own, axis=1), a[t])[1], fit(np.stack(own + both, axis=1), a[t])[1]
                assert r.n == len(t) and r.f == pytest.approx((rss - full) / j / (full / free), rel=1e-6)
    assert max(got[s, "x->y", 2].p_value for s in range(8)) < 1e-3 < min(got[s, "y->x", 1].p_value for s in range(8))


def test_variance_inflation_equals_one_against_the_rest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4)) + 1e4
    x = np.c_[x, x[:, 0] + x[:, 1] + 0.2 * rng.normal(size=400)]
    names = list("abcde")
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in names)).withColumn("still", F.lit(3.0)).repartition(5)
    df = df.unionByName(spark.createDataFrame([(1.0, None, 1.0, 1.0, 1.0, 3.0)], df.schema))
    got = {r.feature: r for r in leastsq.variance_inflation(df, [*names, "still"]).collect()}
    for k, c in enumerate(names):
        rest = np.c_[np.ones(400), np.delete(x, k, axis=1)]
        y = x[:, k]
        assert got[c].vif == pytest.approx(((y - y.mean()) ** 2).sum() / fit(rest, y)[1], rel=1e-6)
    assert got["e"].concern == "severe" and got["c"].concern == "normal" and got["still"].vif is None
    assert leastsq.variance_inflation(df.limit(0), ["a"]).first().vif is None


def test_tests_of_the_variance_of_errors(spark):
    rng = np.random.default_rng(6)
    rows, data = [], {}
    for g in range(6):
        x = rng.normal(size=(150, 2)) * [1, 50] + [3, 900]
        e = rng.normal(size=150) * (np.exp(0.6 * (x[:, 0] - 3)) if g % 2 else 1)
        y = 1 + x @ [2, 0.1] + e
        data[g] = x, y
        rows += [(g, *map(float, a), float(b)) for a, b in zip(x, y)]
    rows += [(9, float(i % 2), 1.0, float(i)) for i in range(12)]
    got = {r.g: r for r in leastsq.heteroscedasticity(spark.createDataFrame(rows, "g long, a double, b double, y double"), ["g"], "y", ["a", "b"]).collect()}
    for g, (x, y) in data.items():
        one = np.ones((150, 1))
        b, _ = fit(np.c_[one, x], y)
        s = (y - np.c_[one, x] @ b) ** 2
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        r2 = lambda m: 1 - fit(m, s)[1] / ((s - s.mean()) ** 2).sum()  # noqa: E731,B023
        second = np.c_[one, z, z[:, :1] ** 2, z[:, :1] * z[:, 1:], z[:, 1:] ** 2]
        assert got[g].breusch_pagan == pytest.approx(150 * r2(np.c_[one, x]), rel=1e-5) and got[g].white == pytest.approx(150 * r2(second), rel=1e-5)
        assert (got[g].white_p < 0.01) == bool(g % 2)
    assert 9 not in got


# ---- regimes


def plain_markov(x, k, rounds):
    """Expectation-maximisation by loops over values and regimes, from the same starting values."""
    mean, var, p, start, floor = regimes.first_guess(np.array(x), k)
    mean, var, p, start = mean.tolist(), var.tolist(), p.tolist(), start.tolist()
    trace, ks = [], range(k)
    for r in range(rounds):
        e = [[math.exp(-((v - mean[i]) ** 2) / 2 / var[i]) / math.sqrt(2 * math.pi * var[i]) for i in ks] for v in x]
        f, c = [], []
        for t in range(len(x)):
            a = [(start[i] if t == 0 else sum(f[-1][j] * p[j][i] for j in ks)) * e[t][i] for i in ks]
            c.append(sum(a))
            f.append([v / c[-1] for v in a])
        b = [[1.0] * k]
        for t in range(len(x) - 1, 0, -1):
            b.insert(0, [sum(p[i][j] * e[t][j] * b[0][j] for j in ks) / c[t] for i in ks])
        trace.append(sum(map(math.log, c)))
        if r == rounds - 1:
            break
        g = [[f[t][i] * b[t][i] for i in ks] for t in range(len(x))]
        moves = [[sum(f[t][i] * p[i][j] * e[t + 1][j] * b[t + 1][j] / c[t + 1] for t in range(len(x) - 1)) for j in ks] for i in ks]
        held = [sum(row[i] for row in g) for i in ks]
        mean = [sum(row[i] * v for row, v in zip(g, x)) / held[i] for i in ks]
        var = [max(sum(row[i] * (v - mean[i]) ** 2 for row, v in zip(g, x)) / held[i], floor) for i in ks]
        p, start = [[m / sum(row) for m in row] for row in moves], g[0]
    return trace, mean, var, p


def switching(rng, n):
    state, out = 0, []
    for _ in range(n):
        state = 1 - state if rng.random() < 0.04 else state
        out.append(float(rng.normal(-0.02 if state else 0.01, 0.06 if state else 0.01)))
    return out


def test_regimes_equal_the_loop_and_likelihood_never_falls():
    rng = np.random.default_rng(7)
    lists = [switching(rng, int(rng.integers(60, 140))) for _ in range(20)]
    for k, common in ((2, False), (3, False), (2, True)):
        trace = []
        got = regimes.settle([np.array(x) for x in lists], k, common, 12, -1.0, trace)
        steps = np.array(trace)
        assert (np.diff(steps, axis=0) > -1e-7).all()
        if common:
            continue
        for i, x in enumerate(lists):
            want, mean, var, p = plain_markov(x, k, 12)
            assert steps[:, i] == pytest.approx(want, rel=1e-8)
            assert regimes.settle([np.array(x)], k, common, 12, -1.0)[0][4] == pytest.approx(got[i][4], rel=1e-9)


def test_regimes_of_pieces_are_those_of_the_whole(spark):
    rng = np.random.default_rng(8)
    series = {s: switching(rng, 60 + 17 * s) for s in range(3)} | {20: [0.1] * 80, 21: switching(rng, 30), 22: [None, *switching(rng, 70), None]}
    rows = frame(spark, series)
    one = {r.symbol: r for r in regimes.markov(rows, ["symbol"], "date", "x", rounds=6).collect()}
    cut = {r.symbol: r for r in regimes.markov(rows, ["symbol"], "date", "x", piece=40, rounds=6).collect()}
    assert set(one) == set(cut) == set(series) and one[20].means is None and one[21].means is None and one[22].n == 70 and cut[20].means is None and cut[21].means is None
    for s in [*range(3), 22]:
        a, b = one[s], cut[s]
        assert b.llf == pytest.approx(a.llf, rel=1e-3) and b.vols == pytest.approx(a.vols, rel=0.02) and (a.n, a.current) == (b.n, b.current)
        assert a.vols[0] < a.vols[1] and a.transition[0] + a.transition[1] == pytest.approx(1) and a.durations[0] == pytest.approx(1 / (1 - a.transition[0]))
    assert regimes.markov(rows.limit(0), ["symbol"], "date", "x").count() == 0


# ---- books


def plain_window(x, weights, lookback):
    """For each date the active symbols and the returns of the dates before."""
    for t in range(x.shape[1]):
        yield t, [i for i in range(len(x)) if abs(weights[i][t] or 0) > 1e-9], x[:, max(0, t - lookback) : t]


@pytest.mark.parametrize("method", optimizers.METHODS)
def test_books_satisfy_the_conditions_of_the_best(spark, method):
    rng = np.random.default_rng(9)
    n, dates, lookback = 9, 40, 20
    x = rng.normal(0.002, 0.01, size=(n, dates)) + 0.01 * rng.normal(size=dates)
    x[8] = 0.004
    x[0, :30:3] = np.nan
    weights = [[float((-1) ** i) * (0.0 if i == 3 and t % 2 or i == 8 and t < 35 else 1 + i) for t in range(dates)] for i in range(n)]
    weights[5][39] = None
    days = [DAY + dt.timedelta(days=t) for t in range(dates)]
    r = spark.createDataFrame([(i, d, None if np.isnan(v) else float(v)) for i in range(n) for d, v in zip(days, x[i])], "symbol long, date date, r double")
    p = spark.createDataFrame([(i, d, w) for i in range(n) for d, w in zip(days, weights[i])], "symbol long, date date, weight double").withColumn("date2", F.lit(1))
    got = {((q.date - DAY).days, q.symbol): q.weight for q in optimizers.optimise(r, p.drop("date2"), method, lookback).collect()}
    assert len(got) == n * dates
    for t, active, window in plain_window(x, weights, lookback):
        w = np.array([got[t, i] for i in active])
        if t < lookback:
            assert w.tolist() == [weights[i][t] for i in active]
            continue
        assert np.abs(w).sum() == pytest.approx(1) and all(np.sign(v) in (0, (-1) ** i) for i, v in zip(active, w))
        y = np.abs(w)
        cov = np.array([[np.cov(*window[[i, j]][:, ~np.isnan(window[[i, j]]).any(axis=0)])[0, 1] for j in active] for i in active])
        if 8 in active:
            assert y == pytest.approx(np.full(len(y), 1 / len(y)))
            continue
        cov += 1e-8 * np.diag(cov).mean() * np.eye(len(y))
        risk = cov @ y
        if method == "risk_parity":
            assert y * risk / (y @ risk) == pytest.approx(np.full(len(y), 1 / len(y)), abs=1e-6)
            continue
        aim = np.sqrt(np.diag(cov)) if method == "diversification" else np.array([np.nanmean(window[i]) for i in active])
        if aim.max() <= 0:
            assert y == pytest.approx(np.full(len(y), 1 / len(y)))
            continue
        size = (y @ aim) / (y @ risk)  # of the problem without a sum
        slack = (size * risk - aim) / np.abs(aim).max()
        assert (slack > -1e-5).all() and np.abs(slack[y > 1e-9]).max() < 1e-5
    assert optimizers.optimise(r, p.limit(0).drop("date2"), method, lookback).count() == 0
    # a later return changes nothing before it
    later = r.withColumn("r", F.when(F.col("date") >= F.lit(days[35]), F.col("r") * -3 + 0.1).otherwise(F.col("r")))
    again = {((q.date - DAY).days, q.symbol): q.weight for q in optimizers.optimise(later, p.drop("date2"), method, lookback).collect()}
    assert all(again[k] == pytest.approx(v) if v is not None else again[k] is None for k, v in got.items() if k[0] <= 35)


@pytest.mark.parametrize("log", [True, False])
def test_steps_and_sweeps_find_the_same_book(log):
    rng = np.random.default_rng(4)
    for n, dates in ((1, 9), (2, 9), (12, 40), (25, 10)):
        x = rng.normal(0.002, 0.02, (6, n, dates)) + 0.02 * rng.normal(size=(6, 1, dates))
        s = np.stack([np.atleast_2d(np.cov(k)) for k in x]) + 1e-6 * np.eye(n)
        live = np.ones((6, n), bool)
        live[::2, n // 2 + 1 :] = False
        aim = np.full((6, n), 1 / n) if log else x.mean(axis=2)
        c, b, v = optimizers.unit(s, aim, live, log)
        y, solved = (optimizers.newton if log else optimizers.exchange)(c, b, live)
        assert solved.all() and optimizers.violation(c, b, y, live, log).max() <= 1e-10 and (y >= 0).all() and not y[~live].any()
        assert y / v == pytest.approx(optimizers.descend(s, aim, live, log)[0], rel=1e-6, abs=1e-7)
        assert optimizers.solve(s, aim, live, log) == pytest.approx(y / v)


def test_books_of_series_with_gaps_have_an_answer():
    # more symbols than dates and different gaps: covariances over shared dates are of no common sample
    rng = np.random.default_rng(8)
    books = []
    for _ in range(5):
        x = rng.normal(0.002, 0.02, (20, 18))
        x[rng.random(x.shape) < 0.25] = np.nan
        books.append(x)
    assert min(np.linalg.eigvalsh(optimizers.covariances(x)[1])[0] for x in books) < -1e-6
    for method in optimizers.METHODS:
        for x, w in zip(books, optimizers.weigh(books, method, 0.0, 1e-8)):
            mean, cov = optimizers.covariances(x)
            assert np.isfinite(w).all() and (w >= 0).all() and w.sum() == pytest.approx(1)
            raw = cov + 1e-8 * np.diag(cov).mean() * np.eye(len(w))
            aim = np.sqrt(np.diag(cov)) if method == "diversification" else mean

            def best(s):
                if method == "risk_parity":
                    return np.abs(w * (s @ w) / (w @ s @ w) - 1 / len(w)).max() < 1e-6
                slack = ((w @ aim) / (w @ s @ w) * (s @ w) - aim) / np.abs(aim).max()
                return (slack > -1e-5).all() and np.abs(slack[w > 1e-9]).max() < 1e-5

            assert best(raw) or best(optimizers.definite(raw))


def test_books_that_are_too_large_are_refused(spark):
    r = spark.createDataFrame([(i, DAY + dt.timedelta(days=t), 0.01 * ((i * t) % 7)) for i in range(6) for t in range(8)], "symbol long, date date, r double")
    p = r.select("symbol", "date", F.lit(1.0).alias("weight"))
    with pytest.raises(Exception, match="more than 5 symbols"):
        optimizers.optimise(r, p, "risk_parity", 6, most=5).collect()
    with pytest.raises(ValueError):
        optimizers.optimise(r, p, "other")


# ---- volatility and tails


def simulated(rng, n, omega, alpha, beta):
    s, e, out = omega / (1 - alpha - beta), 0.0, []
    for _ in range(n):
        s = omega + alpha * e * e + beta * s
        e = float(rng.normal() * math.sqrt(s))
        out.append(0.0005 + e)
    return out


def plain_garch(x, mu, omega, alpha, beta):
    x = [100 * v for v in x]
    w = [0.94**i for i in range(min(75, len(x)))]
    m = sum(x) / len(x)
    s = square = sum(a * (v - m) ** 2 for a, v in zip(w, x)) / sum(w)
    out = 0.0
    for v in x:
        s = omega + alpha * square + beta * s
        square = (v - 100 * mu) ** 2
        out -= 0.5 * (math.log(2 * math.pi * s) + square / s)
    return out, s, square


def test_garch_meets_first_order_conditions_and_no_grid_is_better(spark):
    rng = np.random.default_rng(10)
    series = {0: simulated(rng, 900, 2e-6, 0.1, 0.85), 1: simulated(rng, 700, 5e-6, 0.25, 0.6), 2: rng.normal(0, 0.01, 300).tolist(), 3: [0.01] * 50, 4: [0.1, 0.2], 5: [None, *simulated(rng, 400, 1e-5, 0.3, 0.3)]}
    got = {r.symbol: r for r in volatility.garch(frame(spark, series), ["symbol"], "date", "x", horizon=3).collect()}
    assert got[3].mu is None and got[4].n == 2 and got[5].n == 400
    for s in (0, 1, 2, 5):
        r, x = got[s], [v for v in series[s] if v is not None]
        value, last, square = plain_garch(x, r.mu, r.omega, r.alpha, r.beta)
        assert value == pytest.approx(r.llf, rel=1e-8) and r.aic == pytest.approx(8 - 2 * value) and r.current_vol == pytest.approx(math.sqrt(last) / 100)
        ahead = r.omega + r.alpha * square + r.beta * last
        assert r.forecast == pytest.approx([math.sqrt(ahead) / 100, math.sqrt(r.omega + r.persistence * ahead) / 100, math.sqrt(r.omega + r.persistence * (r.omega + r.persistence * ahead)) / 100])
        inner = r.alpha > 1e-4 and r.beta > 1e-4 and r.persistence < 0.9999
        if inner:
            p = [r.mu, r.omega, r.alpha, r.beta]
            for k in range(4):
                h = 1e-4 * max(abs(p[k]), 1e-4)
                up, down = ([v + d * h * (i == k) for i, v in enumerate(p)] for d in (1, -1))
                slope = (plain_garch(x, *up)[0] - plain_garch(x, *down)[0]) / (2 * h)
                assert abs(slope * max(abs(p[k]), 1e-4)) < 1e-2 * math.sqrt(len(x)), (s, k, slope)
        for a in np.linspace(0.01, 0.5, 8):
            for b in np.linspace(0.05, 0.95, 10):
                if a + b < 0.999:
                    for f in (0.5, 1, 2):
                        assert plain_garch(x, r.mu, f * (1 - a - b) * 1e4 * np.var(x), a, b)[0] <= r.llf + 1e-6
    assert got[0].converged and got[0].persistence == pytest.approx(0.95, abs=0.04) and inner is not None
    with pytest.raises(Exception, match="more than 100 values"):
        volatility.garch(frame(spark, {0: series[0]}), ["symbol"], "date", "x", most=100).collect()


def test_pareto_tails_by_scan(spark):
    rng = np.random.default_rng(11)
    series = {s: (-rng.pareto(3.0, 400) * 0.01 if s % 2 else rng.normal(0, 0.01, 400)).tolist() for s in range(6)} | {7: [0.1], 8: [0.5] * 30, 9: [None, float("nan"), 1.0, 2.0, 3.0]}
    got = {r.symbol: r for r in extremes.pareto_tail(frame(spark, series), ["symbol"], "x", 10.0).collect()}
    for s in range(6):
        x = np.array(series[s])
        threshold = np.percentile(x, 10)
        y = threshold - x[x < threshold]
        r = got[s]
        assert r.threshold == pytest.approx(threshold) and r.n_exceedances == len(y) and r.rate == pytest.approx(len(y) / 400)
        ll = lambda shape, scale: -len(y) * math.log(scale) - (1 + 1 / shape) * np.log1p(shape * y / scale).sum()  # noqa: E731,B023
        own = ll(r.shape, r.scale)
        for shape in np.linspace(-0.4, 1.2, 41):
            for f in np.linspace(0.5, 2, 31):
                if abs(shape) > 1e-6 and (1 + shape * y / (f * y.mean())).min() > 0:
                    assert ll(shape, f * y.mean()) <= own + 1e-6
        assert r.shape_se == pytest.approx(abs(1 + r.shape) / math.sqrt(len(y)))
    assert 7 not in got or got[7].shape is None
    assert extremes.pareto_tail(frame(spark, {0: [1.0]}).limit(0), ["symbol"], "x").count() == 0
