"""Operators on tiny frames: warm-up, nulls, ties, constant windows, and no look-ahead."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantweave.operators import asof, attribution, bench, chains, ts, xs
from quantweave.operators.ewm import Ewm, ewm
from quantweave.operators.journal import apply_filter, pair_fifo
from quantweave.sources import readers

C = F.col


def frame(spark, columns: dict[str, list[float | None]], symbols: int = 1):
    n = len(next(iter(columns.values())))
    data = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), *[None if v[i] is None else float(v[i]) for v in columns.values()]) for s in range(symbols) for i in range(n)]
    return spark.createDataFrame(data, "symbol long, date date, " + ", ".join(f"{c} double" for c in columns))


def values(df, c="v"):
    return [r[c] for r in df.orderBy("symbol", "date").collect()]


def test_windows_wait_until_full_and_stop_at_nulls(spark):
    df = frame(spark, {"x": [1, 2, None, 4, 5, 6]})
    assert values(df.withColumn("v", ts.ts_mean(C("x"), 2))) == [None, 1.5, None, None, 4.5, 5.5]
    assert values(df.withColumn("v", ts.ts_max(C("x"), 3))) == [None, None, None, None, None, 6.0]


def test_rolling_against_pandas(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=60), rng.normal(size=60)
    x[[7, 30]] = np.nan
    df = frame(spark, {"x": [None if np.isnan(v) else v for v in x], "y": list(y)})
    p, q = pd.Series(x), pd.Series(y)
    for got, want in (
        (ts.ts_std(C("x"), 5), p.rolling(5).std()), (ts.ts_cov(C("x"), C("y"), 6), p.rolling(6).cov(q)), (ts.ts_corr(C("x"), C("y"), 6), p.rolling(6).corr(q)),
        (ts.ts_quantile(C("x"), 0.3, 5), p.rolling(5).quantile(0.3)), (ts.ts_skew(C("x"), 8), p.rolling(8).skew()), (ts.ts_rank(C("x"), 5), p.rolling(5).rank(pct=True)),
    ):
        np.testing.assert_allclose(np.array(values(df.withColumn("v", got)), float), want.to_numpy(), atol=1e-9)


def test_constant_window_has_no_correlation(spark):
    df = frame(spark, {"x": [1, 1, 1, 1], "y": [1, 2, 3, 4]})
    assert values(df.withColumn("v", ts.ts_corr(C("x"), C("y"), 3))) == [None] * 4


def test_ties_of_argmax_and_rank(spark):
    df = frame(spark, {"x": [3, 1, 3, 2]})
    assert values(df.withColumn("v", ts.ts_argmax(C("x"), 3)))[2:] == [0.0, 1.0]
    assert values(df.withColumn("v", ts.ts_rank(C("x"), 3)))[2] == pytest.approx(2.5 / 3)


def test_decay_weighs_the_oldest_most(spark):
    df = frame(spark, {"x": [1, 2, 3]})
    assert values(df.withColumn("v", ts.decay_linear(C("x"), 3)))[2] == pytest.approx((3 * 1 + 2 * 2 + 1 * 3) / 6)
    assert values(df.withColumn("v", ts.decay_linear(C("x"), 3, newest_first=True)))[2] == pytest.approx((1 * 1 + 2 * 2 + 3 * 3) / 6)


def test_lags_below_one_are_refused(spark):
    with pytest.raises(ValueError):
        ts.delta(C("x"), 0)


def test_returns_carry_the_last_price(spark):
    df = frame(spark, {"x": [10, None, 12, 0, 5]})
    assert values(df.withColumn("v", ts.bar_returns(C("x")))) == pytest.approx([0.0, 0.0, 0.2, -1.0, 0.0])


def test_no_operator_looks_ahead(spark):
    rng = np.random.default_rng(2)
    x = list(rng.uniform(1, 2, 40))
    changed = x[:30] + list(rng.uniform(50, 60, 10))
    ops = [ts.ts_mean(C("x"), 5), ts.ts_rank(C("x"), 5), ts.decay_linear(C("x"), 4), ts.slope(C("x"), 6), ts.forward_fill(C("x")), ts.bar_returns(C("x")), ts.ts_corr(C("x"), C("x") * C("x"), 5)]
    for op in ops:
        a, b = (values(frame(spark, {"x": v}).withColumn("v", op))[:30] for v in (x, changed))
        assert a == b


def test_cross_section(spark):
    df = spark.createDataFrame([(i, dt.date(2024, 1, 1), v) for i, v in enumerate([1.0, 2.0, 2.0, None, 5.0])], "symbol long, date date, x double")
    assert values(df.withColumn("v", xs.rank(C("x")))) == [0.25, 0.625, 0.625, None, 1.0]
    assert sum(abs(v) for v in values(df.withColumn("v", xs.scale(C("x")))) if v is not None) == pytest.approx(1)
    same = df.withColumn("x", F.lit(3.0))
    assert values(same.withColumn("v", xs.zscore(C("x")))) == [None] * 5


def test_ewm_equals_pandas(spark):
    x = [1.0, None, 3.0, 2.0, 5.0]
    got = values(ewm(frame(spark, {"x": x}), {"v": Ewm("x", 0.3)}))
    np.testing.assert_allclose(got, pd.Series(x, dtype=float).ewm(alpha=0.3, adjust=False).mean())


def test_asof_is_backward_and_strict_on_demand(spark):
    left = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (2, 2, "c")], "k int, at int, v string")
    loose = asof.asof_join(left, right, ["k"], "t", "at")
    assert sorted((r.k, r.t, r.v) for r in loose.collect()) == [(1, 5, "a"), (1, 7, "b"), (2, 1, None)]
    strict = asof.asof_join(left, right, ["k"], "t", "at", strict=True)
    assert sorted((r.t, r.v) for r in strict.collect() if r.k == 1) == [(5, None), (7, "b")]


def test_restatements_of_old_periods_do_not_regress(spark):
    s = spark.createDataFrame([(1, "2023-12-31", "2024-02-01"), (1, "2024-03-31", "2024-05-01"), (1, "2023-12-31", "2024-06-01")], "e int, period string, filed string")
    assert [r.filed for r in asof.no_regress(s, ["e"], "period", "filed").orderBy("filed").collect()] == ["2024-02-01", "2024-05-01"]


def test_fifo_against_a_loop(spark):
    rng = np.random.default_rng(3)
    data, lots, want = [], [], []
    for i in range(200):
        side, q, p = ("buy", "sell")[int(rng.random() < 0.5)], float(rng.integers(1, 40)), float(rng.integers(10, 20))
        data.append((1, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), side, q, p, q * p, 0.0))
        if side == "buy":
            lots.append([i, q])
        else:
            while q > 0 and lots:
                take = min(q, lots[0][1])
                want.append((lots[0][0], i, take))
                lots[0][1] -= take
                q -= take
                if lots[0][1] == 0:
                    lots.pop(0)
    t = spark.createDataFrame(data, "symbol long, seq long, ts timestamp, side string, quantity double, price double, amount double, fee double")
    assert sorted((r.buy_seq, r.sell_seq, r.quantity) for r in pair_fifo(t).collect()) == sorted(want)


def test_large_trades_are_matched_without_buckets(spark):
    data = [(s, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), ("buy", "sell")[i % 2], 1e8, 2.0, 2e8, 0.0) for s in (1, 2) for i in range(40)]
    data += [(3, 0, dt.datetime(2024, 1, 1), "sell", 5.0, 1.0, 5.0, 0.0), (3, 1, dt.datetime(2024, 1, 2), "buy", 0.0, 1.0, 0.0, 0.0), (4, 0, None, None, None, None, None, None)]
    t = spark.createDataFrame(data, "symbol long, seq long, ts timestamp, side string, quantity double, price double, amount double, fee double")
    got = sorted((r.symbol, r.buy_seq, r.sell_seq, r.quantity) for r in pair_fifo(t).collect())
    assert got == [(s, i, i + 1, 1e8) for s in (1, 2) for i in range(0, 40, 2)]
    assert pair_fifo(t.limit(0)).count() == 0


def test_hysteresis_equals_the_loop(spark):
    rng = np.random.default_rng(4)
    x = list(rng.random(80))
    state, want = 0, []
    for v in x:
        state = 1 if not state and v >= 0.7 else 0 if state and v <= 0.3 else state
        want.append(state)
    assert values(chains.hysteresis(frame(spark, {"x": x}), "x", 0.7, 0.3, ["symbol"]), "state") == want
    with pytest.raises(ValueError):
        chains.hysteresis(frame(spark, {"x": x}), "x", 0.3, 0.7, ["symbol"])


def test_filters(spark):
    t = spark.createDataFrame([(dt.datetime(2024, 3, 31, 23), "Buy"), (dt.datetime(2024, 4, 1), "sell")], "ts timestamp, side string")
    assert apply_filter(t, "2024-03 to 2024-03").count() == 1 and apply_filter(t, "side=BUY").count() == 1
    for bad in ("2024-05 to 2024-03", "nothing=1", "?"):
        with pytest.raises(ValueError):
            apply_filter(t, bad)


def test_bad_bars(spark):
    b = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5), (1.0, 0.9, 0.5, 0.8), (-1.0, 2.0, -2.0, 1.0), (None, 2.0, 1.0, 1.5)], "open double, high double, low double, close double")
    assert readers.validate_ohlc(b).count() == 1
    assert readers.validate_ohlc(b, allow_nonpositive=True).count() == 2
    with pytest.raises(Exception):
        readers.validate_ohlc(b, "raise").count()


def test_constraints_keep_signs_and_caps(spark):
    w = spark.createDataFrame([(i, dt.date(2024, 1, 1), v) for i, v in enumerate([0.6, -0.3, 0.1, 0.001])], "symbol long, date date, weight double")
    got = [r.weight for r in attribution.constrain(w, 0.4, 0.01).orderBy("symbol").collect()]
    # a small weight is lifted to the floor, and the book stays as large as it was
    assert max(map(abs, got)) <= 0.4 + 1e-9 and got[1] < 0 and got[3] == pytest.approx(0.01) and sum(map(abs, got)) == pytest.approx(1.001)


def test_groups_without_members_and_short_dates(spark):
    p = spark.createDataFrame([(i, dt.date(2024, 1, 1), float(i), 0.1) for i in range(6)] + [(0, dt.date(2024, 1, 2), 1.0, 0.5)], "symbol long, date date, f double, y double")
    got = bench.group_equity(p, 5).collect()
    assert {r.date for r in got} == {dt.date(2024, 1, 1)} and len(got) == 5
