"""Operators that SQL can't express, beside plain loops; guards; sinks that are run again."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantweave import data
from quantweave.operators import attribution, clusters, indicators, pairs, stats, ts
from quantweave.operators.ewm import Ewm, ewm
from quantweave.streaming import streams

DAY = dt.date(2024, 1, 1)


def walk(rng, n, gaps=0.05):
    x = 100 + np.cumsum(rng.normal(0, 2, n))
    return [None if rng.random() < gaps else float(round(v, 2)) for v in x]


def series(spark, columns):
    rows = [(s, DAY + dt.timedelta(days=i), v) for s, x in enumerate(columns) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "symbol long, date date, close double")


def turns(x, w):
    """Places of peaks and of valleys: the largest or least of whole windows, gaps passed over."""
    peaks, valleys = [], []
    for i in range(w, len(x) - w):
        around = [v for v in x[i - w : i + w + 1] if v is not None]
        if x[i] is not None:
            peaks += [i] if x[i] == max(around) else []
            valleys += [i] if x[i] == min(around) else []
    return peaks, valleys


def test_support_and_resistance(spark):
    rng = np.random.default_rng(1)
    columns = [walk(rng, 120) for _ in range(4)] + [[5.0] * 30, [None] * 20]
    got = {}
    for r in indicators.support_resistance(series(spark, columns), 3, 3).collect():
        got.setdefault(r.symbol, []).append((r["rank"], round(r.level, 6), r.touches))
    for s, x in enumerate(columns):
        peaks, valleys = turns(x, 3)
        prices = sorted(x[i] for i in {*peaks, *valleys})
        groups = []
        for p in prices:
            if groups and p - sum(groups[-1]) / len(groups[-1]) <= 0.05 * (prices[-1] - prices[0]):
                groups[-1].append(p)
            else:
                groups.append([p])
        groups.sort(key=lambda g: (-len(g), sum(g) / len(g)))
        assert sorted(got.get(s, [])) == [(k + 1, round(sum(g) / len(g), 6), len(g)) for k, g in enumerate(groups[:3])]


def slope(y):
    k = len(y)
    mx, my = (k - 1) / 2, sum(y) / k
    return sum((i - mx) * (v - my) for i, v in enumerate(y)) / sum((i - mx) ** 2 for i in range(k))


def test_triangles_and_broadening(spark):
    rng = np.random.default_rng(2)
    n, w = 20, 4
    swing = [100 + (1 if (i // 5) % 2 else -1) * (i // 5 + 1) * (1 + (i % 5) / 10) for i in range(90)]
    fold = [100 + (10 if (i // 5) % 2 else -(10 - i / 6)) for i in range(60)]
    columns = [walk(rng, 150, 0.02) for _ in range(5)] + [[float(v) for v in swing], [float(v) for v in fold]]
    got = {(r.symbol, (r.date - DAY).days): (r.triangle, r.broadening) for r in indicators.shapes(series(spark, columns), n).collect()}
    seen = set()
    for s, x in enumerate(columns):
        for at in range(len(x)):
            want = (0, 0)
            if at >= n:
                part = x[at - n : at + 1]
                # gaps are passed over inside a window
                known = lambda i: [v for v in part[i - w : i + w + 1] if v is not None]
                p = [part[i] for i in range(w, len(part) - w) if part[i] is not None and part[i] == max(known(i))]
                v = [part[i] for i in range(w, len(part) - w) if part[i] is not None and part[i] == min(known(i))]
                if len(p) >= 2 and len(v) >= 2:
                    flat, triangle = 0.02 * (max(p) - min(v)), 0
                    if max(p) != min(v):
                        if slope(v) > flat and abs(slope(p)) < flat:
                            triangle = 1
                        elif slope(p) < -flat and abs(slope(v)) < flat:
                            triangle = -1
                    want = triangle, int(all(a < b for a, b in zip(p, p[1:])) and all(a > b for a, b in zip(v, v[1:])))
            assert got[s, at] == want, (s, at)
            seen.add(want)
    assert len({b for _, b in seen}) == 2


def water_fill(m, cap):
    """The rule as it is told: clip, hand on in proportion, again."""
    m = list(m)
    while any(x > cap + 1e-12 for x in m):
        excess = sum(x - cap for x in m if x > cap)
        m = [min(x, cap) for x in m]
        base = sum(x for x in m if x < cap - 1e-12)
        if base <= 1e-12:
            break
        m = [x + x / base * excess if x < cap - 1e-12 else x for x in m]
    return m


def lift(m, floor):
    while any(x < floor - 1e-12 for x in m):
        need, spare = sum(floor - x for x in m if x < floor), sum(x - floor for x in m if x > floor + 1e-12)
        if spare <= 1e-12:
            return [sum(m) / len(m)] * len(m)
        m = [floor if x < floor - 1e-12 else x - (x - floor) / spare * need if x > floor + 1e-12 else x for x in m]
    return m


@pytest.mark.parametrize("cap, floor, group_cap", [(0.2, None, None), (None, 0.05, None), (0.12, 0.06, 0.3), (0.02, None, None), (None, 0.5, None), (0.9, 0.001, 0.9)])
def test_weight_rules(spark, cap, floor, group_cap):
    rng = np.random.default_rng(3)
    books = {d: [float(w) for w in rng.dirichlet(np.ones(12) * 0.5) * rng.choice([-1, 1], 12)] for d in range(6)}
    books[6] = [0.5, 0.5] + [0.0] * 10
    books[7] = [0.25] * 4 + [0.0] * 8
    rows = [(s, DAY + dt.timedelta(days=d), w, s % 3) for d, ws in books.items() for s, w in enumerate(ws)] + [(99, DAY, None, 0)]
    frame = spark.createDataFrame(rows, "symbol long, date date, weight double, grp long")
    got = {((r.date - DAY).days, r.symbol): r.weight for r in attribution.constrain(frame, cap, floor, "grp" if group_cap else None, group_cap).collect()}
    assert got.pop((0, 99)) is None
    for d, ws in books.items():
        at = [s for s, w in enumerate(ws) if abs(w) > 1e-9]
        m = [abs(ws[s]) for s in at]
        m = water_fill(m, cap) if cap else m
        m = lift(m, floor) if floor else m
        if group_cap:
            total = {g: sum(x for s, x in zip(at, m) if s % 3 == g) for g in range(3)}
            m = [x * min(1, group_cap / total[s % 3]) for s, x in zip(at, m)]
        want = dict.fromkeys(range(12), 0.0) | {s: x * np.sign(ws[s]) for s, x in zip(at, m)}
        for s, w in want.items():
            assert got[d, s] == pytest.approx(w, abs=1e-9), (d, s)


def test_multiple_testing_over_ranges(spark):
    rng = np.random.default_rng(4)
    p = [*np.round(rng.random(200) ** 3, 3).tolist(), 0.0, 1.0, *[0.01] * 50]
    got = {r.id: (r.adjusted, r.rejected) for r in stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "id long, p double"), 0.05).collect()}
    order = sorted(range(len(p)), key=lambda i: (p[i], i))
    least = 1.0
    for k in range(len(p) - 1, -1, -1):
        i = order[k]
        least = min(least, p[i] * len(p) / (k + 1))
        assert got[i] == (pytest.approx(least), least <= 0.05)
    assert stats.benjamini_hochberg(spark.createDataFrame([], "id long, p double"), 0.05).count() == 0


def test_clusters_and_their_rules(spark):
    held = set(spark.sparkContext._jsc.getPersistentRDDs())
    rng = np.random.default_rng(5)
    centre = np.array([[0, 0], [10, 0], [0, 10]])
    rows = [(i, *map(float, centre[i % 3] + rng.normal(0, 0.5, 2))) for i in range(150)] + [(999, None, 1.0)]
    found = clusters.auto_cluster(spark.createDataFrame(rows, "id long, x double, y double"), ["x", "y"], 5)
    own = {r.id: r.cluster for r in found.collect()}
    assert len(own) == 150 and [len({own[i] for i in range(k, 150, 3)}) for k in range(3)] == [1, 1, 1] and len(set(own.values())) == 3
    for r in clusters.rules(found, ["x", "y"]).collect():
        members = np.array([row[1:] for row in rows if own.get(row[0]) == r.cluster])
        assert r.support == 50 and r.coverage == pytest.approx(1 / 3)
        for j, f in enumerate("xy"):
            lo, hi = np.quantile(members[:, j], [0.1, 0.9])
            assert r[f"{f}_lo"] == pytest.approx(lo) and r[f"{f}_hi"] == pytest.approx(hi)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == held


def test_guards(spark):
    rows = spark.createDataFrame([(1, dt.date(1, 1, 1), 1.0), (1, dt.date(2024, 1, 1), 1.0)], "symbol long, date date, close double")
    with pytest.raises(Exception, match="500 years"):
        data.densify(rows).count()
    many = spark.range(30).select(F.col("id").alias("k"), F.lit(DAY).alias("date"), F.lit(1.0).alias("r"))
    assert pairs.pair_rows(many, "k").count() == 435
    with pytest.raises(Exception, match="more than 20 series"):
        pairs.pair_rows(many, "k", most=20).count()


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    for _ in range(2):
        streams.keep_batch(rows, 0, str(tmp_path / "out"))
    streams.keep_batch(rows, 1, str(tmp_path / "out"))
    assert sorted((r.k, r.batch) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 0), (1, 1)]


def test_states_over_several_batches(spark, tmp_path):
    at = lambda i: dt.datetime(2024, 1, 1, 0, i)
    parts = [[(1, 1, at(1), 400.0), (2, 2, at(2), 50.0)], [(3, 1, at(3), 10.0), (4, 2, at(0), 500.0)], [(5, 1, at(2), 600.0)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "event_id long, user_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in streams.run_to_end(streams.regime(stream, 300.0, 20.0), "update", ["user_id"]).collect())
    # one row a key; the last decisive value by event time decides, whichever batch brings it
    assert got == [(1, 0, 3), (2, 1, 2)]


@pytest.mark.parametrize("adjust, least", [(False, 1), (True, 1), (True, 4)])
def test_averages_beside_pandas(spark, adjust, least):
    import pandas as pd

    rng = np.random.default_rng(6)
    columns = {s: [None if rng.random() < 0.2 else float(rng.normal()) for _ in range(int(rng.integers(1, 40)))] for s in [*range(25), None]}
    rows = [(s, DAY + dt.timedelta(days=i), v) for s, x in columns.items() for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "symbol long, date date, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.symbol, r.date): r.y for r in ewm(frame, {"y": Ewm("x", 0.3, adjust, least)}).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for s, x in columns.items():
        want = pd.Series(x, dtype=float).ewm(alpha=0.3, adjust=adjust, min_periods=least).mean()
        for i, w in enumerate(want):
            y = got[s, DAY + dt.timedelta(days=i)]
            assert (y is None or np.isnan(y)) if np.isnan(w) else y == pytest.approx(w)


def test_ranks_and_places_are_the_same_by_terms_and_by_arrays(spark, monkeypatch):
    rng = np.random.default_rng(7)
    frame = series(spark, [[None if rng.random() < 0.05 else float(rng.integers(6)) for _ in range(60)] for _ in range(3)])
    results = []
    for most in (12, 0):
        monkeypatch.setattr(ts, "TERMS", most)
        c = F.col("close")
        results.append(sorted(map(str, frame.select("symbol", "date", ts.ts_rank(c, 9).alias("r"), ts.ts_argmax(c, 9).alias("a"), ts.ts_argmin(c, 9).alias("b"), ts.ts_rank(c, 1).alias("o")).collect())))
    assert results[0] == results[1]


def test_headlines_are_scored_by_trimmed_words(spark):
    from quantweave.functions import scalar

    texts = {"Profit beats; (growth)!": 1.0, "Lawsuit/probe, record": -1 / 3, "PROFITABLE beaten": 0.0, "": 0.0, None: 0.0, "'loss' wins": 0.0}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.s for r in frame.select("t", scalar.lexicon_score(F.col("t")).alias("s")).collect()} == {t: pytest.approx(v) for t, v in texts.items()}
