"""Markov switching: hidden regimes of a series, each with its own mean and variance, fitted for every key.

A series is packed into pieces of at most `piece` values. What a piece does to the belief about the regime is a small
matrix, so pieces are worked through side by side: their matrices are multiplied in order of the key (boundaries),
and then each piece is smoothed between its two ends. A round of expectation-maximisation takes only sums from the pieces.
Keys of a single piece need no exchange: they are fitted whole, many in a batch, until each has settled. Longer keys
go through rounds of sums, and leave the loop as they settle.

Regimes are numbered by rising volatility. Starting values are slices of the values by distance from the median, so
a fit has no chance in it. Defined cases: null values are left out; keys with fewer than `least` values, or whose
values are all alike, get nulls; a variance isn't let below a millionth of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored

FIT = "n long, llf double, aic double, bic double, rounds int, converged boolean, means array<double>, vols array<double>, transition array<double>, durations array<double>, current int, probability double"
STATE = "n long, mean array<double>, var array<double>, p array<double>, start array<double>, floor double, llf double, rounds int, done boolean, last array<double>"


def emissions(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Densities (series, time, regime), each time's largest taken out, and the logarithms of those."""
    log = -0.5 * (np.log(2 * np.pi * var)[:, None, :] + (x[:, :, None] - mean[:, None, :]) ** 2 / var[:, None, :])
    top = log.max(axis=2)
    return np.exp(log - top[:, :, None]), top


def transfer(x: np.ndarray, mask: np.ndarray, mean: np.ndarray, var: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The matrix of each piece: from the belief before its first value to that after its last, up to a factor."""
    e, _ = emissions(x, mean, var)
    out = np.broadcast_to(np.eye(mean.shape[1]), p.shape).copy()
    for t in range(x.shape[1]):
        step = (out * e[:, t, None, :]) @ p
        step /= step.max(axis=(1, 2), keepdims=True)
        out = np.where(mask[:, t, None, None], step, out)
    return out


def smooth(x: np.ndarray, mask: np.ndarray, mean: np.ndarray, var: np.ndarray, p: np.ndarray, before: np.ndarray, after: np.ndarray, goes_on: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of each piece between the belief before it and the likelihood of what comes after it, and the regimes' probabilities.

    goes_on: the series has a value after the piece, so its last step is a transition too.
    """
    e, top = emissions(x, mean, var)
    n, steps, k = e.shape
    seen, belief, llf = np.zeros((n, steps, k)), before, np.zeros(n)
    for t in range(steps):
        f = belief * e[:, t]
        total = f.sum(axis=1, keepdims=True)
        f = f / total
        live = mask[:, t]
        seen[:, t] = f
        belief = np.where(live[:, None], np.einsum("nk,nkj->nj", f, p), belief)
        llf += np.where(live, np.log(total[:, 0]) + top[:, t], 0.0)
    shares, moves, back = np.zeros((n, steps, k)), np.zeros((n, k, k)), after
    more = goes_on.copy()
    for t in range(steps - 1, -1, -1):
        live = mask[:, t]
        ahead = np.einsum("nij,nj->ni", p, back)
        g = seen[:, t] * ahead
        g /= g.sum(axis=1, keepdims=True)
        shares[:, t] = np.where(live[:, None], g, 0.0)
        pair = seen[:, t, :, None] * p * back[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        moves += np.where((live & more)[:, None, None], pair, 0.0)
        step = e[:, t] * ahead
        back = np.where(live[:, None], step / step.max(axis=1, keepdims=True), back)
        more |= live
    held = shares.sum(axis=1)
    return {"held": held, "sum": np.einsum("ntk,nt->nk", shares, x), "square": np.einsum("ntk,nt->nk", shares, x * x), "moves": moves, "llf": llf, "shares": shares}


def renewed(held, total, square, moves, first, floor, common: bool) -> tuple[np.ndarray, ...]:
    """Parameters of largest expected likelihood from sums."""
    safe = np.maximum(held, 1e-300)
    mean = total / safe
    rest = np.maximum(square - total * mean, 0.0)
    var = np.broadcast_to(rest.sum(axis=1, keepdims=True) / held.sum(axis=1, keepdims=True), rest.shape) if common else rest / safe
    out = moves.sum(axis=2, keepdims=True)
    p = np.where(out > 1e-300, moves / np.maximum(out, 1e-300), np.eye(held.shape[1])[None])
    return mean, np.maximum(var, floor[:, None]), p, first


def first_guess(values: np.ndarray, k: int, common: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean and variance of slices by distance from the median (by value, for one variance), regimes that last, and the least variance allowed."""
    away = np.argsort(values if common else np.abs(values - np.median(values)), kind="stable")
    whole = float(values.var())
    slices = np.array_split(values[away], k)
    mean = np.array([s.mean() for s in slices])
    var = np.array([max(float(((s - values.mean()) ** 2).mean()), 1e-3 * whole) for s in slices])
    if common:
        var = np.full(k, max(float(np.mean([s.var() for s in slices])), 1e-3 * whole))
    p = np.full((k, k), 0.1 / (k - 1)) + np.eye(k) * (0.9 - 0.1 / (k - 1))
    return mean, var, p, np.full(k, 1 / k), max(1e-6 * whole, 1e-300)


def padded(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(lists), max(map(len, lists))))
    mask = np.zeros(x.shape, bool)
    for i, v in enumerate(lists):
        x[i, : len(v)], mask[i, : len(v)] = v, True
    return x, mask


def settle(lists: list[np.ndarray], k: int, common: bool, most: int, tol: float, trace: list | None = None) -> list[tuple]:
    """All rounds for whole series: mean, var, p, start, llf, rounds, converged, probabilities of the last value's regimes."""
    guesses = [first_guess(v, k, common) for v in lists]
    mean, var, p, start, floor = (np.stack([np.asarray(g[i]) for g in guesses]) for i in range(5))
    x, mask = padded(lists)
    n = len(lists)
    ones, no = np.ones((n, k)), np.zeros(n, bool)
    llf, rounds, done, last = np.full(n, -np.inf), np.zeros(n, int), np.zeros(n, bool), np.zeros((n, k))
    ends = mask.sum(axis=1) - 1
    for r in range(1, most + 1):
        at = np.flatnonzero(~done)
        s = smooth(x[at], mask[at], mean[at], var[at], p[at], start[at], ones[at], no[at])
        last[at], rounds[at] = s["shares"][np.arange(len(at)), ends[at]], r
        gain = s["llf"] - llf[at]
        llf[at] = s["llf"]
        if trace is not None:
            trace.append(llf.copy())
        over = gain <= tol * (1 + np.abs(s["llf"]))
        done[at[over]] = True
        go = at[~over]
        if not len(go):
            break
        keep = ~over
        mean[go], var[go], p[go], start[go] = renewed(s["held"][keep], s["sum"][keep], s["square"][keep], s["moves"][keep], s["shares"][keep, 0], floor[go], common)
    return [(mean[i], var[i], p[i], start[i], float(llf[i]), int(rounds[i]), bool(done[i]), last[i]) for i in range(n)]


def ordered(mean, var, p, last) -> tuple[np.ndarray, ...]:
    order = np.lexsort((mean, var))
    return mean[order], np.sqrt(var[order]), p[np.ix_(order, order)], last[order]


def _summary(n: int, mean, var, p, llf: float, rounds: int, done: bool, last, common: bool) -> tuple:
    mean, vol, p, last = ordered(mean, var, p, last)
    k = len(mean)
    free = k + (1 if common else k) + k * (k - 1)
    return n, llf, 2 * free - 2 * llf, free * np.log(n) - 2 * llf, rounds, done, mean.tolist(), vol.tolist(), p.ravel().tolist(), (1 / np.maximum(1 - np.diag(p), 1e-12)).tolist(), int(last.argmax()), float(last.max())


def pieces(rows: DataFrame, keys: list[str], at: str, value: str, piece: int) -> DataFrame:
    """keys, part, parts, n (values of the key), x: values in order, at most `piece` a row."""
    w = Window.partitionBy(*keys)
    x = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_x"), (F.row_number().over(w.orderBy(at)) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("n"))
    packed = x.groupBy(*keys, "n", F.floor(F.col("_i") / piece).alias("part")).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_v"))
    return packed.select(*keys, "part", F.ceil(F.col("n") / piece).alias("parts"), "n", F.col("_v._x").alias("x"))


def _arrow(df: DataFrame, keys: list[str], schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    target = StructType([f for f in df.schema.fields if f.name in keys] + _parse_datatype_string(schema).fields)
    return target, to_arrow_schema(target)


def _batch(batch: pa.RecordBatch, keys: list[str], rows: list[tuple], arrow: pa.Schema, take=None) -> pa.RecordBatch:
    index = pa.array(range(batch.num_rows) if take is None else take, pa.int64())
    made = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), [f for f in arrow if f.name not in keys])] if rows else [pa.array([], f.type) for f in arrow if f.name not in keys]
    held = iter(made)
    return pa.RecordBatch.from_arrays([batch[f.name].take(index) if f.name in keys else next(held) for f in arrow], schema=arrow)


def markov(rows: DataFrame, keys: list[str], at: str, value: str, k: int = 2, common_variance: bool = False, rounds: int = 500, tol: float = 1e-9, least: int = 50, piece: int = 4096) -> DataFrame:
    """keys and the fit of k regimes: n, llf, aic, bic, rounds, converged, means, vols, transition (rows sum to 1), durations, current, probability."""
    if k < 2:
        raise ValueError("regimes are two at least")
    packed = stored(pieces(rows, keys, at, value, piece))
    target, arrow = _arrow(packed, keys, FIT)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array(v, float) for v in batch["x"].to_pylist()]
            # like lengths together, so that little is padded
            good = sorted((i for i, v in enumerate(lists) if len(v) >= max(least, k) and v.min() < v.max()), key=lambda i: len(lists[i]))
            out = {}
            for a in range(0, len(good), 64):
                some = good[a : a + 64]
                for i, (mean, var, p, _, llf, r, done, last) in zip(some, settle([lists[i] for i in some], k, common_variance, rounds, tol)):
                    out[i] = _summary(len(lists[i]), mean, var, p, llf, r, done, last, common_variance)
            yield _batch(batch, keys, [out.get(i, (len(v), *[None] * 11)) for i, v in enumerate(lists)], arrow)

    short = packed.filter("parts <= 1").mapInArrow(whole, target)
    long = packed.filter("parts > 1")
    if long.isEmpty():
        return short
    state = _rounds(long, keys, k, common_variance, rounds, tol, least)

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for r in batch.to_pylist():
                if r["mean"] is None:
                    got.append((r["n"], *[None] * 11))
                    continue
                mean, var, p, last = (np.array(r[c]) for c in ("mean", "var", "p", "last"))
                got.append(_summary(r["n"], mean, var, p.reshape(k, k), r["llf"], r["rounds"], r["done"], last, common_variance))
            yield _batch(batch, keys, got, arrow)

    return short.unionByName(state.mapInArrow(shown, target))


def _rounds(long: DataFrame, keys: list[str], k: int, common: bool, most: int, tol: float, least: int) -> DataFrame:
    """The state of every key of several pieces when it has settled. Tables of a round are rows a key or a piece; only those are joined."""
    # starting values by ranks among all values of the key: slices of distance from the median, from sums
    values = long.select(*keys, "n", F.explode("x").alias("x"))
    w = Window.partitionBy(*keys)
    middle = values.groupBy(*keys).agg(F.percentile_approx("x", 0.5, 10_000).alias("_m"), F.avg("x").alias("_a"), F.var_pop("x").alias("_v"))
    away = values.join(middle, keys).withColumn("_r", F.row_number().over(w.orderBy(F.col("x") if common else F.abs(F.col("x") - F.col("_m")))) - 1)
    # sizes of slices as they are dealt: the first ones have one more
    n, size = F.col("n"), F.floor(F.col("n") / k)
    extra = n - size * k
    slice_of = F.when(F.col("_r") < extra * (size + 1), F.floor(F.col("_r") / (size + 1))).otherwise(extra + F.floor((F.col("_r") - extra * (size + 1)) / F.greatest(size, F.lit(1))))
    per = away.groupBy(*keys, "n", slice_of.cast("int").alias("_s")).agg(F.avg("x").alias("_mean"), (F.var_pop("x") if common else F.avg((F.col("x") - F.col("_a")) ** 2)).alias("_var"), F.first("_v").alias("_v"))
    if common:
        per = per.withColumn("_var", F.avg("_var").over(w))
    held = per.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("_s", "_mean", F.greatest("_var", F.col("_v") * 1e-3).alias("_var")))).alias("_h"), F.first("_v").alias("_v"))
    flat = F.array(*[F.lit(0.9 if i == j else 0.1 / (k - 1)) for i in range(k) for j in range(k)])
    good = (F.col("_v") > 0) & (F.col("n") >= max(least, k))
    state = held.select(
        *keys, "n", F.when(good, F.col("_h._mean")).alias("mean"), F.when(good, F.col("_h._var")).alias("var"), flat.alias("p"), F.array(*[F.lit(1.0 / k)] * k).alias("start"),
        F.greatest(F.col("_v") * 1e-6, F.lit(1e-300)).alias("floor"), F.lit(float("-inf")).alias("llf"), F.lit(0).alias("rounds"), (~good).alias("done"), F.array(*[F.lit(0.0)] * k).alias("last"),
    )
    state = stored(state)
    over = state.filter("done")
    live = state.filter("not done")

    def arrays(batch: pa.RecordBatch):
        x, mask = padded([np.array(v, float) for v in batch["x"].to_pylist()])
        f = lambda c, *shape: np.array(batch[c].to_pylist(), float).reshape(batch.num_rows, *shape)
        return x, mask, f("mean", k), f("var", k), f("p", k, k), f

    for r in range(1, most + 1):
        joined = long.join(live.drop("n"), keys)
        m_target, m_arrow = _arrow(long, keys, "part long, start array<double>, m array<double>")

        def matrices(batches, m_arrow=m_arrow):
            for batch in batches:
                if batch.num_rows:
                    x, mask, mean, var, p, _ = arrays(batch)
                    m = transfer(x, mask, mean, var, p)
                    yield _batch(batch, keys, list(zip(batch["part"].to_pylist(), batch["start"].to_pylist(), m.reshape(len(m), -1).tolist())), m_arrow)

        b_target, _ = _arrow(long, keys, "part long, before array<double>, after array<double>")

        def ends(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part").reset_index(drop=True)
            m = np.stack(pdf["m"].to_numpy()).reshape(-1, k, k)
            before, after = [np.asarray(pdf["start"].iloc[0], float)], [np.ones(k)]
            for x in m[:-1]:
                v = before[-1] @ x
                before.append(v / v.sum())
            for x in m[:0:-1]:
                v = x @ after[-1]
                after.append(v / v.max())
            out = pdf[[*keys, "part"]].copy()
            out["before"], out["after"] = [list(v) for v in before], [list(v) for v in after[::-1]]
            return out

        bounds = joined.mapInArrow(matrices, m_target).groupBy(*keys).applyInPandas(ends, b_target)  # a row a piece
        s_target, s_arrow = _arrow(long, keys, "s array<double>, first array<double>, last array<double>")

        def sums(batches, s_arrow=s_arrow):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, mask, mean, var, p, f = arrays(batch)
                part, parts = np.array(batch["part"].to_pylist()), np.array(batch["parts"].to_pylist())
                s = smooth(x, mask, mean, var, p, f("before", k), f("after", k), part < parts - 1)
                every = np.concatenate([s["held"], s["sum"], s["square"], s["moves"].reshape(len(x), -1), s["llf"][:, None]], axis=1)
                last = s["shares"][np.arange(len(x)), mask.sum(axis=1) - 1]
                yield _batch(batch, keys, [(a.tolist(), g.tolist() if i == 0 else None, z.tolist() if i == j - 1 else None) for a, g, z, i, j in zip(every, s["shares"][:, 0], last, part, parts)], s_arrow)

        width = 3 * k + k * k + 1
        total = joined.join(bounds, [*keys, "part"]).mapInArrow(sums, s_target).groupBy(*keys).agg(
            F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"), F.first("first", ignorenulls=True).alias("_first"), F.first("last", ignorenulls=True).alias("_last")
        )
        n_target, n_arrow = _arrow(long, keys, STATE)

        def renew(batches, n_arrow=n_arrow, r=r):
            for batch in batches:
                got = []
                for row in batch.to_pylist():
                    s = np.array(row["s"])
                    llf = float(s[-1])
                    settled = llf - row["llf"] <= tol * (1 + abs(llf))
                    new = row["mean"], row["var"], row["p"], row["start"]
                    if not settled and r < most:
                        made = renewed(s[None, :k], s[None, k : 2 * k], s[None, 2 * k : 3 * k], s[None, 3 * k : -1].reshape(1, k, k), np.array([row["_first"]]), np.array([row["floor"]]), common)
                        new = tuple(v[0].ravel().tolist() for v in made)
                    got.append((row["n"], *new, row["floor"], llf, r, settled, row["_last"]))
                yield _batch(batch, keys, got, n_arrow)

        state = stored(live.join(total, keys).mapInArrow(renew, n_target))
        over = over.unionByName(state.filter("done") if r < most else state)
        live = state.filter("not done")
        if r == most or live.isEmpty():
            return over
    return over
