"""GARCH(1, 1) with a constant mean for every key, by quasi-likelihood.

The variance s of the next value is omega + alpha e^2 + beta s. Many series are stepped along time side by side, with the
derivatives of s beside it, so one pass over time gives likelihood and gradient of a batch; the same pass
over slightly moved parameters gives the second derivatives, and a damped Newton step is taken for each series on its own.
Parameters are free numbers (mean, log omega, logits of alpha + beta and of alpha's part), so every step is allowed.

Before the first value e^2 and s are the weighted mean of the first 75 squared deviations, by powers of 0.94. Values are
multiplied by `scale` (100: percent), in which omega, llf, aic and bic are given; volatilities are given as the values were.
Defined cases: null values are left out; keys with fewer than `least` values, or whose values are all alike, get nulls;
a series of more than `most` values is refused, since it is stepped through in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .regimes import padded

FIT = "n long, mu double, omega double, alpha double, beta double, persistence double, long_run_vol double, current_vol double, forecast array<double>, llf double, aic double, bic double, converged boolean"


def natural(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """mean, omega, alpha, beta of free parameters (series, 4)."""
    both, share = 1 / (1 + np.exp(-t[:, 2])), 1 / (1 + np.exp(-t[:, 3]))
    return t[:, 0], np.exp(t[:, 1]), both * share, both * (1 - share)


def likelihood(t: np.ndarray, x: np.ndarray, mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood, its gradient by free parameters, and the last s and e^2."""
    mean, omega, alpha, beta = natural(t)
    both, share = alpha + beta, 1 / (1 + np.exp(-t[:, 3]))
    n = len(t)
    s, square = first.copy(), first.copy()
    ds, de = np.zeros((n, 4)), np.zeros(n)  # derivatives of s by mean, omega, alpha, beta; of e^2 by the mean
    out, grad = np.zeros(n), np.zeros((n, 4))
    for k in range(x.shape[1]):
        live = mask[:, k]
        step = np.stack([alpha * de, np.ones(n), square, s], axis=1) + beta[:, None] * ds
        new = omega + alpha * square + beta * s
        e = x[:, k] - mean
        u = e * e / new
        out += np.where(live, -0.5 * (np.log(2 * np.pi * new) + u), 0.0)
        part = 0.5 * ((u - 1) / new)[:, None] * step
        part[:, 0] += e / new
        grad += np.where(live[:, None], part, 0.0)
        s, square, de = np.where(live, new, s), np.where(live, e * e, square), np.where(live, -2 * e, de)
        ds = np.where(live[:, None], step, ds)
    by = np.stack([
        grad[:, 0], grad[:, 1] * omega,
        (grad[:, 2] * share + grad[:, 3] * (1 - share)) * both * (1 - both), (grad[:, 2] - grad[:, 3]) * both * share * (1 - share),
    ], axis=1)
    return out, by, s, square


def fitted(lists: list[np.ndarray], rounds: int = 60, tol: float = 1e-9) -> tuple[np.ndarray, ...]:
    """Free parameters, likelihood, last s, last e^2, converged, and the unit in which they are, of each series."""
    unit = np.array([v.std() for v in lists])
    x, mask = padded([v / u for v, u in zip(lists, unit)])
    n = len(lists)
    middle = np.array([v.mean() for v in lists]) / unit
    first = np.zeros(n)
    for i, v in enumerate(lists):
        w = 0.94 ** np.arange(min(75, len(v)))
        first[i] = float((w / w.sum()) @ ((v[: len(w)] / unit[i] - middle[i]) ** 2))
    # a few starts, the likeliest is taken
    best, t = np.full(n, -np.inf), np.zeros((n, 4))
    for both in (0.3, 0.8, 0.95):
        for share in (0.05, 0.15, 0.4):
            start = np.stack([middle, np.full(n, np.log(1 - both)), np.full(n, np.log(both / (1 - both))), np.full(n, np.log(share / (1 - share)))], axis=1)
            value = likelihood(start, x, mask, first)[0]
            better = value > best
            best, t = np.where(better, value, best), np.where(better[:, None], start, t)
    damp, done, h = np.full(n, 1e-3), np.zeros(n, bool), 1e-5
    for _ in range(rounds):
        at = np.flatnonzero(~done)
        if not len(at):
            break
        moved = np.concatenate([t[at], *(t[at] + d * h * np.eye(4)[k] for k in range(4) for d in (1, -1))])
        value, grad, _, _ = likelihood(moved, np.tile(x[at], (9, 1)), np.tile(mask[at], (9, 1)), np.tile(first[at], 9))
        g, grad = grad[: len(at)], grad.reshape(9, len(at), 4)
        curve = np.stack([(grad[1 + 2 * k] - grad[2 + 2 * k]) / (2 * h) for k in range(4)], axis=1)
        values, vectors = np.linalg.eigh(-(curve + curve.transpose(0, 2, 1)) / 2)
        steps = np.einsum("nij,nj->ni", vectors, np.einsum("nij,ni->nj", vectors, g) / (np.abs(values) + damp[at, None] * mask[at].sum(axis=1)[:, None]))
        steps *= np.minimum(1, 2 / np.maximum(np.abs(steps).max(axis=1, keepdims=True), 1e-300))
        # no number leaves the range in which its exponential is one
        new = np.clip(t[at] + steps, [-1e9, -40, -30, -30], [1e9, 40, 30, 30])
        got = likelihood(new, x[at], mask[at], first[at])[0]
        size = np.abs(g * np.where(np.abs(t[at]) < 29.9, 1, 0)).max(axis=1)
        better = got >= value[: len(at)]
        t[at[better]], best[at] = new[better], np.where(better, got, value[: len(at)])
        damp[at] = np.where(better, np.maximum(damp[at] / 10, 1e-12), damp[at] * 10)
        done[at] = (size <= tol * mask[at].sum(axis=1)) | (damp[at] > 1e6) | (better & (got - value[: len(at)] <= 1e-13 * (1 + np.abs(got))) & (np.abs(steps).max(axis=1) < 1e-7))
    llf, _, s, square = likelihood(t, x, mask, first)
    return t, llf, s, square, done, unit


def garch(rows: DataFrame, keys: list[str], at: str, value: str, horizon: int = 5, scale: float = 100.0, least: int = 20, most: int = 1_000_000) -> DataFrame:
    """keys and the fit of each series, with forecasts of the volatility of the next `horizon` values."""
    if horizon < 1:
        raise ValueError("a horizon of one at least")
    x = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    packed = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).cast("double").alias("x")))).alias("_v"))
    packed = packed.select(*keys, F.when(F.col("n") > most, F.raise_error(F.lit(f"a series of more than {most} values"))).otherwise(F.col("_v.x")).alias("x"))
    target = StructType([f for f in packed.schema.fields if f.name in keys] + _parse_datatype_string(FIT).fields)
    arrow = to_arrow_schema(target)

    def summary(v: np.ndarray, t, llf: float, s: float, square: float, done: bool, unit: float) -> tuple:
        mu, omega, alpha, beta = (float(p[0]) for p in natural(t[None]))
        n, both, unit = len(v), alpha + beta, unit * scale
        omega, llf = omega * unit**2, llf - n * np.log(unit)
        ahead = [omega + (alpha * square + beta * s) * unit**2]
        for _ in range(horizon - 1):
            ahead.append(omega + both * ahead[-1])
        long = float(np.sqrt(omega / (1 - both)) / scale) if both < 1 else None
        return n, mu * unit / scale, omega, alpha, beta, both, long, float(np.sqrt(s) * unit / scale), [float(np.sqrt(a) / scale) for a in ahead], llf, 8 - 2 * llf, 4 * np.log(n) - 2 * llf, bool(done)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array(v, float) for v in batch["x"].to_pylist()]
            good = sorted((i for i, v in enumerate(lists) if len(v) >= least and v.min() < v.max()), key=lambda i: len(lists[i]))
            out: dict[int, tuple] = {}
            for a in range(0, len(good), 64):
                some = good[a : a + 64]
                out.update((i, summary(lists[i], *row)) for i, *row in zip(some, *fitted([lists[i] for i in some])))
            rows = [out.get(i, (len(v), *[None] * 12)) for i, v in enumerate(lists)]
            made = iter([pa.array(list(c), f.type) for c, f in zip(zip(*rows), [f for f in arrow if f.name not in keys])] if rows else [pa.array([], f.type) for f in arrow if f.name not in keys])
            yield pa.RecordBatch.from_arrays([batch[f.name] if f.name in keys else next(made) for f in arrow], schema=arrow)

    # small rows, much work: as many tasks as asked for, not as few as their bytes need
    tasks = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (packed.repartition(tasks, *keys) if keys else packed).mapInArrow(run, target)
