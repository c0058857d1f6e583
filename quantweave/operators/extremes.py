"""Tails of losses by peaks over a threshold: a generalised Pareto distribution of what lies below a low quantile, for every key.

With t = shape / scale the shape of largest likelihood is the mean of log(1 + t y), so the likelihood is a function of one number. It
is found by rounds of sums: each round takes the sums of log(1 + t y) for a ladder of t of every key, and the next ladder lies
between the neighbours of the best step. No key's exceedances are brought together.

Defined cases: null and non-finite values are left out; a key with fewer than two exceedances, or whose exceedances are all alike,
gets nulls. Where the likelihood has no inner maximum (shapes below -1/2 and small samples) the best end of the ladder stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored

STEPS = 48


def exceedances(rows: DataFrame, keys: list[str], value: str, percent: float = 5.0) -> DataFrame:
    """keys, n, threshold, y: by how much values lie below the key's percentile (interpolated between ranks)."""
    if not 0 < percent < 100:
        raise ValueError("a percentage between 0 and 100")
    w = Window.partitionBy(*keys)
    x = F.col(value).cast("double")
    ranked = rows.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*keys, x.alias("_x"))
    ranked = ranked.withColumns({"_r": F.row_number().over(w.orderBy("_x")) - 1, "n": F.count(F.lit(1)).over(w)})
    place = (F.col("n") - 1) * percent / 100
    part = place - F.floor(place)
    near = F.when(F.col("_r") == F.floor(place), F.col("_x") * (1 - part)).when((F.col("_r") == F.floor(place) + 1), F.col("_x") * part)
    cut = ranked.withColumn("threshold", F.sum(near).over(w))
    return cut.select(*keys, "n", "threshold", (F.col("threshold") - F.col("_x")).alias("y")).filter("y > 0")


def moments(tail: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, threshold, n_exceedances, rate, shape, scale by mean and variance of the exceedances."""
    s = tail.groupBy(*keys, "n", "threshold").agg(F.count(F.lit(1)).alias("n_exceedances"), F.avg("y").alias("_m"), F.var_samp("y").alias("_v"))
    q = F.try_divide(F.col("_m") * F.col("_m"), F.when(F.col("_v") > 0, F.col("_v")))
    return s.select(*keys, "n", "threshold", "n_exceedances", (F.col("n_exceedances") / F.col("n")).alias("rate"), (0.5 * (1 - q)).alias("shape"), (0.5 * F.col("_m") * (1 + q)).alias("scale"))


def pareto_tail(rows: DataFrame, keys: list[str], value: str, percent: float = 5.0, rounds: int = 6, sure: float = 2.0) -> DataFrame:
    """keys, n, threshold, n_exceedances, rate, shape, shape_se, scale, tail ('fat', 'exponential' or 'bounded')."""
    tail = stored(exceedances(rows, keys, value, percent))
    about = tail.groupBy(*keys, "n", "threshold").agg(F.count(F.lit(1)).alias("n_exceedances"), F.avg("y").alias("_m"), F.max("y").alias("_top"), F.min("y").alias("_low"))
    about = about.withColumn("_good", (F.col("n_exceedances") >= 2) & (F.col("_low") < F.col("_top")))
    # z = t * mean: from just above the end of what the largest exceedance allows, to far beyond any shape in use
    ladder = stored(about.select(*keys, "n_exceedances", "_m", (-(1 - 1e-6) * F.col("_m") / F.col("_top")).alias("_a"), F.lit(60.0).alias("_b"), F.lit(0.0).alias("_z"), F.lit(0.0).alias("_s")).filter(F.col("_m") > 0))
    types = {f.name: f.dataType.simpleString() for f in tail.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A ladder between a and b, in equal steps of log(1 + z - a) so that it is fine near a."""
        return a[:, None] + np.expm1(np.linspace(0, 1, STEPS)[None, :] * np.log1p(b - a)[:, None])

    for _ in range(rounds):
        joined = tail.select(*keys, "y").join(ladder, keys)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), 4096):
                    part = pdf.iloc[at : at + 4096]
                    z = places(part["_a"].to_numpy(), part["_b"].to_numpy())
                    log = np.log1p(z * (part["y"] / part["_m"]).to_numpy()[:, None])
                    got = pd.DataFrame(log).groupby([part[k].to_numpy() for k in keys], dropna=False).sum() if keys else pd.DataFrame(log).sum().to_frame().T
                    out = got.index.to_frame(index=False) if keys else pd.DataFrame(index=range(1))
                    out.columns = keys
                    out["s"] = list(got.to_numpy())
                    yield out

        total = joined.mapInPandas(sums, f"{schema}{', ' if keys else ''}s array<double>").groupBy(*keys).agg(F.array(*[F.sum(F.col("s")[i]) for i in range(STEPS)]).alias("_l"))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ladder.schema.fields)

        def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if pdf.empty:
                    continue
                z = places(pdf["_a"].to_numpy(), pdf["_b"].to_numpy())
                shape = np.stack(pdf["_l"].to_numpy()) / pdf["n_exceedances"].to_numpy()[:, None]
                with np.errstate(all="ignore"):
                    level = np.where(np.abs(z) < 1e-9, 0.0, np.log(np.where(np.abs(z) < 1e-9, 1.0, shape / z)))
                fit = np.where((shape > -1) & np.isfinite(level), -(level + shape + 1), -np.inf)  # of unit mean, a value
                best = fit.argmax(axis=1)
                every = np.arange(len(pdf))
                out = pdf.drop(columns="_l")
                out["_z"], out["_s"] = z[every, best], shape[every, best]
                out["_a"], out["_b"] = z[every, np.maximum(best - 1, 0)], z[every, np.minimum(best + 1, STEPS - 1)]
                yield out

        ladder = stored(ladder.join(total, keys).mapInPandas(narrow, fields))
    found = ladder.select(*keys, "_z", "_s")
    out = about.join(found, keys, "left")
    shape = F.when(F.col("_good"), F.col("_s"))
    scale = F.when(F.col("_good"), F.when(F.abs("_z") < 1e-9, F.col("_m")).otherwise(F.col("_s") * F.col("_m") / F.col("_z")))
    out = out.withColumns({"shape": shape, "scale": scale, "shape_se": F.abs(1 + shape) / F.sqrt("n_exceedances")})
    band = F.col("shape_se") * sure
    kind = F.when(F.col("shape") > band, "fat").when(F.col("shape") < -band, "bounded").when(F.col("shape").isNotNull(), "exponential")
    return out.select(*keys, "n", "threshold", "n_exceedances", (F.col("n_exceedances") / F.col("n")).alias("rate"), "shape", "shape_se", "scale", kind.alias("tail"))
