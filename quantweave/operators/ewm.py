"""Exponential averages: a recursion along a series, as one grouped pass for any number of columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Ewm:
    """An average of a column: `adjust` weighs by what has been seen, else the first value starts the recursion."""

    column: str
    alpha: float
    adjust: bool = False
    least: int = 1

    @staticmethod
    def span(column: str, n: int, adjust: bool = False) -> Ewm:
        return Ewm(column, 2 / (n + 1), adjust)


def ewm(rows: DataFrame, averages: dict[str, Ewm], by: str = "symbol", at: str = "date") -> DataFrame:
    """rows with a column for each average; nulls are skipped, as weights go on by rows.

    Symbols are dealt out and sorted by Spark; a task takes many symbols at a time and steps along their bars together.
    """
    names = [n for n in rows.columns if n not in averages]
    schema = T.StructType([rows.schema[n] for n in names] + [T.StructField(n, T.DoubleType()) for n in averages])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            # the last symbol of a batch may go on in the next
            starts = np.flatnonzero(changes(batch[by], held[-1][by].iloc[-1:] if held else None))
            if len(starts) and (held or starts[-1] > 0):
                held += [batch.iloc[: starts[-1]]] if starts[-1] > 0 else []
                yield averaged(pd.concat(held, ignore_index=True))
                held = [batch.iloc[starts[-1] :]]
            else:
                held.append(batch)
        if held:
            yield averaged(pd.concat(held, ignore_index=True))

    def averaged(part: pd.DataFrame) -> pd.DataFrame:
        starts = np.flatnonzero(changes(part[by]))
        lengths = np.diff([*starts, len(part)])
        row = np.repeat(np.arange(len(starts)), lengths)
        step = np.arange(len(part)) - np.repeat(starts, lengths)
        out = part[names].copy()
        for name, e in averages.items():
            x = np.full((lengths.max(), len(starts)), np.nan)
            x[step, row] = part[e.column].to_numpy("float64", na_value=np.nan)
            out[name] = along(x, e)[step, row]
        return out

    return rows.repartition(by).sortWithinPartitions(by, at).mapInPandas(run, schema)


def changes(keys: pd.Series, before: pd.Series | None = None) -> np.ndarray:
    """Where another key begins than that of the row before; null is a key."""
    keys = keys.reset_index(drop=True)
    last = keys.shift()
    if before is not None:
        last.iloc[:1] = before.to_numpy()
    same = (keys == last) | (keys.isna() & last.isna())
    if before is None:
        same.iloc[:1] = False
    return ~same.to_numpy(bool)


def along(x: np.ndarray, e: Ewm) -> np.ndarray:
    """The average of each column of x down its rows; NaN is missing."""
    out, weight = np.full_like(x, np.nan), np.ones(x.shape[1])
    value, seen = np.full(x.shape[1], np.nan), np.zeros(x.shape[1])
    fresh = 1.0 if e.adjust else e.alpha
    for t, now in enumerate(x):
        known, begun = ~np.isnan(now), ~np.isnan(value)
        seen += known
        weight[begun] *= 1 - e.alpha
        both = known & begun
        value[both] = (weight[both] * value[both] + fresh * now[both]) / (weight[both] + fresh)
        weight[both] = weight[both] + 1 if e.adjust else 1.0
        value[known & ~begun] = now[known & ~begun]
        out[t] = np.where(seen >= e.least, value, np.nan)
    return out
