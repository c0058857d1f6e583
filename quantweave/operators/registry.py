"""User extension points: factors as functions of the panel, scorers of event text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Registry:
    """Factors by id: a function from the panel to the panel with a column `value`, and its metadata."""

    factors: dict[str, tuple[Callable[[DataFrame], DataFrame], dict]] = field(default_factory=dict)

    def register(self, name: str, fn: Callable[[DataFrame], DataFrame], meta: dict | None = None) -> None:
        if name in self.factors:
            raise ValueError(f"{name} is registered")
        self.factors[name] = (fn, meta or {})

    def list(self, theme: str | None = None) -> list[str]:
        return [n for n, (_, meta) in self.factors.items() if theme is None or theme in meta.get("theme", ())]

    def compute(self, name: str, panel: DataFrame, check: bool = True) -> DataFrame:
        """symbol, date, value; with check an output that is infinite or more than 95% null is refused."""
        out = self.factors[name][0](panel).select("symbol", "date", "value")
        if check:
            n, empty, wild = out.agg(F.count(F.lit(1)), F.sum(F.col("value").isNull().cast("long")), F.max((F.abs("value") == float("inf")).cast("int"))).first()
            if n and (wild or empty > 0.95 * n):
                raise ValueError(f"{name}: {empty} of {n} values are null" if not wild else f"{name}: infinite values")
        return out


def score_events(rows: DataFrame, scorer: Callable[[pd.Series], pd.Series], text: str = "text") -> DataFrame:
    """rows with a score from a function of a batch of texts; null texts are empty."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return scorer(x).astype("float64")

    return rows.withColumn("score", run(F.coalesce(F.col(text), F.lit(""))))
