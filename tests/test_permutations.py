"""Permutations in tasks beside those by windows."""

import numpy as np

from quantweave.operators import stats


def test_packed_equals_windows(spark):
    r, rows = np.random.default_rng(5), []
    for key, n in enumerate((1, 2, 7, 7, 40, 300)):
        for i in range(n):
            pnl = None if key == 3 and i < 2 or key == 1 else round(float(r.normal()) * 1000, 2)
            rows.append((key, 3 * i if key == 4 else i + 1, pnl))
    t = spark.createDataFrame(rows, "symbol long, seq long, pnl double").repartition(3).cache()
    found = {m: {x.symbol: (x.actual, x.share) for x in stats.permutation_drawdowns(t, ["symbol"], 1000.0, 60, most=m).collect()} for m in (0, 10, 1000)}
    assert len(found[0]) == 6 and 0 < found[0][5][1] < 1
    assert found[10] == found[0] and found[1000] == found[0]


def test_no_row_a_permutation(spark):
    """Short keys are never exploded into a row a trade and permutation."""
    t = spark.range(1000).selectExpr("id % 50 as symbol", "id as seq", "cast(id % 7 as double) - 3 as pnl")
    plan = stats.permutation_drawdowns(t, ["symbol"], 1000.0, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
