"""All rates of a fund are found where its flows lie: rounds are no joins."""

from datetime import date

import pytest

from quantweave.operators import funds


def test_rounds_are_no_joins(spark):
    rows = [(k, date(2020 + y, 1, 1), a * (k + 1)) for k in range(30) for y, a in enumerate((-100.0, 230.0, -132.0))] + [(99, date(2020, 1, 1), 5.0)]
    found = funds.all_rates(spark.createDataFrame(rows, "fund long, date date, amount double"), "fund", days=365.25)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "ExistingRDD" not in plan.replace("LogicalRDD", "")
    got = {}
    for r in found.collect():
        got.setdefault(r.fund, []).append(r.rate)
    assert sorted(got) == list(range(30)) and all(sorted(v) == pytest.approx([0.1, 0.2], abs=1e-2) for v in got.values())
