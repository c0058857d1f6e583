"""the code that Spark makes of a journal stays within the size that Java compiles, and odd texts are read as before."""

from __future__ import annotations

import datetime as dt
import re

import pytest

from quantweave import plans
from quantweave.sources.journals import COLUMNS, parse_journal

LARGEST = 8000  # bytes of a method; beyond that HotSpot only interprets it


def sizes(df, capsys) -> list[int]:
    capsys.readouterr()
    df.explain("codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]


@pytest.mark.parametrize("layout", COLUMNS)
def test_methods_of_journals_are_compiled(spark, tmp_path, capsys, layout):
    names = [c for k, columns in COLUMNS[layout].items() for c in (columns[:1] if layout == "generic" or k == "side" else columns)]
    (tmp_path / "rows.csv").write_text("")
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in names)).csv(str(tmp_path))
    for part in parse_journal(rows):
        got = sizes(part, capsys)
        assert got and max(got) < LARGEST


def test_methods_of_the_query_are_compiled(spark, capsys):
    got = sizes(plans.QUERIES["A12_parse_journal"](spark, "/root/testdata/sf0.001"), capsys)
    assert len(got) == 4 and max(got) < LARGEST


def test_odd_texts(spark):
    numbers = {"$1,234.50": 1234.5, "HKD 400": 400.0, "US$D 1": 0.0, "1USD": 1.0, "1U,SD": 0.0, "−100": -100.0, "1E+3 EUR": 1000.0, "x": 0.0, "NaN": 0.0, "\uff15": 0.0, "1e999": 0.0, "": 0.0}
    rows = spark.createDataFrame([("2026-01-15", str(i), "buy", t) for i, t in enumerate(numbers)], "time string, symbol string, side string, qty string")
    assert {int(r.symbol): r.quantity for r in parse_journal(rows)[0].collect()} == dict(enumerate(numbers.values()))
    whens = [
        ("20260115", "10:30:00", dt.datetime(2026, 1, 15, 10, 30)), ("20260115.0", "x", dt.datetime(2026, 1, 15)), ("46037", "14:01", dt.datetime(2026, 1, 15, 14, 1)), ("46037", "0.5", dt.datetime(2026, 1, 15, 12)),
        ("2026-01-15 09:00", "25:00:00", dt.datetime(2026, 1, 15, 9)), ("2026-01-15 09:00", "10:00", dt.datetime(2026, 1, 15, 10)), ("20260230", "10:00", None), ("never", "10:00", None),
    ]
    rows = spark.createDataFrame([(d, t, str(i), "Buy") for i, (d, t, _) in enumerate(whens)], "Date string, Time string, Symbol string, Side string")
    good, rejected = parse_journal(rows)
    assert {int(r.symbol): r.ts for r in good.collect()} == {i: w for i, (_, _, w) in enumerate(whens) if w}
    assert sorted((r.Date, r.Symbol, r.reason) for r in rejected.collect()) == [("20260230", "6", "no time"), ("never", "7", "no time")]
