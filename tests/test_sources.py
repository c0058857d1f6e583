"""Journals of each layout, fund portfolios and information tables as they are filed, from small files written by hand."""

from __future__ import annotations

import datetime as dt

import pytest

from quantweave.sources import readers
from quantweave.sources.journals import detect_format, parse_journal


def rows(spark, columns, *values):
    return spark.createDataFrame([tuple(v) for v in values], ", ".join(f"`{c}` string" for c in columns))


@pytest.mark.parametrize(
    "columns, layout",
    [
        (["成交时间", "证券代码", "证券名称", "操作", "成交数量"], "tonghuashun"), (["买卖标志", "股票代码"], "eastmoney"), (["买卖标志", "成交均价"], "eastmoney"), (["Date", "Symbol", "Direction"], "futu"),
        (["Datetime", "TICKER", "qty"], "generic"), (["date", "symbol", "side"], "generic"), (["a", "symbol"], None), ([], None),
    ],
)
def test_layouts(columns, layout):
    assert detect_format(columns) == layout


def test_mainland_journals(spark):
    one = rows(
        spark, ["成交时间", "证券代码", "证券名称", "操作", "成交数量", "成交价格", "成交金额", "手续费", "印花税", "过户费"],
        ["2026-01-15 09:35:00", "600519", "A", "证券买入", "100", "1,800.5", "", "5", "0", "0.1"], ["46037.5", "700.0", "B", "卖出", "200", "10", "2000", "1", "2", ""],
        ["2026-01-16", " ", "blank code", "买入", "1", "1", "1", "0", "0", "0"], ["2026-01-16", "300750", "C", "分红", "1", "1", "1", "0", "0", "0"], ["2026-01-16", "300750", "C", None, "1", "1", "1", "0", "0", "0"],
    )
    good, rejected = parse_journal(one)
    got = sorted(tuple(r) for r in good.collect())
    assert got == [
        (dt.datetime(2026, 1, 15, 9, 35), "600519.SH", "A", "buy", 100.0, 1800.5, 180050.0, 5.1, "china_a"), (dt.datetime(2026, 1, 15, 12), "000700.SZ", "B", "sell", 200.0, 10.0, 2000.0, 3.0, "china_a"),
    ]
    assert sorted((r["操作"] or "", r.reason) for r in rejected.collect()) == [("", "no side"), ("分红", "unknown side")]
    two = rows(spark, ["成交日期", "成交时间", "股票代码", "股票名称", "买卖标志", "成交数量", "成交均价", "佣金"], ["20260115.0", "14:01:02", "830799", "D", "S", "10", "2.5", "1"], ["46037", "09:30:00", "000001.sz", "E", "b", "10", "2.5", "x"])
    assert sorted((r.ts, r.symbol, r.side, r.amount, r.fee) for r in parse_journal(two)[0].collect()) == [(dt.datetime(2026, 1, 15, 9, 30), "000001.SZ", "buy", 25.0, 0.0), (dt.datetime(2026, 1, 15, 14, 1, 2), "830799.BJ", "sell", 25.0, 1.0)]


def test_other_journals(spark):
    futu = rows(spark, ["Date", "Time", "Symbol", "Name", "Side", "Quantity", "Price", "Commission", "Platform Fee", "Market"], ["2026/01/15".replace("/", "-"), "10:00:00", "00700.hk", "T", "Sell Short", "100", "HKD 400", "3", "15", ""], ["45000", "0.25", "aapl", "A", "Buy to cover", "1", "$1,234.50", "1", "1", "US"])
    got = sorted((r.ts, r.symbol, r.side, r.price, r.fee, r.market) for r in parse_journal(futu)[0].collect())
    assert got == [(dt.datetime(2023, 3, 15, 6), "AAPL", "buy", 1234.5, 2.0, "us"), (dt.datetime(2026, 1, 15, 10), "00700.HK", "sell", 400.0, 18.0, "hk")]
    loose = rows(spark, ["Time", "code", "Action", "Qty", "Notional"], ["2026-01-15T10:00:00", "btc-usdt", "LONG", "2", "−100"], ["2026-01-15", "BTCUSDT", "dividend", "2", "1"], ["never", "msft", "sell", "1", "1"])
    good, rejected = parse_journal(loose)
    assert [(r.symbol, r.side, r.amount, r.price, r.market) for r in good.collect()] == [("BTC-USDT", "buy", -100.0, -50.0, "crypto")]
    assert sorted(r.reason for r in rejected.collect()) == ["no time", "unknown side"]
    with pytest.raises(ValueError, match="sides"):
        parse_journal(loose.drop("Action"))
    with pytest.raises(ValueError, match="layout"):
        parse_journal(loose.select("Qty"))
    own = parse_journal(loose, {"time": ("time",), "symbol": ("code",), "side": ("action",), "quantity": ("qty",)}, {"dividend": "buy"})[0]
    assert sorted(r.symbol for r in own.collect()) == ["BTC-USDT", "BTCUSDT"]


PORTFOLIO = """<?xml version="1.0" encoding="UTF-8"?>
<edgarSubmission xmlns="http://www.sec.gov/edgar/nport" xmlns:com="http://www.sec.gov/edgar/common"><headerData><submissionType>NPORT-P</submissionType></headerData>
<formData><genInfo><regName>Some Trust</regName><seriesName>Some Fund</seriesName><seriesId>S000001</seriesId><repPdEnd>2026-03-31</repPdEnd><repPdDate>2025-09-30</repPdDate></genInfo>
<fundInfo><totAssets>1000.5</totAssets><netAssets>990.25</netAssets></fundInfo>
<invstOrSecs><invstOrSec><name>Merck &amp; Co</name><title>Merck</title><cusip>58933Y105</cusip><identifiers><isin value="US58933Y1055"/></identifiers><balance>12</balance><units>NS</units><curCd>USD</curCd><valUSD>1,234.5</valUSD><pctVal>0.5329</pctVal><payoffProfile>Long</payoffProfile><assetCat>EC</assetCat><issuerCat>CORP</issuerCat><invCountry>US</invCountry></invstOrSec>
<invstOrSec><name>Cash</name><identifiers><ticker value="USD"/></identifiers><valUSD>n/a</valUSD></invstOrSec></invstOrSecs></formData></edgarSubmission>"""


def test_fund_portfolio(spark):
    got = readers.parse_holdings(spark.createDataFrame([(1, PORTFOLIO), (2, "no xml"), (3, None)], "id int, xml string")).collect()
    assert [r.id for r in got] == [1, 1]
    a, b = got
    assert (a.series_id, str(a.as_of), str(a.fiscal_year_end), a.net_assets_usd, a.registrant) == ("S000001", "2025-09-30", "2026-03-31", 990.25, "Some Trust")
    assert (a.name, a.cusip, a.isin, a.ticker, a.value_usd, a.pct_of_net_assets, a.balance, a.asset_category, a.country) == ("Merck & Co", "58933Y105", "US58933Y1055", None, 1234.5, 0.5329, 12.0, "EC", "US")
    assert (b.name, b.ticker, b.value_usd, b.cusip) == ("Cash", "USD", None, None)


INFO = """<n1:informationTable xmlns:n1="http://www.sec.gov/edgar/document/thirteenf/informationtable">{}</n1:informationTable>"""
ENTRY = """<n1:infoTable><n1:nameOfIssuer>ALLY FINL INC</n1:nameOfIssuer><n1:titleOfClass>COM</n1:titleOfClass><n1:cusip>02005n100</n1:cusip><n1:value>{v}</n1:value><n1:shrsOrPrnAmt><n1:sshPrnamt>{s}</n1:sshPrnamt><n1:sshPrnamtType>SH</n1:sshPrnamtType></n1:shrsOrPrnAmt>{p}<n1:investmentDiscretion>DFND</n1:investmentDiscretion><n1:votingAuthority><n1:Sole>1</n1:Sole><n1:Shared>0</n1:Shared><n1:None>0</n1:None></n1:votingAuthority></n1:infoTable>"""


def test_information_table(spark):
    body = ENTRY.format(v="100", s="1,000", p="") + ENTRY.format(v="50", s="500", p="") + ENTRY.format(v="7", s="70", p="<n1:putCall>Put</n1:putCall>")
    plain = INFO.format(body).replace("n1:", "").replace("xmlns:n1", "xmlns")
    entries = readers.parse_information_table(spark.createDataFrame([(1, INFO.format(body)), (2, plain)], "id int, xml string"))
    assert entries.count() == 6 and {r.shares for r in entries.collect()} == {1000.0, 500.0, 70.0}
    got = sorted((r.id, r.cusip, r.put_call, r.value, r.shares, r.entries) for r in readers.by_cusip(entries).collect())
    assert got == [(k, "02005N100", p, v, s, n) for k in (1, 2) for p, v, s, n in (("", 150.0, 1500.0, 2), ("Put", 7.0, 70.0, 1))]
