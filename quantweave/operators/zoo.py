"""The factor catalogue as expressions: qlib158 by rule, academic and fundamental styles, the 101 formulaic alphas."""

from __future__ import annotations

from .expr import X, absolute, argmax, argmin, average, col, corr, cov, decay, delay, delta, fill, finite, fmax, fmin, high2, log, low2, low_of, market, mean, neutral, number, partial_sum, power, product, quantile, rank, running_product, scale, sign, skew, std, top, total, ts_rank, value, where, zscore

o, h, l, c, v, w = (col(x) for x in ("open", "high", "low", "close", "volume", "vwap"))  # noqa: E741
r = c / delay(c, 1) - 1
WINDOWS = (5, 10, 20, 30, 60)


def adv(n: int) -> X:
    return mean(v, n)


def _up_down(x: X) -> tuple[X, X, X]:
    d = x - delay(x, 1)
    return where(d > 0, d, 0.0), where(d < 0, -d, 0.0), absolute(d)


def qlib(n: int) -> dict[str, X]:
    """The windowed families of qlib158 at a window."""
    up, down, both = _up_down(c)
    vup, vdown, vboth = _up_down(v)
    rise, fall = c > delay(c, 1), c < delay(c, 1)
    ratio = c / delay(c, 1)
    line = corr(c, number(c), n)
    rv, arv = (ratio - 1) * v, absolute(ratio - 1) * v
    return {
        "beta": delta(c, n) / c / n, "cntd": mean(rise, n) - mean(fall, n), "cntn": mean(fall, n), "cntp": mean(rise, n),
        "cord": corr(ratio, log((v + 1) / (delay(v, 1) + 1)), n), "corr": corr(c, log(v + 1), n), "imax": argmax(h, n) / n, "imin": argmin(l, n) / n, "imxd": (argmax(h, n) - argmin(l, n)) / n,
        "ma": mean(c, n) / c, "max": top(h, n) / c, "min": low_of(l, n) / c, "qtld": quantile(c, 0.2, n) / c, "qtlu": quantile(c, 0.8, n) / c, "rank": ts_rank(c, n), "resi": (c - mean(c, n)) / c,
        "roc": c / delay(c, n) - 1, "rsqr": line * line, "rsv": (c - low_of(l, n)) / (top(h, n) - low_of(l, n)), "std": std(c, n) / c,
        "sumd": (total(up, n) - total(down, n)) / total(both, n), "sumn": total(down, n) / total(both, n), "sump": total(up, n) / total(both, n),
        "vma": mean(v, n) / (v + 1e-12), "vstd": std(v, n) / (v + 1e-12), "vsumd": (total(vup, n) - total(vdown, n)) / total(vboth, n), "vsumn": total(vdown, n) / total(vboth, n), "vsump": total(vup, n) / total(vboth, n),
        "wvma": std(rv, n) / mean(arv, n),
    }


def candles() -> dict[str, X]:
    up, down = where(c <= o, o, c), where(o <= c, o, c)
    return {
        "klen": (h - l) / o, "klow": (down - l) / o, "klow2": (down - l) / (h - l), "kmid": (c - o) / o, "kmid2": (c - o) / (h - l),
        "ksft": (2 * c - h - l) / o, "ksft2": (2 * c - h - l) / (h - l), "kup": (h - up) / o, "kup2": (h - up) / (h - l),
    }


def academic() -> dict[str, X]:
    back = lambda n: delta(c, n) / delay(c, n)
    m = market(r)
    return {
        "bab": zscore(-(cov(r, m, 252) / power(std(m, 252), 2.0))), "carhart_mom": zscore(back(252) - back(21)), "cma": zscore(-delta(log(mean(v, 60) + 1), 60)),
        "high52w": zscore(c / top(c, 252)), "hml": zscore(-back(252)), "illiq": zscore(mean(absolute(back(1)) / (c * v), 21)), "mkt_rf": zscore(back(21)),
        "retskew": zscore(-skew(back(1), 60)), "rmw": zscore(-std(back(1), 60)), "smb": zscore(-log(mean(v * c, 60) + 1)), "strev": zscore(-back(21)),
    }


def fundamental() -> dict[str, X]:
    """On a panel with the columns asset_growth, net_income, shares_diluted, gross_profitability and roe."""
    return {"asset_growth": -zscore(col("asset_growth")), "earnings_yield": zscore(col("net_income") / (c * col("shares_diluted"))), "gross_profitability": zscore(col("gross_profitability")), "roe": zscore(col("roe"))}


def _mix(a: X, b: X, share: float) -> X:
    return a * share + b * (1 - share)


def alpha101() -> dict[int, X]:
    mid, d1, d3 = (h + l) / 2, delta(c, 1), delta(c, 3)
    calm, one = where(low_of(d1, 5) > 0, d1, where(top(d1, 5) < 0, d1, -d1)), value(1.0)
    calm4 = where(low_of(d1, 4) > 0, d1, where(top(d1, 4) < 0, d1, -d1))
    bend = (delay(c, 20) - delay(c, 10)) / 10 - (delay(c, 10) - c) / 10
    fell = r < 0
    os8 = total(o, 5) * total(r, 5)
    m8, m2, s8 = total(c, 8) / 8, total(c, 2) / 2, std(c, 8)
    m100 = total(c, 100) / 100
    flow = (c - l - (h - c)) / (h - l) * v
    width = (h - l) / (total(c, 5) / 5)
    both = lambda a, b: where(a < b, -1.0, 0.0)
    return {
        1: rank(argmax(power(std(r, 20) * fell + c * (1 - fell), 2.0), 5)) - 0.5,
        2: -corr(rank(delta(log(v), 2)), rank((c - o) / o), 6),
        3: -corr(rank(o), rank(v), 10),
        4: -ts_rank(rank(l), 9),
        5: rank(o - total(w, 10) / 10) * (-absolute(rank(c - w))),
        6: -corr(o, v, 10),
        7: where(adv(20) < v, -ts_rank(absolute(delta(c, 7)), 60) * sign(delta(c, 7)), -1.0),
        8: -rank(os8 - delay(os8, 10)),
        9: calm,
        10: rank(calm4),
        11: (rank(top(w - c, 3)) + rank(low_of(w - c, 3))) * rank(delta(v, 3)),
        12: sign(delta(v, 1)) * -d1,
        13: -rank(cov(rank(c), rank(v), 5)),
        14: -rank(delta(r, 3)) * corr(o, v, 10),
        15: -total(rank(corr(rank(h), rank(v), 3)), 3),
        16: -rank(cov(rank(h), rank(v), 5)),
        17: -rank(ts_rank(c, 10)) * rank(delta(d1, 1)) * rank(ts_rank(v / adv(20), 5)),
        18: -rank(std(absolute(c - o), 5) + (c - o) + corr(c, o, 10)),
        19: -sign(c - delay(c, 7) + delta(c, 7)) * (1 + rank(1 + total(r, 250))),
        20: -rank(o - delay(h, 1)) * rank(o - delay(c, 1)) * rank(o - delay(l, 1)),
        21: where(m8 + s8 < m2, -1.0, where(m2 < m8 - s8, 1.0, where(v / adv(20) >= 1.0, 1.0, -1.0))),
        22: -(delta(corr(h, v, 5), 5) * rank(std(c, 20))),
        23: where(total(h, 20) / 20 < h, -delta(h, 2), 0.0 * c),
        24: where(delta(m100, 100) / delay(c, 100) <= 0.05, -(c - low_of(c, 100)), -d3),
        25: rank(-r * adv(20) * w * (h - c)),
        26: -top(corr(ts_rank(v, 5), ts_rank(h, 5), 5), 3),
        27: where(rank(total(corr(rank(v), rank(w), 6), 2) / 2) > 0.5, -1.0, 1.0),
        28: scale(corr(adv(20), l, 5) + mid - c),
        29: low_of(rank(rank(scale(log(low_of(rank(rank(-rank(delta(c - 1, 5)))), 2))))), 5) + ts_rank(delay(-r, 6), 5),
        30: (1 - rank(sign(c - delay(c, 1)) + sign(delay(c, 1) - delay(c, 2)) + sign(delay(c, 2) - delay(c, 3)))) * total(v, 5) / total(v, 20),
        31: rank(rank(rank(decay(-rank(rank(delta(c, 10))), 10)))) + rank(-d3) + sign(scale(corr(adv(20), l, 12))),
        32: scale(total(c, 7) / 7 - c) + 20 * scale(corr(w, delay(c, 5), 230)),
        33: rank(-(1 - o / c)),
        34: rank(1 - rank(std(r, 2) / std(r, 5)) + (1 - rank(d1))),
        35: ts_rank(v, 32) * (1 - ts_rank(c + h - l, 16)) * (1 - ts_rank(r, 32)),
        36: 2.21 * rank(corr(c - o, delay(v, 1), 15)) + 0.7 * rank(o - c) + 0.73 * rank(ts_rank(delay(-r, 6), 5)) + rank(absolute(corr(w, adv(20), 6))) + 0.6 * rank((total(c, 200) / 200 - o) * (c - o)),
        37: rank(corr(delay(o - c, 1), c, 200)) + rank(o - c),
        38: -rank(ts_rank(c, 10)) * rank(c / o),
        39: -rank(delta(c, 7) * (1 - rank(decay(v / adv(20), 9)))) * (1 + rank(total(r, 250))),
        40: -rank(std(h, 10)) * corr(h, v, 10),
        41: power(h * l, 0.5) - w,
        42: rank(w - c) / rank(w + c),
        43: ts_rank(v / adv(20), 20) * ts_rank(-delta(c, 7), 8),
        44: -corr(h, rank(v), 5),
        45: -(rank(total(delay(c, 5), 20) / 20) * corr(c, v, 2) * rank(corr(total(c, 5), total(c, 20), 2))),
        46: where(bend > 0.25, -1.0, where(bend < 0.0, 1.0, -d1)),
        47: rank(one / c) * v / adv(20) * (h * rank(h - c) / (total(h, 5) / 5)) - rank(w - delay(w, 5)),
        48: neutral(corr(d1, delta(delay(c, 1), 1), 250) * d1 / c) / total(d1 / delay(c, 1) * (d1 / delay(c, 1)), 250),
        49: where(bend < -0.1, 1.0, -d1),
        50: -top(rank(corr(rank(v), rank(w), 5)), 5),
        51: where(bend < -0.05, 1.0, -d1),
        52: (-low_of(l, 5) + delay(low_of(l, 5), 5)) * rank((total(r, 240) - total(r, 20)) / 220) * ts_rank(v, 5),
        53: -delta((c - l - (h - c)) / (c - l), 9),
        54: -((l - c) * power(o, 5.0) / ((l - h) * power(c, 5.0))),
        55: -corr(rank((c - low_of(l, 12)) / (top(h, 12) - low_of(l, 12))), rank(v), 6),
        56: 0 - rank(total(r, 10) / total(total(r, 2), 3)) * rank(r),
        57: 0 - (c - w) / decay(rank(argmax(c, 30)), 2),
        58: -ts_rank(decay(corr(neutral(w), v, 4), 8), 6),
        59: -ts_rank(decay(corr(neutral(_mix(w, w, 0.728317)), v, 4), 16), 8),
        60: 0 - (2 * scale(rank(flow)) - scale(rank(argmax(c, 10)))),
        61: rank(w - low_of(w, 16)) < rank(corr(w, adv(180), 18)),
        62: both(rank(corr(w, total(adv(20), 22), 10)), rank(rank(o) + rank(o) < rank(mid) + rank(h))),
        63: -(rank(decay(delta(neutral(c), 2), 8)) - rank(decay(corr(_mix(w, o, 0.318108), total(adv(180), 37), 14), 12))),
        64: both(rank(corr(total(_mix(o, l, 0.178404), 13), total(adv(120), 13), 17)), rank(delta(_mix(mid, w, 0.178404), 4))),
        65: both(rank(corr(_mix(o, w, 0.00817205), total(adv(60), 9), 6)), rank(o - low_of(o, 14))),
        66: -(rank(decay(delta(w, 4), 7)) + ts_rank(decay((_mix(l, l, 0.96633) - w) / (o - mid), 11), 7)),
        67: -(rank(h - low_of(h, 2)) * rank(corr(neutral(w), neutral(adv(20)), 6))),
        68: both(ts_rank(corr(rank(h), rank(adv(15)), 9), 14), rank(delta(_mix(c, l, 0.518371), 1))),
        69: -(rank(top(delta(neutral(w), 3), 5)) * ts_rank(corr(_mix(c, w, 0.490655), adv(20), 5), 9)),
        70: -(rank(delta(w, 1)) * ts_rank(corr(neutral(c), adv(50), 18), 18)),
        71: fmax(ts_rank(decay(corr(ts_rank(c, 3), ts_rank(adv(180), 12), 18), 4), 16), ts_rank(decay(power(rank(l + o - (w + w)), 2.0), 16), 4)),
        72: rank(decay(corr(mid, adv(40), 9), 10)) / rank(decay(corr(ts_rank(w, 4), ts_rank(v, 19), 7), 3)),
        73: -fmax(rank(decay(delta(w, 5), 3)), ts_rank(decay(-(delta(_mix(o, l, 0.147155), 2) / _mix(o, l, 0.147155)), 3), 17)),
        74: both(rank(corr(c, total(adv(30), 37), 15)), rank(corr(rank(_mix(h, w, 0.0261661)), rank(v), 11))),
        75: rank(corr(w, v, 4)) < rank(corr(rank(l), rank(adv(50)), 12)),
        76: -fmax(rank(decay(delta(w, 1), 12)), ts_rank(decay(ts_rank(corr(neutral(l), adv(81), 8), 20), 17), 19)),
        77: fmin(rank(decay(mid + h - (w + h), 20)), rank(decay(corr(mid, adv(40), 3), 6))),
        78: rank(corr(total(_mix(l, w, 0.352233), 20), total(adv(40), 20), 7)) * rank(corr(rank(w), rank(v), 6)),
        79: rank(delta(neutral(_mix(c, o, 0.60733)), 1)) < rank(corr(ts_rank(w, 4), ts_rank(adv(150), 9), 15)),
        80: -(rank(sign(delta(neutral(_mix(o, h, 0.868128)), 4))) * ts_rank(corr(h, adv(10), 5), 6)),
        81: both(rank(log(product(rank(power(rank(corr(w, total(adv(10), 50), 8)), 4.0)), 15))), rank(corr(rank(w), rank(v), 5))),
        82: -fmin(rank(decay(delta(o, 1), 15)), ts_rank(decay(corr(neutral(v), _mix(o, o, 0.634196), 17), 7), 13)),
        83: rank(delay(width, 2)) * rank(rank(v)) / (width / (w - c)),
        84: finite(power(ts_rank(w - top(w, 15), 21), delta(c, 5))),
        85: rank(corr(_mix(h, c, 0.876703), adv(30), 10)) * rank(corr(ts_rank(mid, 4), ts_rank(v, 10), 7)),
        86: both(ts_rank(corr(c, total(adv(20), 15), 6), 20), rank(o + c - (w + o))),
        87: -fmax(rank(decay(delta(_mix(c, w, 0.369701), 2), 3)), ts_rank(decay(absolute(corr(neutral(adv(81)), c, 13)), 5), 14)),
        88: fmin(rank(decay(rank(o) + rank(l) - (rank(h) + rank(c)), 8)), ts_rank(decay(corr(ts_rank(c, 8), ts_rank(adv(60), 20), 8), 7), 3)),
        89: ts_rank(decay(corr(_mix(l, l, 0.967285), adv(10), 7), 6), 4) - ts_rank(decay(delta(neutral(w), 3), 10), 15),
        90: -(rank(c - top(c, 5)) * ts_rank(corr(neutral(adv(40)), l, 5), 3)),
        91: -(ts_rank(decay(decay(corr(neutral(c), v, 10), 16), 4), 5) - rank(decay(corr(w, adv(30), 4), 3))),
        92: fmin(ts_rank(decay(mid + c < l + o, 15), 19), ts_rank(decay(corr(rank(l), rank(adv(30)), 8), 7), 7)),
        93: ts_rank(decay(corr(neutral(w), adv(81), 17), 20), 8) / rank(decay(delta(_mix(c, w, 0.524434), 3), 16)),
        94: -(rank(w - low_of(w, 12)) * ts_rank(corr(ts_rank(w, 20), ts_rank(adv(60), 4), 18), 3)),
        95: rank(o - low_of(o, 13)) < ts_rank(power(rank(corr(total(mid, 19), total(adv(40), 19), 13)), 5.0), 12),
        96: -fmax(ts_rank(decay(corr(rank(w), rank(v), 4), 4), 8), ts_rank(decay(argmax(corr(ts_rank(c, 7), ts_rank(adv(60), 4), 4), 13), 14), 13)),
        97: -(rank(decay(delta(neutral(_mix(l, w, 0.721001)), 3), 20)) - ts_rank(decay(ts_rank(corr(ts_rank(l, 8), ts_rank(adv(60), 17), 5), 19), 16), 16)),
        98: rank(decay(corr(w, total(adv(5), 26), 5), 7)) - rank(decay(ts_rank(argmin(corr(rank(o), rank(adv(15)), 21), 9), 7), 8)),
        99: both(rank(corr(total(mid, 20), total(adv(60), 20), 9)), rank(corr(l, v, 6))),
        100: 0 - (1.5 * scale(neutral(neutral(rank(flow)))) - scale(neutral(corr(c, rank(adv(20)), 5) - rank(argmin(c, 30))))) * v / adv(20),
        101: (c - o) / (h - l + 0.001),
    }


#: Factors of gtja191 with a recursive average: they have no SQL twin.
RECURRING = (9, 22, 23, 24, 28, 47, 57, 63, 67, 68, 72, 79, 81, 82, 89, 96, 102, 109, 111, 122, 135, 146, 151, 152, 155, 158, 160, 162, 164, 169, 173, 174, 188)


def gtja191() -> dict[int, X]:
    """By number. u is the amount over a hundred volumes, w the panel's vwap."""
    u, mid, typical = col("amount") / (v * 100 + 1), (h + l) / 2, (h + l + c) / 3
    p, po, pl = delay(c, 1), delay(o, 1), delay(l, 1)
    ret, d = (c - p) / p, c - p
    gain, loss = where(d > 0, d, 0.0), where(d < 0, -d, 0.0)
    over, under = high2(d, 0.0), absolute(d)
    up, down = c > p, c < p
    held = low2(up + down, 1.0)
    pull = where(held >= 1.0, c - where(up, low2(l, p), where(down, high2(h, p), c)), 0.0)
    money = (c - l - (h - c)) / (h - l) * v
    signed = where(up, v, -where(down, v, 0.0))
    hl, phl = h + l, delay(h, 1) + delay(l, 1)
    stretch = high2(absolute(h - delay(h, 1)), absolute(l - delay(l, 1)))
    fell, rose = total(where(hl < phl, stretch, 0.0), 12), total(where(phl < hl, stretch, 0.0), 12)
    sma = lambda x, n, m: average(x, m / n)
    back = lambda n: (c - delay(c, n)) / delay(c, n)
    away = lambda n: (c - mean(c, n)) / mean(c, n)
    stoch = lambda n: (c - low_of(l, n)) / (top(h, n) - low_of(l, n))
    fall_from = lambda n: (top(h, n) - c) / (top(h, n) - low_of(l, n)) * 100
    trend = lambda x, n: cov(x, number(x), n) / (std(number(x), n) * std(number(x), n))
    less = lambda a, b: where(a < b, -1.0, 0.0)
    square = lambda x: x * x
    mid_move = (mid - (delay(h, 1) + delay(l, 1)) / 2) * ((h - l) / v)
    bull, bear = total(high2(h - delay(typical, 1), 0.0), 26), total(high2(delay(typical, 1) - l, 0.0), 26)
    m8, m2 = mean(c, 8), mean(c, 2)
    bend = (delay(c, 20) - delay(c, 10)) / 10 - (delay(c, 10) - c) / 10
    dtm, dbm = where(o <= po, 0.0, high2(h - o, o - po)), where(o >= po, 0.0, high2(o - l, o - po))
    sd_, sb = total(dtm, 20), total(dbm, 20)
    a_, b_, e_, f_ = absolute(h - p), absolute(l - p), absolute(p - po), absolute(h - pl)
    wide = high2(high2(h - l, absolute(p - h)), absolute(p - l))
    hd, ld = h - delay(h, 1), pl - l
    plus, minus = total(where(ld > 0, where(ld > hd, ld, 0.0), ld * 0), 14) * 100 / total(wide, 14), total(where(hd > 0, where(hd > ld, hd, 0.0), hd * 0), 14) * 100 / total(wide, 14)
    strength = mean(absolute(plus - minus) / (plus + minus) * 100, 6)
    bench = market(c)
    pb = delay(bench, 1)
    weak = where(bench < pb, 1.0, 0.0)
    br, cr = bench / pb - 1, c / p - 1
    brd = br - mean(br, 20)
    lo, hi = low2(l, p), high2(h, p)
    term = lambda n: (c - total(lo, n)) / total(hi - lo, n)
    geo = power(c / delay(c, 19), 1 / 20) - 1
    above, below = cr > geo, cr < geo
    csum = lambda n: total(c - mean(c, n), n)
    s3 = sma(sma(sma(log(c), 13, 2), 13, 2), 13, 2)
    rsi = sma(over, 12, 1) / sma(under, 12, 1) * 100
    narrow = (h - l) / (total(c, 5) / 5)
    dev = ret - sma(ret, 61, 2)
    macd = average(c, 2 / 13) - average(c, 2 / 27)
    vmacd = sma(v, 13, 2) - sma(v, 27, 2)
    accum = v * (c - l - (h - c)) / (h - l)
    s9 = delay(sma(delay(c / delay(c, 9), 1), 9, 1), 1)
    sd1 = delay(sma(d, 9, 1), 1)
    raw9 = stoch(9) * 100
    k1 = average(raw9, 1 / 3)
    far = typical * v
    dtp = typical - delay(typical, 1)
    money_up, money_down = total(where(dtp > 0, far, 0.0), 14), total(where(dtp < 0, far, 0.0), 14)
    ratio12 = (c - top(c, 12)) / top(c, 12) * 100
    z22 = away(6)
    return {
        1: -corr(rank(delta(log(v), 1)), rank((c - o) / o), 6), 2: -delta((c - l - (h - c)) / (h - l), 1), 3: total(pull, 6),
        4: where(m8 + std(c, 8) < m2, -1.0, where(m2 < m8 - std(c, 8), 1.0, where(v / mean(v, 20) > 1.0, 1.0, -1.0))), 5: -top(corr(ts_rank(v, 5), ts_rank(h, 5), 5), 3),
        6: -rank(sign(delta(_mix(o, h, 0.85), 4))), 7: (rank(top(u - c, 3)) + rank(low_of(u - c, 3))) * rank(delta(v, 3)), 8: -rank(delta(_mix(mid, u, 0.2), 4)), 9: average(mid_move, 2 / 7),
        10: rank(top(square(where(ret < 0, std(ret, 20), c)), 5)), 11: total(money, 6), 12: rank(o - mean(u, 10)) * -rank(absolute(c - u)), 13: power(h * l, 0.5) - u, 14: delta(c, 5), 15: o / p - 1,
        16: -top(rank(corr(rank(v), rank(u), 5)), 5), 17: finite(power(rank(u - top(u, 15)), absolute(delta(c, 5)))), 18: c / delay(c, 5),
        19: where(c < delay(c, 5), back(5), where(c > delay(c, 5), (c - delay(c, 5)) / c, 0.0)), 20: back(6) * 100, 21: trend(mean(c, 6), 6), 22: average(z22 - delay(z22, 3), 1 / 12),
        23: average(where(up, std(c, 20), 0.0), 1 / 20) / (average(where(up, std(c, 20), 0.0), 1 / 20) + average(where(up, 0.0, std(c, 20)), 1 / 20)) * 100, 24: average(delta(c, 5), 1 / 5),
        25: -rank(delta(c, 7) * (1 - rank(decay(v / mean(v, 20), 9)))) * (1 + rank(partial_sum(ret, 60, 20))), 26: mean(c, 7) - c + corr(u, delay(c, 5), 30), 27: decay(back(3) * 100 + back(6) * 100, 12),
        28: 3 * k1 - 2 * average(k1, 1 / 3), 29: back(6) * v, 30: decay(square(ret), 20), 31: away(12) * 100, 32: -total(rank(corr(rank(h), rank(v), 3)), 3),
        33: (-low_of(l, 5) + delay(low_of(l, 5), 5)) * rank((partial_sum(ret, 60, 30) - partial_sum(ret, 20, 10)) / 40) * ts_rank(v, 5), 34: mean(c, 12) / c,
        35: -low2(rank(decay(delta(o, 1), 15)), rank(decay(corr(v, _mix(o, o, 0.65), 17), 7))), 36: rank(total(corr(rank(v), rank(u), 6), 2)), 37: -rank(total(o, 5) * total(ret, 5) - delay(total(o, 5) * total(ret, 5), 10)),
        38: where(mean(h, 20) < h, -delta(h, 2), 0.0), 39: -(rank(decay(delta(c, 2), 8)) - rank(decay(corr(_mix(u, o, 0.3), total(mean(v, 30), 10), 14), 12))),
        40: total(where(up, v, 0.0), 26) / total(where(up, 0.0, v), 26) * 100, 41: -rank(top(delta(u, 3), 5)), 42: -rank(std(h, 10)) * corr(h, v, 10), 43: total(signed, 6),
        44: ts_rank(decay(corr(l, mean(v, 10), 7), 6), 4) + ts_rank(decay(delta(u, 3), 10), 15), 45: rank(delta(_mix(c, o, 0.6), 1)) * rank(corr(u, mean(v, 30), 15)), 46: (mean(c, 3) + mean(c, 6) + mean(c, 12) + mean(c, 24)) / (4 * c),
        47: average(fall_from(6), 1 / 9), 48: -rank(sign(d) + sign(p - delay(c, 2)) + sign(delay(c, 2) - delay(c, 3))) * (total(v, 5) / total(v, 20)), 49: fell / (fell + rose), 50: rose / (rose + fell) - fell / (rose + fell), 51: rose / (rose + fell),
        52: bull / bear * 100, 53: total(up, 12) / 12 * 100, 54: -rank(std(absolute(c - o), 10) + (c - o) + corr(c, o, 10)),
        55: total(16 * (d + (c - o) / 2 + p - po) / where(a_ > b_, where(a_ > f_, a_ + b_ / 2 + e_ / 4, b_ + a_ / 2 + e_ / 4), b_ + a_ / 2 + e_ / 4) * high2(a_, b_), 20),
        56: rank(o - low_of(o, 12)) < rank(power(rank(corr(total(mid, 19), total(mean(v, 30), 19), 13)), 5.0)), 57: average(raw9, 1 / 3), 58: total(up, 20) / 20 * 100, 59: total(pull, 20), 60: total(money, 20),
        61: -high2(rank(decay(delta(u, 1), 12)), rank(decay(rank(corr(l, mean(v, 30), 8)), 17))), 62: -corr(h, rank(v), 5), 63: average(over, 1 / 6) / average(under, 1 / 6) * 100,
        64: -high2(rank(decay(corr(rank(u), rank(v), 4), 4)), rank(decay(top(fill(corr(rank(c), rank(mean(v, 10)), 4), 0.0), 4), 6))), 65: mean(c, 6) / c, 66: away(6) * 100, 67: average(over, 1 / 24) / average(under, 1 / 24) * 100, 68: average(mid_move, 2 / 15),
        69: where(sd_ > sb, (sd_ - sb) / sd_, where(sd_ < sb, (sd_ - sb) / sb, 0.0)), 70: std(col("amount"), 6), 71: away(24) * 100, 72: average(fall_from(6), 1 / 15),
        73: -(ts_rank(decay(decay(corr(c, v, 10), 16), 4), 5) - rank(decay(corr(u, mean(v, 30), 4), 3))), 74: rank(corr(total(_mix(l, u, 0.35), 10), total(mean(v, 10), 10), 7)) + rank(corr(rank(u), rank(v), 6)),
        75: total(where(c > o, weak, 0.0), 20) / total(weak, 20), 76: std(absolute(c / p - 1) / v, 20) / mean(absolute(c / p - 1) / v, 20), 77: low2(rank(decay(mid + h - (u + h), 20)), rank(decay(corr(mid, mean(v, 30), 3), 6))),
        78: (typical - mean(typical, 12)) / (0.015 * mean(absolute(c - mean(typical, 12)), 12)), 79: average(over, 1 / 12) / average(under, 1 / 12) * 100, 80: (v - delay(v, 5)) / delay(v, 5) * 100, 81: average(v, 2 / 21), 82: average(fall_from(6), 1 / 20),
        83: -rank(cov(rank(h), rank(v), 5)), 84: total(signed, 20), 85: ts_rank(v / mean(v, 20), 20) * ts_rank(-delta(c, 7), 8), 86: where(bend > 0.25, -1.0, where(bend < 0.0, 1.0, -d)),
        87: -(rank(decay(delta(u, 4), 7)) + ts_rank(decay((_mix(l, l, 0.9) - u) / (o - mid), 11), 7)), 88: back(20) * 100, 89: 2 * (macd - average(macd, 2 / 10)), 90: -rank(corr(rank(u), rank(v), 5)), 91: -rank(c - top(c, 5)) * rank(corr(mean(v, 30), l, 5)),
        92: -high2(rank(decay(delta(_mix(c, u, 0.35), 2), 3)), ts_rank(decay(absolute(corr(mean(v, 30), c, 13)), 5), 15)), 93: total(where(o < po, high2(o - l, o - po), 0.0), 20), 94: total(signed, 30), 95: std(col("amount"), 20), 96: average(k1, 1 / 3), 97: std(v, 10),
        98: where(delta(mean(c, 30), 30) / delay(c, 30) <= 0.05, -(c - low_of(c, 30)), -delta(c, 3)), 99: -rank(cov(rank(c), rank(v), 5)), 100: std(v, 20), 101: less(rank(corr(c, total(mean(v, 30), 37), 15)), rank(corr(rank(h), rank(mean(v, 10)), 11))),
        102: sma(high2(v - delay(v, 1), 0.0), 6, 1) / sma(absolute(v - delay(v, 1)), 6, 1) * 100, 103: (20 - argmin(l, 20)) / 20 * 100, 104: -(delta(corr(h, v, 5), 5) * rank(std(c, 20))), 105: -corr(rank(o), rank(v), 10), 106: delta(c, 20),
        107: -rank(o - delay(h, 1)) * rank(o - p) * rank(o - pl), 108: -power(rank(h - low_of(h, 2)), rank(corr(w, mean(v, 120), 6))), 109: sma(h - l, 10, 2) / sma(sma(h - l, 10, 2), 10, 2), 110: total(high2(h - p, 0.0), 20) / total(high2(p - l, 0.0), 20) * 100,
        111: sma(accum, 11, 2) - sma(accum, 4, 2), 112: (total(gain, 12) - total(loss, 12)) / (total(gain, 12) + total(loss, 12)) * 100, 113: -(rank(total(delay(c, 5), 20) / 20) * corr(c, v, 2)) * rank(corr(total(c, 5), total(c, 20), 2)),
        114: rank(delay(narrow, 2)) * rank(rank(v)) / (narrow / (w - c)), 115: power(rank(corr(_mix(h, c, 0.9), mean(v, 30), 10)), rank(corr(ts_rank(mid, 4), ts_rank(v, 10), 7))), 116: trend(c, 20), 117: ts_rank(v, 32) * (1 - ts_rank(c + h - l, 16)) * (1 - ts_rank(cr, 32)),
        118: total(h - o, 20) / total(o - l, 20) * 100, 119: rank(decay(corr(w, total(mean(v, 5), 26), 5), 7)) - rank(decay(ts_rank(low_of(corr(rank(o), rank(mean(v, 15)), 21), 9), 7), 8)), 120: rank(w - c) / rank(w + c),
        121: -power(rank(w - low_of(w, 12)), ts_rank(corr(ts_rank(w, 20), ts_rank(mean(v, 60), 2), 18), 3)), 122: (s3 - delay(s3, 1)) / delay(s3, 1), 123: less(rank(corr(total(mid, 20), total(mean(v, 60), 20), 9)), rank(corr(l, v, 6))),
        124: (c - w) / decay(rank(top(c, 30)), 2), 125: rank(decay(corr(w, mean(v, 80), 17), 20)) / rank(decay(delta(_mix(c, w, 0.5), 3), 16)), 126: typical, 127: power(mean(square(ratio12), 12), 0.5), 128: 100 - 100 / (1 + money_up / money_down), 129: total(loss, 12),
        130: rank(decay(corr(mid, mean(v, 40), 9), 10)) / rank(decay(corr(rank(w), rank(v), 7), 3)), 131: power(rank(delta(w, 1)), ts_rank(corr(c, mean(v, 50), 18), 18)), 132: mean(col("amount"), 20), 133: (20 - argmax(h, 20)) / 20 * 100 - (20 - argmin(l, 20)) / 20 * 100,
        134: back(12) * v, 135: sma(delay(c / delay(c, 20), 1), 20, 1), 136: -rank(delta(cr, 3)) * corr(o, v, 10),
        137: 16 * ((d + (c - o) / 2 + p - po) / where(a_ > high2(b_, f_), a_ + b_ / 2 + e_ / 4, where(b_ > high2(f_, a_), b_ + a_ / 2 + e_ / 4, f_ + e_ / 4))) * high2(a_, b_),
        138: -(rank(decay(delta(_mix(l, w, 0.7), 3), 20)) - ts_rank(decay(ts_rank(corr(ts_rank(l, 8), ts_rank(mean(v, 60), 17), 5), 19), 16), 7)), 139: -corr(o, v, 10),
        140: low2(rank(decay(rank(o) + rank(l) - (rank(h) + rank(c)), 8)), ts_rank(decay(ts_rank(corr(ts_rank(c, 8), ts_rank(mean(v, 60), 20), 8), 7), 7), 3)), 141: -rank(corr(rank(h), rank(mean(v, 15)), 9)),
        142: -rank(ts_rank(c, 10)) * rank(delta(delta(c, 1), 1)) * rank(ts_rank(v / mean(v, 20), 5)), 143: finite(running_product(1 + where(d > 0, ret, 0.0))),
        144: total(absolute(c / p - 1) / col("amount") * (d < 0), 20) / total(d < 0, 20), 145: (mean(v, 9) - mean(v, 26)) / mean(v, 12) * 100, 146: mean(dev, 20) * dev / sma(square(dev), 60, 2), 147: trend(mean(c, 12), 12),
        148: less(rank(corr(o, total(mean(v, 60), 9), 6)), rank(o - low_of(o, 14))), 149: cov(ret * weak, br * weak, 20) / square(std(br * weak, 20)), 150: typical * v, 151: sma(c - delay(c, 20), 20, 1), 152: sma(mean(s9, 12) - mean(s9, 26), 9, 1),
        153: (mean(c, 3) + mean(c, 6) + mean(c, 12) + mean(c, 24)) / 4, 154: less(w - low_of(w, 16), corr(w, mean(v, 180), 18)), 155: vmacd - sma(vmacd, 10, 2), 156: -high2(rank(decay(delta(w, 5), 3)), rank(decay(-(delta(_mix(o, l, 0.15), 2) / _mix(o, l, 0.15)), 3))),
        157: low_of(rank(rank(log(low_of(rank(rank(-rank(delta(c - 1, 5)))), 2)))), 5) + ts_rank(delay(-cr, 6), 5), 158: (h - sma(c, 15, 2) - (l - sma(c, 15, 2))) / c, 159: (term(6) * 288 + term(12) * 144 + term(24) * 72) / 504 * 100,
        160: sma(std(c, 20) * (c <= p), 20, 1), 161: mean(wide, 12), 162: (rsi - low_of(rsi, 12)) / (top(rsi, 12) - low_of(rsi, 12)), 163: rank(-cr * mean(v, 20) * w * (h - c)), 164: sma((where(d > 0, 1 / d, 1.0) - low_of(where(d > 0, 1 / d, 1.0), 12)) / (h - l) * 100, 13, 2),
        165: (top(csum(48), 48) - low_of(csum(48), 48)) / std(c, 48), 166: total(cr - mean(cr, 20), 20) * (-20 * 19**1.5) / (19 * 18 * power(total(square(cr), 20), 1.5)), 167: total(over, 12), 168: -(v / mean(v, 20)), 169: sma(mean(sd1, 12) - mean(sd1, 26), 10, 1),
        170: rank(1 / c) * v / mean(v, 20) * (h * rank(h - c) / (total(h, 5) / 5)) - rank(w - delay(w, 5)), 171: -((l - c) * power(o, 5.0)) / ((c - h) * power(c, 5.0)), 172: strength, 173: 3 * sma(c, 13, 2) - 2 * sma(sma(c, 13, 2), 13, 2) + s3,
        174: sma(std(c, 20) * up, 20, 1), 175: mean(wide, 6), 176: corr(rank(stoch(12)), rank(v), 6), 177: (20 - argmax(h, 20)) / 20 * 100, 178: ret * v, 179: rank(corr(w, v, 4)) * rank(corr(rank(l), rank(mean(v, 50)), 12)),
        180: -ts_rank(absolute(delta(c, 7)), 60) * sign(delta(c, 7)) * (mean(v, 20) < v) + -v * (1 - (mean(v, 20) < v)), 181: total(cr - mean(cr, 20) - square(brd), 20) / total(brd * brd * brd, 20),
        182: total(where(c > o, where(bench > pb, 1.0, 0.0), where(c < o, weak, 0.0)), 20) / 20, 183: (top(csum(24), 24) - low_of(csum(24), 24)) / std(c, 24), 184: rank(corr(delay(o - c, 1), c, 200)) + rank(o - c), 185: rank(-square(1 - o / c)),
        186: (strength + delay(strength, 6)) / 2, 187: total(high2(h - o, o - po) * (1 - (o <= po)), 20), 188: ((h - l) - sma(h - l, 11, 2)) / sma(h - l, 11, 2) * 100, 189: mean(absolute(c - mean(c, 6)), 6),
        190: log((total(above, 20) - 1) * total(square(cr - geo) * below, 20) / (total(below, 20) * total(square(cr - geo) * above, 20))), 191: corr(mean(v, 20), l, 5) + mid - c,
    }
