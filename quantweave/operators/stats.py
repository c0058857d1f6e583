"""Tests and estimates over many groups: market models, multiple testing, value at risk, time series, bootstraps."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..scratch import stored

MODULUS, STEP, TURN = 2147483647, 48271, 69621


def draw(*parts: Column) -> Column:
    """A pseudo-random integer below 2^31 - 1 from integer columns, the same on any engine."""
    out = F.lit(12345).cast("long")
    for p in parts:
        out = (out * STEP + p.cast("long") * TURN + 11) % MODULUS
        out = (out * out + 12345) % MODULUS
    return out


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, to about 1e-7 (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(x)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def two_sided_p(t: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(t)))


def market_model(rows: DataFrame, keys: list[str], y: str = "r", x: str = "m") -> DataFrame:
    """keys, n, alpha, beta, r2, residual_std, t_alpha of a regression of y on x, from sums."""
    s = rows.filter(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"))
    beta = F.try_divide("c", "vx")
    sse = F.greatest(F.col("n") * (F.col("vy") - F.pow(F.col("c"), F.lit(2.0)) / F.col("vx")), F.lit(0.0))
    sd = F.when(F.col("n") > 2, F.sqrt(sse / (F.col("n") - 2)))
    alpha = F.col("my") - beta * F.col("mx")
    se = sd * F.sqrt(1 / F.col("n") + F.col("mx") * F.col("mx") / (F.col("n") * F.col("vx")))
    good = s.filter("n >= 3 and vx > 0")
    return good.select(*keys, "n", alpha.alias("alpha"), beta.alias("beta"), F.try_divide(F.pow(F.col("c"), F.lit(2.0)), F.col("vx") * F.col("vy")).alias("r2"), sd.alias("residual_std"), F.try_divide(alpha, se).alias("t_alpha"))


def benjamini_hochberg(p: DataFrame, level: float) -> DataFrame:
    """p (id, p) with adjusted and rejected: a running minimum from the largest p-value down.

    Hypotheses are dealt out by ranges of p; ranks and minima go from range to range by a table of one row a range.
    """
    parts = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(p.repartitionByRange(parts, "p", "id").withColumn("_part", F.spark_partition_id()))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    one = Window.orderBy("_part")  # a row a range
    offsets = counts.select("_part", (F.sum("_n").over(one) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_m"))
    own = Window.partitionBy("_part").orderBy("p", "id")
    ranked = rows.withColumn("_k", F.row_number().over(own)).join(F.broadcast(offsets), "_part")
    ranked = stored(ranked.withColumn("_x", F.col("p") * F.col("_m") / (F.col("_k") + F.col("_before"))))
    least = ranked.groupBy("_part").agg(F.min("_x").alias("_least"))
    later = least.select("_part", F.min("_least").over(one.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    # the least from a row on, as a running one from the end: a frame to the end is gone through anew for every row
    inside = F.min("_x").over(Window.partitionBy("_part").orderBy(F.desc("p"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.withColumn("_inside", inside).join(F.broadcast(later), "_part", "left")
    adjusted = F.least(F.col("_inside"), F.coalesce("_later", F.lit(1.0)), F.lit(1.0))
    return out.select(*p.columns, adjusted.alias("adjusted"), (adjusted <= level).alias("rejected"))


def overfitting(returns: DataFrame, blocks: int) -> DataFrame:
    """n, pbo: over all halves of the blocks of dates, how often the best strategy inside is at most the median outside.

    Input strategy, date, r. A half's Sharpe ratio comes from sums by block; ties share their mean rank, and of
    equal bests the first strategy counts.
    """
    one = Window.partitionBy(F.lit(0)).orderBy("date")
    dates = returns.select("date").distinct()
    n = dates.count()
    placed = dates.withColumn("block", F.floor((F.row_number().over(one) - 1) * blocks / F.lit(n)).cast("int"))
    sums = returns.join(F.broadcast(placed), "date").groupBy("strategy", "block").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    if comb(blocks, blocks // 2) * blocks > 2_000_000:  # rows that are made here and sent to all
        raise ValueError(f"too many halves of {blocks} blocks")
    combos = [(i, b, int(b in c)) for i, c in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    c = returns.sparkSession.createDataFrame(combos, "combo int, block int, inside int")
    t = sums.join(F.broadcast(c), "block").groupBy("combo", "strategy", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)))
    t = t.withColumn("sr", F.round(F.coalesce(F.try_divide(mean, sd), F.lit(0.0)), 9)).groupBy("combo", "strategy").pivot("inside", [0, 1]).agg(F.first("sr"))
    w = Window.partitionBy("combo")
    rank = F.rank().over(w.orderBy("0")) + (F.count(F.lit(1)).over(Window.partitionBy("combo", "0")) - 1) / 2
    t = t.withColumn("rank", rank).withColumn("m", F.count(F.lit(1)).over(w)).withColumn("best", F.row_number().over(w.orderBy(F.desc("1"), "strategy"))).filter("best = 1")
    share = F.col("rank") / (F.col("m") + 1)
    return t.agg(F.count(F.lit(1)).alias("n"), F.avg((F.log(share / (1 - share)) <= 0).cast("double")).alias("pbo"))


def sharpe_stats(returns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, sr, skew, kurt (3 for a normal) per observation."""
    return returns.groupBy(*keys).agg(F.count("r").alias("n"), F.try_divide(F.avg("r"), F.stddev_samp("r")).alias("sr"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt"))


def probabilistic_sharpe(sr: Column, n: Column, benchmark: Column, skew: Column, kurt: Column) -> Column:
    """Confidence that a Sharpe ratio is above the benchmark's."""
    spread = F.sqrt(F.greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, F.lit(1e-12)))
    return normal_cdf((sr - benchmark) * F.sqrt(n - 1) / spread)


def expected_best(trials: int, std: Column) -> Column:
    """Expected largest of so many trials' Sharpe ratios without skill (extreme-value approximation)."""
    from statistics import NormalDist

    if trials < 2:
        return std * 0.0
    z, e, gamma = NormalDist().inv_cdf, 2.718281828459045, 0.5772156649015329
    return std * ((1 - gamma) * z(1 - 1 / trials) + gamma * z(1 - 1 / (trials * e)))


def half_life(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, half_life = -ln 2 / b of changes on levels; null unless b < 0."""
    w = Window.partitionBy(*keys).orderBy("date")
    d = rows.withColumn("_l", F.lag(x).over(w)).withColumn("_d", F.col(x) - F.col("_l")).filter("_d is not null")
    b = F.try_divide(F.covar_pop("_l", "_d"), F.var_pop("_l"))
    return d.groupBy(*keys).agg(b.alias("b")).select(*keys, F.when(F.col("b") < 0, -F.log(F.lit(2.0)) / F.col("b")).alias("half_life"))


def ljung_box(rows: DataFrame, keys: list[str], x: str, lags: int) -> DataFrame:
    """keys, q = n (n + 2) sum rho_k^2 / (n - k)."""
    w = Window.partitionBy(*keys)
    d = rows.withColumn("_z", F.col(x) - F.avg(x).over(w))
    back = [F.lag("_z", k).over(w.orderBy("date")).alias(f"_{k}") for k in range(1, lags + 1)]
    s = d.select(*keys, "_z", *back).groupBy(*keys).agg(F.count("_z").alias("n"), F.sum(F.col("_z") * F.col("_z")).alias("v"), *[F.sum(F.col("_z") * F.col(f"_{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    total = sum((F.pow(F.try_divide(f"c{k}", "v"), F.lit(2.0)) / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    return s.select(*keys, (F.col("n") * (F.col("n") + 2) * total).alias("q"))


def permutation_drawdowns(trades: DataFrame, keys: list[str], start: float, sims: int, most: int = 20_000) -> DataFrame:
    """keys, actual (worst drawdown in trade order), share of permutations at least as bad. Input keys, seq, pnl.

    A key's trades are packed into one row and permuted in its task, so no permutation is rows of a shuffle. The order of a permutation
    follows from seq alone, so keys with the same numbers share it. Keys of more than `most` trades go by windows.
    """
    counted = trades.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    packed = counted.filter(F.col("_n") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("s"), F.col("pnl").cast("double").alias("p")))).alias("_t"))
    packed = packed.select(*keys, F.col("_t.s").alias("_s"), F.col("_t.p").alias("_p"))
    target = StructType([*[f for f in packed.schema.fields if f.name in keys], StructField("actual", DoubleType()), StructField("share", DoubleType())])
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders: dict[bytes, np.ndarray] = {}
        for batch in batches:
            actual, share = np.full(batch.num_rows, np.nan), np.full(batch.num_rows, np.nan)
            seqs, pnls = np.asarray(batch["_s"].flatten()), batch["_p"].flatten().to_numpy(zero_copy_only=False)
            sizes = np.asarray(batch["_s"].value_lengths())
            ends = np.cumsum(sizes)
            alike: dict[bytes, list[int]] = {}
            for k, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
                if not np.isnan(pnls[end - n : end]).all():
                    alike.setdefault(seqs[end - n : end].tobytes(), []).append(k)
            for name, places in alike.items():
                seq = np.frombuffer(name, np.int64)
                many = max(1, 100_000 // sims)
                for i in range(0, len(places), many):
                    at = np.array(places[i : i + many])
                    pnl = np.nan_to_num(pnls[ends[at][:, None] - len(seq) + np.arange(len(seq))])  # a null adds nothing
                    actual[at] = worst_drawdowns(pnl, np.arange(len(seq))[:, None], start)[:, 0]
                    as_bad = np.zeros(len(at))
                    step = max(1, 2_000_000 // len(seq))
                    for first in range(1, sims + 1, step):
                        order = orders.get(name) if step > sims else None
                        if order is None:
                            numbers = np.arange(first, min(first + step, sims + 1), dtype=np.int64)
                            order = np.argsort(drawn(numbers[None, :], seq[:, None]), axis=0, kind="stable")
                            if len(seq) <= 64 and len(orders) < 256:
                                orders[name] = order
                        as_bad += (worst_drawdowns(pnl, order, start) <= actual[at][:, None]).sum(axis=1)
                    share[at] = as_bad / sims
            columns = [batch[f.name] if f.name in keys else pa.array(c, mask=np.isnan(c)) for f, c in zip(arrow, [None] * len(keys) + [actual, share])]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    # few bytes, much work: as many tasks as asked for
    tasks = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = packed.repartition(tasks, *keys).mapInArrow(run, target)
    return short.unionByName(_permutations_by_windows(counted.filter(F.col("_n") > most).drop("_n"), keys, start, sims))


def drawn(*parts: np.ndarray) -> np.ndarray:
    """draw() of integers from 0 on, in numpy."""
    out = np.int64(12345)
    for p in parts:
        out = (out * STEP + p * TURN + 11) % MODULUS
        out = (out * out + 12345) % MODULUS
    return out


def worst_drawdowns(pnl: np.ndarray, order: np.ndarray, start: float) -> np.ndarray:
    """(keys, orders): the lowest of equity less its peak, to four places, for pnl (keys, trades) in each order (trades, orders)."""
    total = np.zeros((len(pnl), order.shape[1]))
    peak, worst = np.full_like(total, start), np.zeros_like(total)
    for row in order:
        total += pnl[:, row]
        equity = start + total
        np.maximum(peak, equity, out=peak)
        np.minimum(worst, equity - peak, out=worst)
    return -np.floor(-worst * 1e4 + 0.5) / 1e4


def _permutations_by_windows(trades: DataFrame, keys: list[str], start: float, sims: int) -> DataFrame:
    every = trades.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims))))
    order = F.when(F.col("sim") == 0, F.col("seq")).otherwise(draw(F.col("sim"), F.col("seq")))
    w = Window.partitionBy(*keys, "sim").orderBy(order, "seq").rowsBetween(Window.unboundedPreceding, 0)
    e = every.withColumn("e", start + F.sum("pnl").over(w)).withColumn("_o", order)
    e = e.withColumn("dd", F.col("e") - F.greatest(F.max("e").over(Window.partitionBy(*keys, "sim").orderBy("_o", "seq").rowsBetween(Window.unboundedPreceding, 0)), F.lit(start)))
    worst = e.groupBy(*keys, "sim").agg(F.round(F.min("dd"), 4).alias("dd"))
    out = worst.withColumn("actual", F.max(F.when(F.col("sim") == 0, F.col("dd"))).over(Window.partitionBy(*keys)))
    return out.filter("sim > 0").groupBy(*keys, "actual").agg(F.avg((F.col("dd") <= F.col("actual")).cast("double")).alias("share"))


def bootstrap(rows: DataFrame, keys: list[str], statistic: Column, sims: int, confidence: float) -> DataFrame:
    """keys, lo, hi: quantiles of a statistic (an aggregate of r) over resamples with replacement, drawn by index."""
    w = Window.partitionBy(*keys)
    base = rows.withColumn("_i", F.row_number().over(w.orderBy("date")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    picks = base.select(*keys, "_i", "_n", F.explode(F.sequence(F.lit(1), F.lit(sims))).alias("sim")).select(*keys, "sim", (draw(F.col("sim"), F.col("_i")) % F.col("_n")).cast("int").alias("_i"))
    got = picks.join(base.select(*keys, "_i", "r"), [*keys, "_i"]).groupBy(*keys, "sim").agg(statistic.alias("s"))
    half = (1 - confidence) / 2
    return got.groupBy(*keys).agg(F.percentile("s", F.lit(half)).alias("lo"), F.percentile("s", F.lit(1 - half)).alias("hi"))


def event_study(returns: DataFrame, events: DataFrame, window: tuple[int, int], estimation: tuple[int, int]) -> DataFrame:
    """rel, n, aar, t: mean abnormal return by day around events under a market model of each event's own earlier bars.

    Input symbol, k (bar number), r, m; events symbol, k0. Bars meet events by symbol, in a bounded range of bars.
    """
    lo, hi = min(window[0], estimation[0]), max(window[1], estimation[1])
    near = events.withColumn("k", F.explode(F.sequence(F.col("k0") + lo, F.col("k0") + hi)))
    rows = returns.join(near, ["symbol", "k"]).withColumn("rel", F.col("k") - F.col("k0"))
    model = market_model(rows.filter(F.col("rel").between(*estimation)), ["symbol", "k0"]).select("symbol", "k0", "alpha", "beta")
    ar = rows.filter(F.col("rel").between(*window)).join(model, ["symbol", "k0"]).select("rel", (F.col("r") - F.col("alpha") - F.col("beta") * F.col("m")).alias("ar"))
    return ar.groupBy("rel").agg(F.count("ar").alias("n"), F.avg("ar").alias("aar"), F.try_divide(F.avg("ar"), F.stddev_samp("ar") / F.sqrt(F.count("ar"))).alias("t"))


def kupiec(breaches: DataFrame, keys: list[str], confidence: float) -> DataFrame:
    """keys, n, x, lr of the proportion of breaches (column v, 0 or 1)."""
    p = 1 - confidence
    s = breaches.groupBy(*keys).agg(F.count("v").alias("n"), F.sum("v").alias("x"))
    n, x = F.col("n"), F.col("x")
    share = x / n
    part = lambda k, q: F.when(k > 0, k * F.log(q)).otherwise(0.0)
    lr = -2 * (part(n - x, F.lit(1 - p)) + part(x, F.lit(p)) - part(n - x, 1 - share) - part(x, share))
    return s.select(*keys, "n", "x", lr.alias("lr"))


def christoffersen(breaches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n00, n01, n10, n11, lr of independence of breaches from the day before."""
    w = Window.partitionBy(*keys).orderBy("date")
    b = breaches.withColumn("_b", F.lag("v").over(w))
    n = lambda i, j: F.sum(((F.col("_b") == i) & (F.col("v") == j)).cast("long"))
    s = b.filter("_b is not null").groupBy(*keys).agg(n(0, 0).alias("n00"), n(0, 1).alias("n01"), n(1, 0).alias("n10"), n(1, 1).alias("n11"))
    a, b_, c, d = (F.col(f"n{k}") for k in ("00", "01", "10", "11"))
    part = lambda k, q: F.when(k > 0, k * F.log(q)).otherwise(0.0)
    p01, p11, p = F.try_divide(b_, a + b_), F.try_divide(d, c + d), (b_ + d) / (a + b_ + c + d)
    lr = -2 * (part(a + c, 1 - p) + part(b_ + d, p) - part(a, 1 - p01) - part(b_, p01) - part(c, 1 - p11) - part(d, p11))
    return s.select(*keys, "n00", "n01", "n10", "n11", lr.alias("lr"))


def splits_kfold(n: int, folds: int, horizon: int, embargo: int, rows: DataFrame) -> DataFrame:
    """fold, i, role of rows i = 0.. with labels that end `horizon` rows later: test, train, purged (label overlaps the test block) or embargo."""
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    r = rows.select("i", fold.alias("fold")).withColumn("lo", F.ceil(F.col("fold") * F.lit(n) / folds)).withColumn("hi", F.ceil((F.col("fold") + 1) * F.lit(n) / folds) - 1)
    i = F.col("i")
    role = F.when(i.between(F.col("lo"), F.col("hi")), "test").when((i < F.col("lo")) & (i + horizon >= F.col("lo")), "purged").when((i > F.col("hi")) & (i <= F.col("hi") + horizon), "purged")
    return r.select("fold", "i", role.when((i > F.col("hi")) & (i <= F.col("hi") + horizon + embargo), "embargo").otherwise("train").alias("role"))


def bm25(docs: DataFrame, terms: list[str], keys: list[str], text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """keys, score of documents for distinct query terms, with idf = ln((N - n + 0.5) / (n + 0.5) + 1)."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+"), lambda w: w != "")

    def frequency(term: str) -> Column:
        return F.size(F.filter("w", lambda word: word == term))

    d = docs.select(*keys, words.alias("w")).select(*keys, F.size("w").alias("len"), *[frequency(t).alias(f"t{i}") for i, t in enumerate(terms)])
    s = d.agg(F.count(F.lit(1)).alias("N"), F.avg("len").alias("avg"), *[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(terms))])
    j = d.join(F.broadcast(s))  # one row of totals
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("N") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5) + 1)
        tf = F.col(f"t{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return j.select(*keys, score.alias("score"))
