"""Books of weights by optimisation on each date: risk parity, largest diversification, largest Sharpe ratio, long only.

A decision of a date sees returns of earlier dates alone. Each position brings the returns of its symbol's last
`lookback` dates, a book (the positions of one date, and of one group if there are groups) is packed into a row, and the books of a
batch are solved side by side: covariances by matrix products over the dates that two symbols share, weights by
Newton steps (risk parity) or by exchange of whole sets of weights between zero and free (the others). Books for which
these don't meet the conditions below go on by sweeps of coordinate descent, where a step is the exact minimum in one weight. All
three problems are of the form
min y'Sy / 2 - ... over y >= 0, whose solution is the book up to its size:

- risk parity: - sum(log y_i) / n, at which all y_i (Sy)_i are 1 / n;
- diversification: - v'y with the volatilities v, at which (Sy)_i = v_i where y_i > 0 and (Sy)_i >= v_i elsewhere;
- Sharpe ratio: the same with mean returns less the riskless one in the place of v.

Defined cases: a symbol must have a row on every date of its series (a dense panel); dates with fewer than `lookback` earlier
ones keep their positions, as do books in which two symbols share less than two dates. A symbol whose return
doesn't move makes the book one of equal weights, and so does a book without a mean above the riskless one. Zero
and null positions take no part. Covariances over different dates may make a matrix by which some book has less than no
risk: where the steps then find no book that meets the conditions, negative eigenvalues are raised to almost zero. Signs of positions stay; absolute weights add up to 1. `ridge` times the mean variance is
added to variances, so that books of more symbols than dates have an answer. Books of more than `LARGE` symbols have covariances of far fewer
dimensions than symbols; they are solved from these factors (weigh_large), negative eigenvalues raised first, and no matrix of symbols squared is made
unless most symbols have dates of their own. Books of more than `most` symbols are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

METHODS = ("risk_parity", "diversification", "sharpe")
#: Books of more symbols than this are solved from factors, each by itself.
LARGE = 64


def covariances(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means (n) and covariances (n, n) of series (n, time), each pair over the dates that both have; nan below two."""
    there = ~np.isnan(x)
    m, v = there.astype(float), np.where(there, x, 0.0)
    count = m @ m.T
    total = v @ m.T
    with np.errstate(all="ignore"):
        cov = (v @ v.T - total * total.T / count) / (count - 1)
        return v.sum(axis=1) / m.sum(axis=1), np.where(count >= 2, cov, np.nan)


def definite(cov: np.ndarray) -> np.ndarray:
    """cov with its least eigenvalues raised to what `ridge` gives by default, 1e-8 of the mean variance."""
    values, vectors = np.linalg.eigh(cov)
    least = 1e-8 * values.mean()
    return cov if values[0] >= least else (vectors * np.maximum(values, least)) @ vectors.T


def unit(s: np.ndarray, aim: np.ndarray, live: np.ndarray, log: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, b, v): the problem in units of each symbol's volatility v, so that one tolerance does for all."""
    v = np.sqrt(np.where(live, np.einsum("bii->bi", s), 1.0))
    return s / v[:, :, None] / v[:, None, :], np.where(live, aim if log else aim / v, 0.0), v


def newton(c: np.ndarray, b: np.ndarray, live: np.ndarray, steps: int = 200, tol: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
    """(y, solved) of min y'cy / 2 - sum(b log y): damped Newton steps, which never leave y > 0, until a full one is safe."""
    eye = np.eye(b.shape[1])
    c = np.where(live[:, :, None] & live[:, None, :], c, eye)
    least = np.where(live, b, np.inf).min(axis=1)
    y = np.where(live, np.sqrt(b), 1.0)
    y /= np.sqrt(np.maximum(np.einsum("bi,bij,bj->b", y, c, y), 1e-12))[:, None]
    out, done, at = np.where(live, y, 0.0), np.zeros(len(y), bool), np.arange(len(y))
    for _ in range(steps):
        g = np.where(live, np.einsum("bij,bj->bi", c, y) - b / y, 0.0)
        try:
            d = np.linalg.solve(c + eye * (b / y**2)[:, None, :], g[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            break
        square = np.einsum("bi,bi->b", g, d) / least
        far = np.sqrt(np.maximum(square, 0.0))
        y = y - d * np.where(far < 0.38, 1.0, 1 / (1 + far))[:, None]
        y0 = np.where(live, y, 0.0)
        over = violation(c, b, y0, live, True) <= tol
        # a negative square is a direction without a minimum
        lost = (square < 0) | ~np.isfinite(y).all(axis=1) | (y0 < 0).any(axis=1)
        out[at[over & ~lost]], done[at[over & ~lost]] = y0[over & ~lost], True
        keep = ~(over | lost)
        if not keep.any():
            break
        c, b, y, live, least, at = c[keep], b[keep], y[keep], live[keep], least[keep], at[keep]
    return out, done


def exchange(c: np.ndarray, b: np.ndarray, live: np.ndarray, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(y, solved) of min y'cy / 2 - b'y over y >= 0: the free weights solve linear equations, and weights that turn out on
    the wrong side change it together; one at a time (the last) where changing all of them has stopped to help."""
    n = b.shape[1]
    eye, place = np.eye(n), np.arange(n)
    free = live & (b > 0)
    best, tries = np.full(len(b), n + 1), np.full(len(b), 3)
    out, done, at = np.zeros_like(b), np.zeros(len(b), bool), np.arange(len(b))
    for _ in range(100 + 10 * n):
        try:
            y = np.linalg.solve(np.where(free[:, :, None] & free[:, None, :], c, eye), np.where(free, b, 0.0)[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            break
        y = np.where(free, y, 0.0)
        slope = np.einsum("bij,bj->bi", c, y) - b
        wrong = live & np.where(free, y < 0, slope < -tol / 10)
        count = wrong.sum(axis=1)
        over = count == 0
        out[at[over]], done[at[over]] = y[over], violation(c[over], b[over], y[over], live[over], False) <= tol
        keep = ~over
        if not keep.any():
            break
        c, b, live, free, wrong, count, best, tries, at = (a[keep] for a in (c, b, live, free, wrong, count, best, tries, at))
        better = count < best
        one = ~better & (tries <= 0)
        best, tries = np.where(better, count, best), np.where(better, 3, tries - 1)
        last = place == np.where(wrong, place, -1).max(axis=1)[:, None]
        free = free ^ np.where(one[:, None], last, wrong)
    return out, done


def solve(s: np.ndarray, aim: np.ndarray, live: np.ndarray, log: bool) -> np.ndarray:
    """y of many problems side by side: s (books, n, n) with a positive diagonal where live, aim (books, n).

    With `log` the aim is the share of each risk contribution, else the linear term.
    """
    c, b, v = unit(s, aim, live, log)
    y, done = newton(c, b, live) if log else exchange(c, b, live)
    out = y / v
    # by sweeps, where they settle soon; else without negative eigenvalues, with which both ways have an answer
    for mend in (False, True):
        left = np.flatnonzero(~done)
        if not len(left):
            break
        if mend:
            s[left] = [definite(m) for m in s[left]]
            c, b, v = unit(s[left], aim[left], live[left], log)
            y, fine = newton(c, b, live[left]) if log else exchange(c, b, live[left])
            out[left], done[left] = y / v, fine
            left = left[~fine]
        if len(left):
            out[left], done[left] = descend(s[left], aim[left], live[left], log, 20_000 if mend else 300)
    return out


def descend(s: np.ndarray, aim: np.ndarray, live: np.ndarray, log: bool, rounds: int = 20_000, tol: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
    """(y, solved) as by solve(), for any symmetric s: sweeps over the weights."""
    c, b, v = unit(s, aim, live, log)
    y = np.where(live, np.sqrt(np.maximum(b, 0.0)) if log else np.maximum(b, 0.0), 0.0)
    out, done = np.zeros_like(y), np.zeros(len(y), bool)
    at = np.arange(len(y))
    n = y.shape[1]
    for r in range(rounds):
        for i in range(n):
            rest = np.einsum("bj,bj->b", c[:, i], y) - c[:, i, i] * y[:, i]
            new = (np.sqrt(rest * rest + 4 * b[:, i]) - rest) / 2 if log else np.maximum(b[:, i] - rest, 0.0)
            y[:, i] = np.where(live[:, i], new, 0.0)
        if r % 5 == 4 or n <= 2:
            over = violation(c, b, y, live, log) <= tol
            lost = ~(y.max(axis=1) < 1e6)  # weights of a book without a least risk grow for ever
            if over.any() or lost.any() or r >= rounds - 5:
                out[at], done[at] = y, over
                keep = ~(over | lost)
                if not keep.any():
                    break
                c, b, y, live, at = c[keep], b[keep], y[keep], live[keep], at[keep]
    out[at] = y
    return out / v, done


def violation(s: np.ndarray, b: np.ndarray, y: np.ndarray, live: np.ndarray, log: bool) -> np.ndarray:
    """The largest amount by which the conditions of the best y fail, a book."""
    g = np.einsum("bij,bj->bi", s, y)
    off = np.abs(y * g - b) if log else np.where(y > 0, np.abs(g - b), np.maximum(b - g, 0.0))
    return np.where(live, off, 0.0).max(axis=1)


def factors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(u, values): covariances() of x (symbols, dates) as (u * values) @ u.T with orthonormal columns, without a matrix of symbols squared.

    Symbols with returns on the same dates have covariances of as many dimensions as dates; what is decomposed is a matrix of
    these, for each set of dates that more symbols than dates have, and of the symbols with dates of their own. None where two symbols share less than two dates.
    """
    there = ~np.isnan(x)
    v = np.where(there, x, 0.0)
    masks, kind, size = np.unique(there, axis=0, return_inverse=True, return_counts=True)
    large = np.flatnonzero(size > masks.sum(axis=1))
    rest = np.flatnonzero(~np.isin(kind, large))
    own = [np.flatnonzero(kind == p) for p in large]
    q, r = zip(*[np.linalg.qr(v[i]) for i in own]) if own else ((), ())
    sizes = [*[len(b) for b in r], len(rest)]
    ends = np.cumsum(sizes)
    spots = [slice(e - k, e) for e, k in zip(ends, sizes)]
    core = np.zeros((ends[-1], ends[-1]))
    for a, p in enumerate(large):
        for b in range(a, len(large)):
            both = (masks[p] & masks[large[b]]).astype(float)
            count = both.sum()
            if count < 2:
                return None
            middle = (np.diag(both) - np.outer(both, both) / count) / (count - 1)
            core[spots[a], spots[b]] = r[a] @ middle @ r[b].T
            core[spots[b], spots[a]] = core[spots[a], spots[b]].T
        if len(rest):
            both = there[rest] & masks[p]
            count = both.sum(axis=1)
            if count.min() < 2:
                return None
            theirs = np.where(both, v[rest], 0.0)
            theirs = np.where(both, theirs - (theirs.sum(axis=1) / count)[:, None], 0.0) / (count - 1)[:, None]
            core[spots[a], spots[-1]] = r[a] @ theirs.T
            core[spots[-1], spots[a]] = core[spots[a], spots[-1]].T
    if len(rest):
        core[spots[-1], spots[-1]] = covariances(x[rest])[1]
    if not np.isfinite(core).all():
        return None
    values, e = np.linalg.eigh(core)
    u = np.empty((len(x), len(values)))
    for i, base, spot in zip(own, q, spots):
        u[i] = base @ e[spot]
    u[rest] = e[spots[-1]]
    return u, values


def parity(u: np.ndarray, rho: np.ndarray, b: np.ndarray, steps: int = 300) -> np.ndarray | None:
    """y of min y'(uu' + rho)y / 2 - sum(b log y): Newton steps as far as they lead down; a step costs symbols times dimensions squared."""
    y = np.sqrt(b)
    y = y / np.sqrt((rho * y * y).sum() + ((u.T @ y) ** 2).sum())
    eye, least, before = np.eye(u.shape[1]), b.min(), np.inf
    for _ in range(steps):
        g = rho * y + u @ (u.T @ y) - b / y
        delta = rho + b / y**2
        scaled = u / delta[:, None]
        d = g / delta - scaled @ np.linalg.solve(eye + u.T @ scaled, u.T @ (g / delta))
        far = np.sqrt(max(float(g @ d), 0.0) / least)
        if not np.isfinite(far):
            return None
        # within rounding of the best: no weight moves by more than this share
        if far <= 1e-10 or (far <= 1e-6 and far >= before / 2):
            return y - d if (y - d).min() > 0 else y
        before = far
        # the least along the line, at which the slope is 0; it rises all the way to the first weight that gets to 0
        curve, slope = (rho * d * d).sum() + ((u.T @ d) ** 2).sum(), (rho * y * d).sum() + (u.T @ y) @ (u.T @ d)
        end = 1 / max((d / y).max(), 1e-300)
        low, high, t = 0.0, end, min(1.0, 0.9 * end)
        for _ in range(60):
            part = b * d / (y - t * d)
            f, f1 = t * curve - slope + part.sum(), curve + (part * d / (y - t * d)).sum()
            low, high = (low, t) if f > 0 else (t, high)
            if abs(f) <= 1e-3 * abs(g @ d):
                break
            t = t - f / f1
            t = t if low < t < high else (low + high) / 2
        y = y - t * d
    return None


def nonnegative(u: np.ndarray, rho: np.ndarray, b: np.ndarray, steps: int = 500) -> np.ndarray | None:
    """y of min y'(uu' + rho)y / 2 - b'y over y >= 0.

    With w = u'y every weight is max(b - uw, 0) / rho, so what is sought are as many numbers w as there are dimensions: the least of
    a convex function of pieces that are quadratic, by Newton steps that go as far as they lead down.
    """
    w, eye = np.zeros(u.shape[1]), np.eye(u.shape[1])
    r = b.copy()
    for _ in range(steps):
        free = r > 0
        own = u[free]
        g = w - own.T @ (r[free] / rho[free])
        d = -np.linalg.solve(eye + own.T @ (own / rho[free][:, None]), g)
        s = u @ d
        if not np.isfinite(s).all():
            return None
        # a whole step that leaves the set of free weights as it is ends at the least
        after = r - s
        if (((after > 0) == free) | (np.abs(after) <= 1e-15 * np.abs(b).max())).all():
            return np.maximum(after, 0.0) / rho
        squared, flat = d @ d, w @ d

        def slope(t: float) -> float:
            return flat + t * squared - (s * np.maximum(r - t * s, 0.0) / rho).sum()  # noqa: B023

        low, high = 0.0, 1.0
        while slope(high) < 0 and high < 1e9:
            low, high = high, 2 * high
        for _ in range(50):
            t = (low + high) / 2
            low, high = (t, high) if slope(t) < 0 else (low, t)
        w = w + high * d
        r = b - u @ w
    return None


def weigh_large(x: np.ndarray, method: str, riskless: float, ridge: float) -> np.ndarray | None:
    """Absolute weights of one book (symbols, dates) as by weigh(), from factors; negative eigenvalues are raised at once, so the answer is the only one."""
    there = ~np.isnan(x)
    if not there.any(axis=1).all():
        return None
    mean = np.where(there, x, 0.0).sum(axis=1) / there.sum(axis=1)
    own = factors(x)
    if own is None or (there.sum(axis=1) < 2).any():
        return None
    vol = np.nanstd(x, axis=1, ddof=1)
    n = len(x)
    even = np.full(n, 1 / n)
    aim = {"risk_parity": even, "diversification": vol, "sharpe": mean - riskless}[method]
    if vol.min() < 1e-12 or aim.max() <= 0:
        return even
    u, values = own
    some = values > 1e-14 * values.max()
    u, least = u[:, some] * np.sqrt(values[some]), ridge * (vol**2).mean()
    v = np.sqrt((u * u).sum(axis=1) + least)
    y = parity(u / v[:, None], least / v**2, even) if method == "risk_parity" else nonnegative(u / v[:, None], least / v**2, aim / v)
    if y is None:  # by the matrix itself
        y = solve((u @ u.T + least * np.eye(n))[None], aim[None], np.ones((1, n), bool), method == "risk_parity")[0] * v
    y = y / v
    return y / y.sum() if y.sum() > 0 else even


def weigh(books: list[np.ndarray], method: str, riskless: float, ridge: float) -> list[np.ndarray | None]:
    """Absolute weights of each book (symbols, dates) of returns; None where it keeps its positions."""
    out: list[np.ndarray | None] = [None] * len(books)
    todo = []
    for k, x in enumerate(books):
        if len(x) > LARGE and ridge > 0:
            out[k] = weigh_large(x, method, riskless, ridge)
            continue
        mean, cov = covariances(x)
        if not np.isfinite(cov).all() or not np.isfinite(mean).all():
            continue
        # more symbols than dates: the steps below lose their digits, and where the answer is the only one factors give the same
        if len(x) > x.shape[1] and ridge > 0 and np.linalg.eigvalsh(cov + ridge * np.diag(cov).mean() * np.eye(len(x)))[0] > 0:
            out[k] = weigh_large(x, method, riskless, ridge)
            continue
        vol = np.sqrt(np.maximum(np.diag(cov), 0.0))
        out[k] = np.full(len(x), 1 / len(x))
        aim = {"risk_parity": np.full(len(x), 1 / len(x)), "diversification": vol, "sharpe": mean - riskless}[method]
        if vol.min() >= 1e-12 and aim.max() > 0:
            todo.append((k, cov + ridge * np.diag(cov).mean() * np.eye(len(x)), aim))
    todo.sort(key=lambda t: -len(t[2]))  # books of like size together, 16 MB a matrix of theirs
    while todo:
        n = len(todo[0][2])
        many = max(1, min(4096, 2_000_000 // n**2))
        some, todo = todo[:many], todo[many:]
        s, aim, live = np.zeros((len(some), n, n)), np.zeros((len(some), n)), np.zeros((len(some), n), bool)
        for i, (_, cov, b) in enumerate(some):
            s[i, : len(b), : len(b)], aim[i, : len(b)], live[i, : len(b)] = cov, b, True
        y = solve(s, aim, live, method == "risk_parity")
        for (k, _, b), w in zip(some, y):
            w = w[: len(b)]
            out[k] = w / w.sum() if w.sum() > 0 else out[k]
    return out


def optimise(returns: DataFrame, positions: DataFrame, method: str, lookback: int = 60, book: list[str] | None = None, riskless: float = 0.0, ridge: float = 1e-8, most: int = 20_000) -> DataFrame:
    """symbol, date, the book's columns, weight: positions (symbol, date, weight, book columns) after optimisation.

    returns: symbol, date, r of a dense panel.
    """
    if method not in METHODS or lookback < 5:
        raise ValueError(f"one of {METHODS} over 5 dates or more")
    book = book or []
    before = Window.partitionBy("symbol").orderBy("date").rowsBetween(-lookback, -1)
    seen = returns.select("symbol", "date", F.transform(F.collect_list(F.struct(F.col("r").cast("double").alias("r"))).over(before), lambda x: x["r"]).alias("_past"))
    rows = positions.select("symbol", "date", *book, F.col("weight").cast("double").alias("weight")).join(seen, ["symbol", "date"], "left")
    active = (F.abs("weight") > 1e-9) & (F.size("_past") == lookback)
    idle = rows.filter(~F.coalesce(active, F.lit(False))).select("symbol", "date", *book, "weight")
    # a book is as large as its positions, of which there are `most` at the utmost
    packed = rows.filter(active).groupBy("date", *book).agg(F.array_sort(F.collect_list(F.struct("symbol", "weight", "_past"))).alias("_p"))
    small = F.when(F.size("_p") > most, F.raise_error(F.lit(f"a book of more than {most} symbols"))).otherwise(F.lit(True))
    packed = packed.filter(small)
    packed = packed.select("date", *book, F.transform("_p", lambda p: p["symbol"]).alias("_s"), "_p")
    target = StructType([*[f for f in packed.schema.fields if f.name != "_p"], StructField("_w", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.asarray(batch["_p"].value_lengths()))[:-1]
            _, weight, past = batch["_p"].flatten().flatten()
            weights = np.split(np.asarray(weight), ends)
            books = np.split(past.flatten().to_numpy(zero_copy_only=False).reshape(-1, lookback), ends)
            found = weigh(books, method, riskless, ridge)
            signed = [p if w is None else np.sign(p) * w for p, w in zip(weights, found)]
            yield pa.RecordBatch.from_arrays([batch[f.name] if f.name != "_w" else pa.array(signed, f.type) for f in arrow], schema=arrow)

    # small rows, much work: as many tasks as asked for, not as few as their bytes need
    tasks = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    solved = packed.repartition(tasks, "date", *book).mapInArrow(run, target).select("date", *book, F.explode(F.arrays_zip("_s", "_w")).alias("_z"))
    return solved.select(F.col("_z._s").alias("symbol"), "date", *book, F.col("_z._w").alias("weight")).unionByName(idle)
