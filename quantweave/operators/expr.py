"""Nested factor expressions, evaluated level by level.

An expression is a tree of values: columns, arithmetic, windows over a symbol's bars, windows over a date's symbols.
Windows can't be nested in one projection, so all windows of a level, of all factors asked for, are computed
together, and equal parts once: hundreds of factors need as many shuffles as the deepest has changes of partition.
Each expression can also be written as SQL with one common table expression a level.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ts, xs
from .ewm import Ewm, ewm


@dataclass(frozen=True)
class X:
    op: str
    args: tuple[X, ...] = ()
    params: tuple = ()
    key: str = field(default="", compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "key", f"{self.op}({','.join(a.key for a in self.args)};{','.join(map(repr, self.params))})")

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, X) and self.key == other.key

    def __add__(self, y): return X("add", (self, value(y)))  # noqa: E704
    def __radd__(self, y): return X("add", (value(y), self))  # noqa: E704
    def __sub__(self, y): return X("sub", (self, value(y)))  # noqa: E704
    def __rsub__(self, y): return X("sub", (value(y), self))  # noqa: E704
    def __mul__(self, y): return X("mul", (self, value(y)))  # noqa: E704
    def __rmul__(self, y): return X("mul", (value(y), self))  # noqa: E704
    def __truediv__(self, y): return X("div", (self, value(y)))  # noqa: E704
    def __rtruediv__(self, y): return X("div", (value(y), self))  # noqa: E704
    def __neg__(self): return X("mul", (value(-1.0), self))  # noqa: E704
    def __lt__(self, y): return X("lt", (_steady(self), _steady(value(y))))  # noqa: E704
    def __gt__(self, y): return X("lt", (_steady(value(y)), _steady(self)))  # noqa: E704
    def __le__(self, y): return X("le", (_steady(self), _steady(value(y))))  # noqa: E704
    def __ge__(self, y): return X("le", (_steady(value(y)), _steady(self)))  # noqa: E704


def value(x: X | float) -> X:
    return x if isinstance(x, X) else X("lit", (), (float(x),))


def col(name: str) -> X:
    return X("col", (), (name,))


_W = "PARTITION BY symbol ORDER BY date"


def _last(n: int) -> str:
    return f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(e: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {_last(n)} = {n} THEN {e} END"


def _corr_sql(x: str, y: str, n: int, f: str) -> str:
    a, b, w = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END", _last(n)
    if f == "cov":
        return _full(f"covar_samp({a}, {b}) {w}", a, n)
    return f"CASE WHEN count({a}) {w} = {n} AND min({a}) {w} < max({a}) {w} AND min({b}) {w} < max({b}) {w} THEN covar_samp({a}, {b}) {w} / nullif(stddev_samp({a}) {w} * stddev_samp({b}) {w}, 0) END"


def _place_sql(x: str, n: int, best: str) -> str:
    return _full(f"CAST(list_position(list({x}) {_last(n)}, {best}({x}) {_last(n)}) - 1 AS DOUBLE)", x, n)


#: Values without windows: Spark, SQL.
PLAIN: dict[str, tuple[Callable[..., Column], Callable[..., str]]] = {
    "add": (lambda a, b: a + b, lambda a, b: f"({a} + {b})"),
    "sub": (lambda a, b: a - b, lambda a, b: f"({a} - {b})"),
    "mul": (lambda a, b: a * b, lambda a, b: f"({a} * {b})"),
    "div": (lambda a, b: F.try_divide(a, b), lambda a, b: f"({a} / nullif({b}, 0))"),
    "lt": (lambda a, b: F.coalesce(a < b, F.lit(False)).cast("double"), lambda a, b: f"CAST(coalesce({a} < {b}, false) AS DOUBLE)"),
    "le": (lambda a, b: F.coalesce(a <= b, F.lit(False)).cast("double"), lambda a, b: f"CAST(coalesce({a} <= {b}, false) AS DOUBLE)"),
    "where": (lambda c, a, b: F.when(c == 1.0, a).otherwise(b), lambda c, a, b: f"CASE WHEN {c} = 1 THEN {a} ELSE {b} END"),
    "abs": (F.abs, lambda a: f"abs({a})"),
    "sign": (F.signum, lambda a: f"sign({a})"),
    "log": (lambda a: F.when(a > 0, F.log(a)), lambda a: f"ln(CASE WHEN {a} > 0 THEN {a} END)"),
    "fmax": (lambda a, b: F.greatest(a, b), lambda a, b: f"greatest({a}, {b})"),
    "fmin": (lambda a, b: F.least(a, b), lambda a, b: f"least({a}, {b})"),
    "round": (lambda a: F.round(a, PLACES), lambda a: f"round({a}, {PLACES})"),
    "finite": (lambda a: F.when(F.abs(a) < float("inf"), a), lambda a: f"CASE WHEN isfinite({a}) THEN {a} END"),
    "low2": (lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), lambda a, b: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END"),
    "high2": (lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)), lambda a, b: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END"),
    "fill": (lambda a, b: F.coalesce(a, b), lambda a, b: f"coalesce({a}, {b})"),
    "power": (lambda a, b: F.signum(a) * F.pow(F.abs(a), b), lambda a, b: f"(sign({a}) * pow(abs({a}), {b}))"),
}
#: Windows: Spark, SQL; parameters come last.
WINDOWS: dict[str, tuple[Callable[..., Column], Callable[..., str]]] = {
    "mean": (ts.ts_mean, lambda x, n: _full(f"avg({x}) {_last(n)}", x, n)),
    "sum": (ts.ts_sum, lambda x, n: _full(f"sum({x}) {_last(n)}", x, n)),
    "std": (ts.ts_std, lambda x, n: _full(f"stddev_samp({x}) {_last(n)}", x, n)),
    "max": (ts.ts_max, lambda x, n: _full(f"max({x}) {_last(n)}", x, n)),
    "min": (ts.ts_min, lambda x, n: _full(f"min({x}) {_last(n)}", x, n)),
    "skew": (ts.ts_skew, lambda x, n: _full(f"skewness({x}) {_last(n)}", x, n)),
    "quantile": (lambda x, q, n: ts.ts_quantile(x, q, n), lambda x, q, n: _full(f"quantile_cont({x}, {q}) {_last(n)}", x, n)),
    "ts_rank": (ts.ts_rank, lambda x, n: _full(f"list_aggregate(list_transform(list({x}) {_last(n)}, lambda v: CASE WHEN v < {x} THEN 1.0 WHEN v = {x} THEN 0.5 ELSE 0 END), 'sum') / {n} + 0.5 / {n}", x, n)),
    "argmax": (ts.ts_argmax, lambda x, n: _place_sql(x, n, "max")),
    "argmin": (ts.ts_argmin, lambda x, n: _place_sql(x, n, "min")),
    "corr": (ts.ts_corr, lambda x, y, n: _corr_sql(x, y, n, "corr")),
    "cov": (ts.ts_cov, lambda x, y, n: _corr_sql(x, y, n, "cov")),
    "decay": (ts.decay_linear, lambda x, n: "((" + " + ".join(f"lag({x}, {k}) OVER ({_W}) * {k + 1}" if k else f"{x}" for k in range(n)) + f") / {n * (n + 1) / 2})"),
    "delay": (ts.delay, lambda x, d: f"lag({x}, {d}) OVER ({_W})"),
    "delta": (ts.delta, lambda x, d: f"({x} - lag({x}, {d}) OVER ({_W}))"),
    "product": (lambda x, n: ts.full(F.product(x).over(ts.last(n)), x, n), lambda x, n: _full(f"product({x}) {_last(n)}", x, n)),
    "partial_sum": (lambda x, n, least: F.when(F.count(x).over(ts.last(n)) >= least, F.sum(x).over(ts.last(n))), lambda x, n, least: f"CASE WHEN count({x}) {_last(n)} >= {least} THEN sum({x}) {_last(n)} END"),
    "running_product": (lambda x: F.when(x.isNotNull(), F.product(x).over(ts.so_far())), lambda x: f"CASE WHEN {x} IS NOT NULL THEN product({x}) OVER ({_W}) END"),
    "number": (lambda x: F.row_number().over(ts.series()).cast("double"), lambda x: f"CAST(row_number() OVER ({_W}) AS DOUBLE)"),
    "rank": (xs.rank, lambda x: f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END"),
    "zscore": (xs.zscore, lambda x: f"CASE WHEN min({x}) OVER (PARTITION BY date) < max({x}) OVER (PARTITION BY date) THEN ({x} - avg({x}) OVER (PARTITION BY date)) / stddev_samp({x}) OVER (PARTITION BY date) END"),
    "scale": (xs.scale, lambda x: f"({x} / nullif(sum(abs({x})) OVER (PARTITION BY date), 0))"),
    "market": (lambda x: F.avg(x).over(xs.section()), lambda x: f"avg({x}) OVER (PARTITION BY date)"),
    "neutral": (lambda x: xs.neutralize(x, F.col("sector")), lambda x: f"({x} - avg({x}) OVER (PARTITION BY date, sector))"),
}


def _steady(x: X) -> X:
    """x rounded, unless it is a column or a constant, or ranked already."""
    return x if x.op in ("col", "lit", "round", "sign") else X("round", (x,))


def fn(op: str) -> Callable[..., X]:
    def make(*args):
        exprs = tuple(_steady(a) if op in ("rank", "ts_rank", "argmax", "argmin") else a for a in args if isinstance(a, X))
        return X(op, exprs, tuple(a for a in args if not isinstance(a, X)))

    return make


average, partial_sum, running_product, mean, total, std, top, low_of, skew, quantile, ts_rank, argmax, argmin, corr, cov, decay, delay, delta, product, rank, zscore, scale, neutral, market, number = (
    fn(o) for o in "ewm partial_sum running_product mean sum std max min skew quantile ts_rank argmax argmin corr cov decay delay delta product rank zscore scale neutral market number".split()
)


def absolute(x): return X("abs", (x,))  # noqa: E704
def sign(x): return X("sign", (x,))  # noqa: E704
def log(x): return X("log", (x,))  # noqa: E704
def where(c, a, b): return X("where", (c, value(a), value(b)))  # noqa: E704
def fmax(a, b): return X("fmax", (a, b))  # noqa: E704
def fmin(a, b): return X("fmin", (a, b))  # noqa: E704
def power(a, b): return X("power", (a, value(b)))  # noqa: E704
def low2(a, b): return X("low2", (a, value(b)))  # noqa: E704
def high2(a, b): return X("high2", (a, value(b)))  # noqa: E704
def fill(a, b): return X("fill", (a, value(b)))  # noqa: E704
def finite(a): return X("finite", (a,))  # noqa: E704


#: Averages that recur along a series: no window of Spark or SQL, but one grouped pass a level.
RECURSIVE = ("ewm",)


class Levels:
    """The windows of a set of expressions by level, each with a name; what they read is a column by then."""

    def __init__(self, targets: dict[str, X]) -> None:
        self.level: dict[X, int] = {}
        self.name: dict[X, str] = {}
        self.done: set[X] = set()  # what is a column by now
        for x in targets.values():
            self._visit(x)
        self.depth = max(self.level.values(), default=0)

    def _visit(self, x: X) -> int:
        if x in self.level:
            return self.level[x]
        inner = max((self._visit(a) for a in x.args), default=0)
        if x.op in WINDOWS or x.op in RECURSIVE:
            for a in x.args:
                if a.op not in ("col", "lit") and a not in self.name:
                    self.name[a] = f"_x{len(self.name)}"
            inner += 1
            self.name.setdefault(x, f"_x{len(self.name)}")
        self.level[x] = inner
        return inner

    def steps(self) -> list[tuple[list[X], list[X]]]:
        """For each level: values that its windows read, and the windows."""
        out = []
        for k in range(1, self.depth + 1):
            windows = [x for x in self.name if (x.op in WINDOWS or x.op in RECURSIVE) and self.level[x] == k]
            reads = [x for x in self.name if x.op not in WINDOWS and x.op not in RECURSIVE and self.level[x] == k - 1]
            out.append((reads, windows))
        return out

    def column(self, x: X, own: bool = False) -> Column:
        if x in self.done and not own:
            return F.col(self.name[x])
        if x.op == "col":
            return F.col(x.params[0])
        if x.op == "lit":
            return F.lit(x.params[0])
        f = (WINDOWS if x.op in WINDOWS else PLAIN)[x.op][0]
        return f(*[self.column(a) for a in x.args], *x.params)

    def sql(self, x: X, own: bool = False) -> str:
        if x in self.done and not own:
            return self.name[x]
        if x.op == "col":
            return x.params[0]
        if x.op == "lit":
            return f"CAST({x.params[0]!r} AS DOUBLE)"
        f = (WINDOWS if x.op in WINDOWS else PLAIN)[x.op][1]
        return f(*[self.sql(a) for a in x.args], *x.params)


#: Added before results are rounded, so that values which lie half-way (ratios of small integers) go one way everywhere.
NUDGE = 1e-10
#: Places to which values are rounded before they are ranked or compared: sums in another order must not break ties.
PLACES = 8


def _column_of(plan: Levels, x: X) -> str:
    return plan.name.get(x) or x.params[0]


def evaluate(panel: DataFrame, targets: dict[str, X]) -> DataFrame:
    """symbol, date and a column for each target."""
    plan = Levels(targets)
    for reads, windows in plan.steps():
        averages = [x for x in windows if x.op in RECURSIVE]
        for new in (reads, [x for x in windows if x.op in WINDOWS]):
            if new:
                panel = panel.select("*", *[plan.column(x, True).alias(plan.name[x]) for x in new])
                plan.done.update(new)
        if averages:
            panel = ewm(panel, {plan.name[x]: Ewm(_column_of(plan, x.args[0]), x.params[0]) for x in averages})
            plan.done.update(averages)
    return panel.select("symbol", "date", *[plan.column(x).alias(n) for n, x in targets.items()])


def to_sql(source: str, targets: dict[str, X], digits: int = 6) -> str:
    """The same (without recursive averages) after a WITH clause that ends in a table named `source`: further tables, and a SELECT of rounded targets."""
    plan, parts, at = Levels(targets), [], source
    for k, (reads, windows) in enumerate(plan.steps()):
        for kind, xs_ in (("r", reads), ("w", windows)):
            if xs_:
                parts.append(f"{kind}{k} AS (SELECT *, {', '.join(f'{plan.sql(x, True)} AS {plan.name[x]}' for x in xs_)} FROM {at})")
                at = f"{kind}{k}"
                plan.done.update(xs_)
    body = ", ".join(f"round({plan.sql(x)} + {NUDGE!r}, {digits}) AS {n}" for n, x in targets.items())
    return "".join(f", {p}" for p in parts) + f" SELECT symbol, date, {body} FROM {at}"
