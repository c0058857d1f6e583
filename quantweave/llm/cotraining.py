"""Operator 2: document quality by co-training of two views.

The content view sees the text alone: how often its words, pairs of words and runs of signs come up, by hashed
buckets, and how words and lines repeat. The metadata view never sees the text: source, language and length as the
table has them. Each view has a logistic regression. In each round each view labels, among all unlabelled
documents, those of which it is surest, of both kinds, and the other view learns from them besides the true labels.
At the end a regression on both views' log-odds calibrates and combines them, on labelled rows that neither view has
learned from, and all documents are scored.

Texts are read once: buckets are kept as one byte each, and rounds work on that table. A round is two passes over
it: quantiles of the log-odds give the thresholds, then sums over the chosen rows, wherever they lie, give each view
a Newton step. Only sums (a matrix a view) reach the driver.

The fit takes at most `labelled` rows with labels, by the order of a hash of the id. Nothing bounds the unlabelled.

Defined cases: null texts are empty texts; null source, language and length are values of their own; labels that
are null or without a document teach nothing; of repeated labels the larger counts; rows that share an id have its
label each; without both kinds of label every score is 0.5; an empty table gives no rows; of other columns none is
read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, hash_sample, held_out, per_batch, stored, text_bytes
from .graph import look_up

BUCKETS, SHAPES = 512, 8
SOURCES, LANGS = 256, 32
CONTENT, PAGE = BUCKETS + SHAPES, SOURCES + LANGS + 12
#: Words in lower case, and runs of other signs by their kind and not their length.
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\s]+|\n+")


def content_view(text: bytes | None, bucket: Memo) -> np.ndarray:
    """Shares of hashed tokens and pairs of tokens (square roots), and shapes of words and lines, as bytes from 0 to 255."""
    x = np.zeros(CONTENT)
    if not text:
        return x.astype(np.uint8)
    tokens = TOKEN.findall(text.lower())
    if tokens:
        one = np.fromiter(map(bucket.__getitem__, tokens), np.int64, len(tokens))
        pair = (one[:-1] * 31 + one[1:]) % BUCKETS
        x[:BUCKETS] = np.sqrt((np.bincount(one % BUCKETS, minlength=BUCKETS) + np.bincount(pair, minlength=BUCKETS)) / (2 * len(tokens)))
    lines = text.split(b"\n")
    n = max(1, len(tokens))
    words = [t for t in tokens if t[:1].isalnum() or t[0] >= 128]
    x[BUCKETS:] = (
        len(set(tokens)) / n, len(set(lines)) / len(lines), min(1.0, len(text) / n / 20), min(1.0, np.log1p(len(tokens)) / 12), len(words) / n,
        min(1.0, np.log1p(len(text) / len(lines)) / 12), len(set(words)) / max(1, len(words)), 1,
    )
    return np.round(x * 255).astype(np.uint8)


def place(value: str | None, n: int) -> int:
    return xxhash.xxh3_64_intdigest(value if value is not None else "\0") % n


def page_rows(source: np.ndarray, lang: np.ndarray, length: np.ndarray) -> np.ndarray:
    """One-hot rows of the metadata view."""
    x = np.zeros((len(source), PAGE))
    at = np.arange(len(source))
    x[at, source], x[at, SOURCES + lang], x[at, SOURCES + LANGS + length] = 1, 1, 1
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Curvature and slope of the likelihood of labels y at the weights w (the last is the intercept)."""
    p = sigmoid(log_odds(x, w))
    x = np.hstack([x, np.ones((len(x), 1))])
    return (x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p)


def step(w: np.ndarray, h: np.ndarray, g: np.ndarray, ridge: float) -> np.ndarray:
    """w after one Newton step of the penalised likelihood; the intercept isn't penalised."""
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    return w + np.linalg.solve(h + np.diag(penalty), g - penalty * w)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights by Newton steps."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        h, g = newton_sums(x, y, w)
        new = step(w, h, g, ridge)
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w


@dataclass(frozen=True)
class QualityModel:
    content: np.ndarray
    page: np.ndarray
    combine: np.ndarray
    #: Pseudo-labels that each view got in each round: (round, content, page).
    rounds: tuple[tuple[int, int, int], ...] = ()
    #: The views before any exchange.
    first: tuple[np.ndarray, np.ndarray] | None = None

    def scores(self, content: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = log_odds(content, self.content), log_odds(page, self.page)
        return sigmoid(a), sigmoid(b), sigmoid(log_odds(np.stack([a, b], axis=1), self.combine))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, content (bytes), source, lang, length (numbers) for every row: one pass over the texts."""

    def make():
        bucket = Memo(lambda token: xxhash.xxh3_64_intdigest(token if token[:1].isalnum() or token[0] >= 128 else token[:2]) % (1 << 32), 300_000)

        def work(batch: pa.RecordBatch) -> dict:
            return {
                "doc_id": batch["doc_id"], "held_out": batch["held_out"], "content": [content_view(t, bucket).tobytes() for t in batch["text"].to_pylist()],
                "source": [place(s, SOURCES) for s in batch["source"].to_pylist()], "lang": [place(s, LANGS) for s in batch["lang"].to_pylist()],
                "length": [11 if n is None else min(10, int(np.log2(max(1, n)) / 1.6)) for n in batch["n_chars"].to_pylist()],
            }

        return work

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), held_out().alias("held_out"),
    )
    return per_batch(rows, "doc_id long, held_out boolean, content binary, source int, lang int, length int", make)


def views(batch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows of features()."""
    raw = batch["content"].to_pylist() if isinstance(batch, pa.RecordBatch) else list(batch["content"])
    content = np.frombuffer(b"".join(map(bytes, raw)), np.uint8).reshape(len(raw), CONTENT) / 255.0
    number = lambda c: np.asarray(batch[c], np.int64)
    return content, page_rows(number("source"), number("lang"), number("length"))


def thresholds(pool: DataFrame, models: list[np.ndarray], rate: float, share: float, sure: float) -> list[tuple[float, float]]:
    """Of each view (low, high): log-odds from which it is among the surest of either kind, over the whole pool."""
    shared = pool.sparkSession.sparkContext.broadcast(models)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            a, b = views(batch)
            return {"a": log_odds(a, shared.value[0]), "b": log_odds(b, shared.value[1])}

        return work

    at = [share * (1 - rate), 1 - share * rate]
    got = per_batch(pool, "a double, b double", make).agg(*[F.percentile_approx(c, at, 10_000).alias(c) for c in "ab"]).first()
    limit = float(np.log(sure / (1 - sure)))
    return [(min(-limit, got[c][0]), max(limit, got[c][1])) if got[c] else (-np.inf, np.inf) for c in "ab"]


def pool_sums(pool: DataFrame, models: list[np.ndarray], limits: list[tuple[float, float]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Of each view: curvature, slope and number of the rows that the other view is sure of, labelled by that view."""
    shared = pool.sparkSession.sparkContext.broadcast((models, limits))
    width, sizes = 32, [CONTENT + 1, PAGE + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, limits = shared.value
        sums = [np.zeros((d, d + 2)) for d in sizes]  # curvature, slope, number
        for batch in batches:
            if not batch.num_rows:
                continue
            xs = views(batch)
            odds = [log_odds(x, w) for x, w in zip(xs, models)]
            for v in (0, 1):
                low, high = limits[1 - v]
                sure = np.flatnonzero((odds[1 - v] <= low) | (odds[1 - v] >= high))
                h, g = newton_sums(xs[v][sure], (odds[1 - v][sure] > 0).astype(float), models[v])
                sums[v][:, :-2] += h
                sums[v][:, -2] += g
                sums[v][:, -1] += len(sure)
        parts = [(v, i, s[i : i + width].tobytes()) for v, s in enumerate(sums) for i in range(0, len(s), width)]
        yield pa.RecordBatch.from_pydict({"view": pa.array([p[0] for p in parts], pa.int32()), "at": pa.array([p[1] for p in parts], pa.int32()), "sums": pa.array([p[2] for p in parts], pa.binary())})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in rows["sums"]], axis=0)
        return rows.iloc[:1].assign(sums=[total.tobytes()])

    schema = "view int, at int, sums binary"
    # a group is one stretch of rows of a matrix, from every task
    got = pool.mapInArrow(run, schema).groupBy("view", "at").applyInPandas(add, schema).collect()
    out = []
    for v, d in enumerate(sizes):
        s = np.zeros((d, d + 2))
        for r in got:
            if r["view"] == v:
                part = np.frombuffer(bytes(r["sums"])).reshape(-1, d + 2)
                s[r["at"] : r["at"] + len(part)] = part
        out.append((s[:, :-2], s[:, -2], int(s[0, -1])))
    return out


def co_train(x: list[np.ndarray], y: np.ndarray, apart: np.ndarray, pool: DataFrame, rounds: int = 3, share: float = 0.1, sure: float = 0.9, weight: float = 0.3, ridge: float = 0.1) -> QualityModel:
    """Both views from labelled rows x, y and the pool of unlabelled ones; rows `apart` only combine the views.

    A round takes at most `share` of the pool from each view for the other, in the labelled rows' proportion of kinds,
    and only where its probability is at least `sure`. All pseudo-labels of a view together count `weight` of a true
    label each, and no more than the true labels do.
    """
    own = ~apart
    first = [logistic(v[own], y[own], ridge) for v in x]
    models, log = list(first), []
    for k in range(rounds):
        limits = thresholds(pool, models, float(y[own].mean()), share, sure)
        sums = pool_sums(pool, models, limits)
        log.append((k, sums[0][2], sums[1][2]))
        for v, (h, g, n) in enumerate(sums):
            if n:
                each = min(weight, own.sum() / n)
                true_h, true_g = newton_sums(x[v][own], y[own], models[v])
                models[v] = step(models[v], true_h + each * h, true_g + each * g, ridge)
    held = apart if len(set(y[apart])) > 1 else np.ones(len(y), bool)
    odds = np.stack([log_odds(v[held], w) for v, w in zip(x, models)], axis=1)
    return QualityModel(models[0], models[1], logistic(odds, y[held], ridge), tuple(log), tuple(first))


def fit(rows: DataFrame, labels: DataFrame, labelled: int = 6000, **options) -> QualityModel:
    """From rows of features(), which should be stored, and labels."""
    neutral = QualityModel(np.zeros(CONTENT + 1), np.zeros(PAGE + 1), np.zeros(3))
    known = stored(labels.filter(~held_out() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y")))
    marked = look_up(rows.filter("not held_out"), known, "doc_id", "left")
    sample = hash_sample(marked.filter("y is not null"), "doc_id", labelled).toPandas()
    if sample["y"].nunique() < 2:
        return neutral
    sample = sample.sort_values(["doc_id", "content"], kind="stable")
    # rows of one id are apart together
    apart = np.array([zlib.crc32(f"apart {i}".encode()) % 5 == 0 for i in sample["doc_id"]])
    y = sample["y"].to_numpy(float)
    if len(set(y[~apart])) < 2:
        apart[:] = False
    pool = stored(marked.filter("y is null").select("content", "source", "lang", "length"))
    return co_train(list(views(sample)), y, apart, pool, **options)


def score(rows: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score (that quality is 1), predicted (1 if score >= 0.5), content_score, page_score of rows of features()."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            content, page, both = shared.value.scores(*views(batch))
            return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": both, "predicted": (both >= 0.5).astype(np.int32), "content_score": content, "page_score": page}

        return work

    return per_batch(rows, "doc_id long, held_out boolean, score double, predicted int, content_score double, page_score double", make)


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """score() of all documents by a model fitted on them."""
    rows = stored(features(docs))
    return score(rows, fit(rows, labels, **options))
