"""Operator 7: nearest vectors by largest inner product, with an inverted multi-index.

Vectors are cut into two halves; each half is quantised by its own codebook, so k + k centroids make k * k
cells. Nearness is the inner product, so a half lies the nearer to a centroid the larger their inner product is:
a query walks the cells by the sum of both halves' distances (the negative products), by a heap, until the cells
it has met hold enough entries; those are then reranked by the exact inner product. Vectors of any norms are
ordered rightly so, while Euclidean distance would hold long vectors back.

How many are enough is measured on the table itself: the true neighbours of a hashed sample of queries (`probes`),
found by reading every vector, give the recall of any number of entries, and the least number is taken whose recall
is `recall` with two standard errors to spare. Where that is half of the table, cells don't pay: every query then
meets every vector, in blocks, and the result is exact. `recall=1` asks for that at once: the exact way.

Codebooks are fitted on a bounded sample (`sample` vectors, and no more than `sample_bytes`, by the order of a hash
of their id); every vector is indexed and none is dropped: a cell with many entries is cut into blocks, and each
block meets its queries in a task of its own. Cell sizes (k * k numbers at most) are the only thing that is
broadcast besides codebooks and probes.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows
without an id; vectors of unequal length are compared as if the shorter ended in zeros; rows that share an id are
candidates and queries of their own; with fewer candidates than asked for all are given; an empty table gives no
rows; ties go to the smaller id; of other columns none is read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import hash_sample, per_batch, stored


@dataclass(frozen=True)
class MultiIndex:
    left: np.ndarray
    right: np.ndarray

    @property
    def cut(self) -> int:
        return self.left.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The cell number of each vector."""
        a = nearest(vectors[:, : self.cut], self.left)
        b = nearest(vectors[:, self.cut :], self.right)
        return a * len(self.right) + b

    def walk(self, query: np.ndarray, sizes: dict[int, int], enough: int) -> list[int]:
        """Non-empty cells by summed distance (negative inner products) until they hold `enough` entries."""
        da, db = -(self.left @ query[: self.cut]), -(self.right @ query[self.cut :])
        oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        da, db, oa, ob = da[oa].tolist(), db[ob].tolist(), oa.tolist(), ob.tolist()
        heap, seen, out, held = [(da[0] + db[0], 0, 0)], {(0, 0)}, [], 0
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            cell = oa[i] * len(ob) + ob[j]
            if n := sizes.get(cell, 0):
                out.append(cell)
                held += n
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(oa) and y < len(ob) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (da[x] + db[y], x, y))
        return out


    def order(self, query: np.ndarray, sizes: dict[int, int]) -> list[int]:
        """All non-empty cells by summed distance: what a walk to the end gives, sorted at once."""
        both = -(self.left @ query[: self.cut])[:, None] - (self.right @ query[self.cut :])[None, :]
        return [c for c in np.argsort(both, axis=None, kind="stable").tolist() if c in sizes]


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T, axis=1)


def codebook(points: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means on distinct points; at most k centres."""
    points = np.unique(points, axis=0)
    k = min(k, len(points))
    centres = points[np.random.default_rng(seed).choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<double> of the rows that take part, all of one length."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(good)
    longest = rows.agg(F.max(F.size("v")).alias("d")).first()["d"] or 0
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v")))
    return rows.select("vec_id", F.when(F.size("v") < longest, padded).otherwise(F.col("v")).alias("v"))


def packed(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and vectors of a bounded table, by way of bytes."""
    got = per_batch(rows.select("row", "v"), "row long, x binary", lambda: lambda batch: {"row": batch["row"], "x": [r.tobytes() for r in matrix(batch)]}).collect()
    return np.array([r["row"] for r in got], np.int64), np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float64).reshape(len(got), -1).copy()


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch["v"].flatten(), np.float64).reshape(batch.num_rows, -1)


def fit(rows: DataFrame, k: int, sample: int = 20_000, sample_bytes: int = 32_000_000) -> MultiIndex | None:
    one = rows.select(F.size("v").alias("d")).first()
    if one is None:
        return None
    most = max(1, min(sample, sample_bytes // (8 * one["d"])))
    _, points = packed(hash_sample(rows, "vec_id", most))
    cut = (points.shape[1] + 1) // 2
    right = points[:, cut:] if points.shape[1] > 1 else np.zeros((len(points), 0))
    return MultiIndex(codebook(points[:, :cut], k), codebook(right, k) if right.shape[1] else np.zeros((1, 0)))


def best_of(asked: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, place among these vectors, score) of the k best for each query, exactly, without the query's own row."""
    out_q, out_at, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for at in range(0, len(queries), step):
        some = queries[at : at + step]
        rough = some @ vectors.T
        rough[asked[at : at + step, None] == rows[None, :]] = -np.inf
        for r, (own, q) in enumerate(zip(asked[at : at + step], some)):
            row = rough[r]
            if len(row) > k:
                least = np.partition(row, len(row) - k)[len(row) - k]
                near = np.flatnonzero(row >= least - 1e-9 * (1 + abs(least)))
            else:
                near = np.flatnonzero(row > -np.inf)
            near = near[row[near] > -np.inf]
            # each sum is taken row by row, so that equal vectors have equal scores
            exact = (vectors[near] * q).sum(axis=1)
            order = np.lexsort((ids[near], -exact))[:k]
            out_q.append(np.full(len(order), own))
            out_at.append(near[order])
            out_s.append(exact[order])
    return np.concatenate(out_q), np.concatenate(out_at), np.concatenate(out_s)


def true_cells(indexed: DataFrame, asked: np.ndarray, probes: np.ndarray, k: int) -> pd.DataFrame:
    """query (row), cell of the k best of every probe over all vectors; a task keeps only what is best so far."""
    shared = indexed.sparkSession.sparkContext.broadcast((asked, probes))

    def run(batches):
        asked, probes = shared.value
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = batch["row"].to_numpy(), batch["vec_id"].to_numpy(), batch["cell"].to_numpy(), matrix(batch)
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            query, at, score = best_of(asked, probes, held[0], held[1], held[3], k)
            best, place = np.unique(at, return_inverse=True)
            held = tuple(x[best] for x in held)
            at = place
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_pydict({"query": pa.array(query, pa.int64()), "vec_id": pa.array(held[1][at], pa.int64()), "score": pa.array(score, pa.float64()), "cell": pa.array(held[2][at], pa.int32())})

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = indexed.mapInArrow(run, "query long, vec_id long, score double, cell int")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("query", "cell").toPandas()  # at most k a probe


def entries_needed(index: MultiIndex, sizes: dict[int, int], asked: np.ndarray, probes: np.ndarray, truth: pd.DataFrame, recall: float) -> int:
    """The least number of entries at which the probes' mean recall, less two standard errors, is `recall`; all if there is none."""
    total, needed = sum(sizes.values()), []
    own = truth.groupby("query")["cell"].apply(list).to_dict()
    for q, x in zip(asked.tolist(), probes):
        if q in own:
            cells = index.order(x, sizes)
            # a cell is visited while fewer than enough entries are held before it
            before = dict(zip(cells, np.cumsum([1] + [sizes[c] for c in cells]).tolist()))
            needed.append(np.sort([before[c] for c in own[q]]))
    for enough in sorted({n for x in needed for n in x.tolist()}):
        met = np.array([np.searchsorted(x, enough, "right") / len(x) for x in needed])
        if met.mean() - 2 * met.std() / len(met) ** 0.5 >= recall:
            return int(enough)
    return total


def search(vectors: DataFrame, is_query, k: int = 20, centroids: int | None = None, enough: int | None = None, block: int = 4096, sample: int = 20_000, recall: float = 0.95, probes: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score, path: the k nearest found of every row for which is_query holds; path says whether by cells or by every vector.

    `centroids` a half: by default about sqrt(rows / 32), from 4 to 256. `enough`: by default as measured for
    `recall`; with `recall=1` every vector is read and the result is exact.
    """
    spark = vectors.sparkSession
    # a row's number is fixed once the rows are written
    rows = stored(stored(usable(vectors)).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double, path string"
    index = fit(rows, centroids or int(min(256, max(4, (total / 32) ** 0.5))), sample) if total else None
    if index is None:
        return spark.createDataFrame([], schema)
    book = spark.sparkContext.broadcast(index)

    def make_cells():
        return lambda batch: {"row": batch["row"], "vec_id": batch["vec_id"], "v": batch["v"], "cell": book.value.cells(matrix(batch))}

    asked = rows.filter(is_query(F.col("vec_id")))
    indexed, sizes = rows.withColumn("cell", F.lit(0)), {0: total}
    if recall >= 1 and enough is None:
        enough = total
    else:
        # cells are written only if the index is used
        indexed = per_batch(rows, "row long, vec_id long, v array<double>, cell int", make_cells)
        sizes = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}  # k * k numbers at most
    if enough is None:
        some = hash_sample(asked, "vec_id", probes)
        if some.isEmpty():
            return spark.createDataFrame([], schema)
        numbers, points = packed(some)
        enough = entries_needed(index, sizes, numbers, points, true_cells(indexed, numbers, points, k), recall)
    if 2 * enough >= total:  # one cell for all
        indexed, sizes, index = rows.withColumn("cell", F.lit(0)), {0: total}, None
        block = min(block, max(256, -(-total // 16)))
    else:
        indexed = stored(indexed)
    path = "every vector" if index is None else "cells"
    held = spark.sparkContext.broadcast(sizes)

    def make_walks():
        def work(batch: pa.RecordBatch) -> dict:
            # one more than asked for: the query's own row is no candidate
            return {"query": batch["row"], "query_id": batch["vec_id"], "q": batch["v"], "cells": [book.value.walk(x, held.value, max(enough, k + 1)) for x in matrix(batch)]}

        return work

    if index is None:
        queries = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.array(F.lit(0)).alias("cells"))
    else:
        queries = per_batch(asked, "query long, query_id long, q array<double>, cells array<int>", make_walks)
    visits = stored(queries.select("query", "query_id", "q", F.explode("cells").alias("cell")))
    visited = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
    # blocks of entries and of queries of each cell
    shape = spark.createDataFrame([(c, -(-n // block), -(-visited[c] // block)) for c, n in sizes.items() if c in visited], "cell int, parts int, groups int") if visited else None
    if shape is None:
        return spark.createDataFrame([], schema)
    shape = F.broadcast(shape)
    left = visits.join(shape, "cell").select("query", "query_id", "q", "cell", F.pmod(F.xxhash64("query"), F.col("groups")).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    right = indexed.join(shape, "cell").select("row", "vec_id", "v", "cell", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"))

    def rerank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}).astype({"query": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids = b["vec_id"].to_numpy()
        query, at, score = best_of(a["query"].to_numpy(), np.stack(a["q"].to_numpy()), b["row"].to_numpy(), ids, np.stack(b["v"].to_numpy()), k)
        name = dict(zip(a["query"].tolist(), a["query_id"].tolist()))
        return pd.DataFrame({"query": query, "query_id": [name[q] for q in query.tolist()], "vec_id": ids[at], "score": score})

    near = left.groupBy("cell", "p", "g").cogroup(right.groupBy("cell", "p", "g")).applyInPandas(rerank, "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.lit(path).alias("path"))
