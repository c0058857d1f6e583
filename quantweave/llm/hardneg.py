"""Operator 12: hard negatives by exact integer inner products, several candidates in one wide integer.

Components become floor(256 * x). With M the largest absolute component and d the length, every component is biased
by M, so that it is not negative; fields of w bits hold any sum of d products below (2M)^2, so `fields`
candidates' components lie side by side in one integer without carries. An anchor's component then multiplies all of
them at once, and the sum over components holds the candidates' biased scores in its fields: they are shifted out
and the bias, known from sums of components, is taken off. As long as all fields take at most 53 bits the integers
are carried in doubles, which hold them exactly whatever the order of additions; wider ones are Python's integers.

Candidates are packed once, in slabs of at most 16 MB (no fewer than 16, so that small tables are dealt out too); anchors
come in groups of at most 4,096. Each slab meets each group in a task; what leaves it are the best few
of an anchor in a slab. The first round finds positives, the second the negatives below each of them.

Defined cases: rows whose vec_id, label or vector is null, or whose vector holds a null or non-finite component,
take no part; zero and empty vectors do; vectors of unequal length are compared as if the shorter ended in
zeros; rows that share an id are rows of their own, so results may be there twice; an anchor without another row of its label
has no rows; an empty table gives none; of other columns none is read. Scores that may not fit a long are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SLAB_BYTES, SLABS, GROUP = 16 << 20, 16, 4096


@dataclass(frozen=True)
class Fields:
    """How candidates share an integer: bias, bits a field, fields, and whether doubles hold it."""

    length: int
    bias: int

    @property
    def bits(self) -> int:
        return max(1, (self.length * (2 * self.bias) ** 2).bit_length())

    @property
    def plain(self) -> bool:
        return self.bits <= 53

    @property
    def fields(self) -> int:
        return 53 // self.bits if self.plain else 4

    def pack(self, parts: np.ndarray) -> np.ndarray:
        """Integers (rows / fields, length) of components (rows, length)."""
        f = self.fields
        biased = np.zeros((-(-len(parts) // f) * f, self.length), np.float64 if self.plain else object)
        biased[: len(parts)] = parts if self.plain else parts.astype(object)
        biased[: len(parts)] += self.bias
        packed = biased[0::f].copy()
        for i in range(1, f):
            packed = packed + biased[i::f] * (1 << (self.bits * i))
        return packed

    def scores(self, packed: np.ndarray, sums: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products (rows, anchors) of packed candidates, whose sums of components are given."""
        biased = (anchors.astype(np.float64) if self.plain else anchors.astype(object)) + self.bias
        wide = packed @ biased.T
        wide = wide.astype(np.int64) if self.plain else wide
        mask = (1 << self.bits) - 1
        out = np.empty((len(packed) * self.fields, len(anchors)), wide.dtype)
        for i in range(self.fields):
            out[i :: self.fields] = (wide >> (self.bits * i)) & mask
        at = sums.astype(out.dtype)[:, None] + anchors.astype(out.dtype).sum(axis=1)[None, :]
        return (out[: len(sums)] - self.bias * at - self.length * self.bias**2).astype(np.int64)

    def to_bytes(self, packed: np.ndarray) -> bytes:
        return packed.tobytes() if self.plain else b"".join(int(x).to_bytes(self.bits * self.fields // 8 + 1, "little") for x in packed.ravel())

    def from_bytes(self, raw: bytes) -> np.ndarray:
        if self.plain:
            return np.frombuffer(raw, np.float64).reshape(-1, self.length)
        size = self.bits * self.fields // 8 + 1
        return np.array([int.from_bytes(raw[i : i + size], "little") for i in range(0, len(raw), size)], object).reshape(-1, self.length)


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """row, vec_id, label, v (floor(256 * x) as doubles, all of one length) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and v is not null").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = stored(rows)
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    zeros = F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v"))
    rows = rows.withColumn("v", F.when(F.size("v") < longest, F.concat("v", zeros)).otherwise(F.col("v")))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v"))


def parts_of(pdf: pd.DataFrame, length: int) -> np.ndarray:
    v = np.concatenate([np.zeros(0), *pdf["v"]]).reshape(len(pdf), length)
    return np.floor(256 * v).astype(np.int64)


def _slabs(rows: DataFrame, fields: Fields, total: int, slab_bytes: int) -> DataFrame:
    """s, rows, ids, labels, sums, packed: one row a slab of candidates."""
    n = max(SLABS, -(-total * 8 * max(1, fields.length) // slab_bytes))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = parts_of(pdf, fields.length)
        columns = {"rows": pdf["row"], "ids": pdf["vec_id"], "labels": pdf["label"], "sums": parts.sum(axis=1)}
        out = {k: [np.asarray(x, np.int64).tobytes()] for k, x in columns.items()}
        return pd.DataFrame({"s": pdf["s"].iloc[:1].tolist()} | out | {"packed": [fields.to_bytes(fields.pack(parts))]})

    keyed = rows.withColumn("s", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
    return stored(keyed.groupBy("s").applyInPandas(pack, "s int, rows binary, ids binary, labels binary, sums binary, packed binary"))


def _groups(anchors: DataFrame, fields: Fields, n: int, group: int) -> DataFrame:
    """g, anchors (row, label), parts, and the scores of each anchor's positives (lists): one row a group."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.stack([pdf["row"], pdf["label"]], axis=1).astype(np.int64)
        lists = [np.asarray(x, np.int64) for x in pdf["asked"]]
        asked = np.array([(i, p) for i, x in enumerate(lists) for p in x], np.int64)
        return pd.DataFrame({"g": pdf["g"].iloc[:1].tolist(), "anchors": [held.tobytes()], "parts": [parts_of(pdf, fields.length).tobytes()], "asked": [asked.tobytes()]})

    keyed = anchors.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(-(-n // group))).cast("int"))
    return stored(keyed.groupBy("g").applyInPandas(pack, "g int, anchors binary, parts binary, asked binary"))


def meet(slabs: DataFrame, groups: DataFrame, fields: Fields, pick: Callable, schema: str, step: int = 64) -> DataFrame:
    """Every slab with every group: pick(labels, ids, rows) gives a function from (anchor's row, label, scores, asked) to columns."""
    g, s = groups.count(), slabs.count()
    names = schema.replace(" long", "").split(", ")
    # as many partitions as there are tasks' worth of work, so that small blocks aren't gathered
    left = slabs.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(max(r[0] for r in groups.select("g").collect()))))).repartition(min(2 * g * s, 20_000), "g", "s")
    right = groups.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(max(r[0] for r in slabs.select("s").collect()))))).repartition(min(2 * g * s, 20_000), "g", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch[c][k].as_py() for c in batch.schema.names}
                rows, ids, labels, sums = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "labels", "sums"))
                packed, held = fields.from_bytes(row["packed"]), np.frombuffer(row["anchors"], np.int64).reshape(-1, 2)
                parts, asked = np.frombuffer(row["parts"], np.int64).reshape(len(held), fields.length), np.frombuffer(row["asked"], np.int64).reshape(-1, 2)
                choose, out = pick(labels, ids, rows), []
                for at in range(0, len(held), step):
                    scores = np.ascontiguousarray(fields.scores(packed, sums, parts[at : at + step]).T)
                    for i, score in enumerate(scores, at):
                        out += choose(*held[i].tolist(), score, asked[asked[:, 0] == i, 1])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out]), pa.int64()) for c in range(len(names))], names)

    return left.join(right, ["g", "s"]).drop("g", "s").mapInArrow(run, schema)


def best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id."""
    at = np.arange(len(score))
    if len(at) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((rows[at], ids[at], -score[at]))[:k]]


def mine(vectors: DataFrame, is_anchor: Callable, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, slab_bytes: int = SLAB_BYTES, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its best other rows of the same label; of each, the negatives are the best rows of
    other labels whose score s satisfies low * positive <= 100 * s <= high * positive.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = usable(vectors, label)
    anchors = rows.filter(is_anchor(F.col("vec_id")))
    largest = F.greatest(F.lit(0.0), F.array_max(F.transform("v", lambda x: F.abs(x))))
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(largest).alias("m"), F.count_if(is_anchor(F.col("vec_id"))).alias("anchors")).first()
    if not about["anchors"]:
        return spark.createDataFrame([], schema)
    fields = Fields(max(1, about["d"]), int(np.floor(256 * (about["m"] or 0.0))) + 1)
    if fields.length * fields.bias**2 >= 1 << 62:
        raise ValueError(f"scores of components up to {fields.bias} may not fit a long")
    if about["d"] == 0:
        rows, anchors = (x.withColumn("v", F.array(F.lit(0.0))) for x in (rows, anchors))
    slabs = _slabs(rows, fields, about["n"], slab_bytes)

    def pick_positives(labels, ids, own):
        of: dict[int, np.ndarray] = {}

        def choose(row, label, score, _asked):
            if label not in of:
                of[label] = np.flatnonzero(labels == label)
            at = of[label][own[of[label]] != row]
            at = at[best(score[at], ids[at], own[at], positives)]
            return [(np.full(len(at), row), own[at], ids[at], score[at])] if len(at) else []

        return choose

    def pick_negatives(labels, ids, own):
        of: dict[int, np.ndarray] = {}

        def choose(row, label, score, asked):
            if label not in of:
                of[label] = np.flatnonzero(labels != label)
            at, out = of[label], []
            mine = score[at]
            for p in set(asked.tolist()):
                near = at[(mine >= -((-low * p) // 100)) & (mine <= (high * p) // 100)]
                if len(near):
                    near = near[best(score[near], ids[near], own[near], negatives)]
                    out.append((np.full(len(near), row), np.full(len(near), p), own[near], ids[near], score[near]))
            return out

        return choose

    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    found = meet(slabs, _groups(anchors.withColumn("asked", F.array().cast("array<long>")), fields, about["anchors"], group), fields, pick_positives, "anchor long, positive long, positive_id long, positive_score long")
    found = stored(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives))
    asked = anchors.join(found.groupBy(F.col("anchor").alias("row")).agg(F.collect_list("positive_score").alias("asked")), "row")  # `positives` at most
    asking = asked.count()
    if not asking:
        return spark.createDataFrame([], schema)
    below = meet(slabs, _groups(asked, fields, asking, group), fields, pick_negatives, "anchor long, positive_score long, negative long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), "negative_id", "negative")
    below = below.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(below, ["anchor", "positive_score"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
