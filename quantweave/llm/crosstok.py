"""Operator 11: two tokenizers' tokens of the same text, aligned by their bytes.

A is a byte-level BPE of the tokenizers library over a space and the text, B a sentencepiece model, which adds the
space itself. Both cover the same bytes, so a batch of documents is one long sequence of A's and of B's tokens.
coalesce() orders all of them by start (lexsort), takes the running maximum of ends (maximum.accumulate), and begins a
group where a start reaches that maximum: there both sides' tokens end. links() expands, within the groups,
each A token to the B tokens that it overlaps.

How often a pair of ids is linked is counted over the whole corpus: documents keep their different pairs, tasks
add those up before the shuffle, and each document's pairs are then looked up. The most frequent pairs (`most`
at the utmost: 24 bytes each) are broadcast and looked up where documents lie; the others, none of which is frequent, are
joined by shuffle. Both ways together give every pair. Whether a pair's count is its B id's highest is told by a table of one
row a B id, bounded by B's vocabulary.

Defined cases: a document whose text is null or empty, or whose tokens' bytes aren't the space and the text (a text that
has U+2581 itself) has no tokens: its numbers are 0 and its groups ''; it links nothing. Special tokens' strings are plain text.
Repeated rows count as often as they are there; ids and texts may be null; empty tables give no rows; of other columns none is
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path
from .encoders import UNSURE, Ids, Known, byte_level, expand, pieces, sentence_pieces

#: A pair of ids is one number: A's id in the bits above these, B's below.
BITS = 20


def coalesce(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token, from the ends of both sides' tokens (none empty) over the same bytes."""
    ends = np.concatenate([a_ends, b_ends])
    start = np.concatenate([[0], a_ends[:-1], [0], b_ends[:-1]]) if len(a_ends) and len(b_ends) else np.zeros(0, np.int64)
    side = np.repeat(np.array([0, 1], np.int8), [len(a_ends), len(b_ends)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(ends[order])
    begins = np.ones(len(order), bool)
    begins[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(begins) - 1
    return group[: len(a_ends)], group[len(a_ends) :]


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the A token, place of the B token) of all overlaps: each A token's are a run of B tokens of its group."""
    a_starts, b_starts = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
    low, high = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")
    n = high - low
    a = np.repeat(np.arange(len(n)), n)
    return a, np.arange(len(a)) + np.repeat(low - (np.cumsum(n) - n), n)


class Aligner:
    """What a worker process needs: both encoders, lengths of tokens, and their decimal ids with each separator."""

    def __init__(self, byte_bpe: str, piece_bpe: str) -> None:
        self.a, self.b = byte_level(byte_bpe), sentence_pieces(piece_bpe)
        self.both = Known(self._learn)
        self.space = np.array([self.b.space], "<u4").tobytes()
        self.a_size, self.b_size = (np.array([len(t) for t in x.bytes_of], np.int64) for x in (self.a, self.b))
        self.most = max(len(self.a_size), len(self.b_size))
        if self.most > 1 << BITS:
            raise ValueError(f"ids beyond {1 << BITS}")
        self.shown = [f"{i}{sep}".encode() for sep in (",", "|", ";", "") for i in range(self.most)]

    def _learn(self, new: list[str]) -> list[bytes]:
        """A's number of ids, A's ids and B's; nothing where the bytes of either aren't the space and the piece."""
        side_a = self.a.learn(new)
        side_b = [b if p else self.space for p, b in zip(new, self.b.learn(new))]
        good = None
        for side, ids in ((self.a, side_a), (self.b, side_b)):
            if self._bytes(side, b"".join(ids)) != "".join([" " + p for p in new]).encode():
                good = good or [True] * len(new)
                good = [g and self._bytes(side, i) == b" " + p.encode() for g, p, i in zip(good, new, ids)]
        out = [(len(a) >> 2).to_bytes(4, "little") + a + b for a, b in zip(side_a, side_b)]
        return [x if g else b"" for x, g in zip(out, good)] if good else out

    @staticmethod
    def _bytes(side, ids: bytes) -> bytes:
        return b"".join(map(side.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def encode(self, texts: pa.Array) -> tuple[Ids, Ids]:
        """A's and B's ids of each text."""
        ends, index, distinct = pieces(texts, "" if self.b.spans else UNSURE)
        flat, size = self.both.ids(distinct)
        begin = np.cumsum(size) - size
        good = size > 0
        head = np.zeros(len(size), np.int64)
        head[good] = flat[begin[good]]
        a_mask = np.zeros(len(flat), np.int8)  # 1: A's, 2: B's
        kind = np.repeat(begin, size)
        place = np.arange(len(flat)) - kind
        a_mask[place > 0] = np.where(place[place > 0] <= np.repeat(head, size)[place > 0], 1, 2)
        a, b = (flat[a_mask == 1], head), (flat[a_mask == 2], np.where(good, size - 1 - head, 0))
        bad = np.add.reduceat((~good)[index], ends[:-1]) > 0 if len(index) else np.zeros(len(texts), bool)
        bad |= np.asarray(pc.equal(texts, ""))
        out = []
        for side in (a, b):
            ids, n = expand(side, index, ends)
            out.append((ids[np.repeat(~bad, n)], np.where(bad, 0, n)))
        return out[0], out[1]

    def work(self, texts: pa.Array) -> dict:
        (a, n_a), (b, n_b) = self.encode(texts)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_group, b_group = coalesce(a_ends, b_ends)
        a_doc, b_doc = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        at_a, at_b = links(a_ends, b_ends)
        # different pairs of each document, with their numbers
        key = np.sort((a_doc << 2 * BITS)[at_a] | (a.astype(np.int64) << BITS)[at_a] | b[at_b])
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times, key = np.diff(np.concatenate([at, [len(key)]])), key[at]
        held = np.concatenate([[0], np.cumsum(np.bincount(key >> 2 * BITS, minlength=len(n_a)))]).astype(np.int32)
        # groups as text: tokens by group, A's first, each with what follows it
        group, side, own = np.concatenate([a_group, b_group]), np.repeat(np.array([0, 1], np.int8), [len(a), len(b)]), np.concatenate([a, b])
        order = np.argsort(2 * group + side, kind="stable")
        group, side, own, of = group[order], side[order], own[order], np.concatenate([a_doc, b_doc])[order]
        after = np.full(len(order), 3)
        if len(order) > 1:
            after[:-1] = np.where(of[1:] != of[:-1], 3, np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0)))
        shown = list(map(self.shown.__getitem__, (after * self.most + own).tolist()))
        bounds = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        first = np.concatenate([[True], of[1:] != of[:-1]]) | np.concatenate([[True], group[1:] != group[:-1]]) if len(order) else np.zeros(0, bool)
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": np.bincount(of[first], minlength=len(n_a)),
            "n_links": np.bincount(a_doc[at_a], minlength=len(n_a)),
            "groups_sha256": [hashlib.sha256(b"".join(shown[i:j])).hexdigest() if j > i else "" for i, j in zip(bounds, bounds[1:])],
            "pairs": pa.ListArray.from_arrays(pa.array(held), pa.array(key & ((1 << 2 * BITS) - 1))),
            "times": pa.ListArray.from_arrays(pa.array(held), pa.array(times.astype(np.int32))),
        }


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    """One a worker process."""
    key = byte_bpe, piece_bpe
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _batches(rows: DataFrame, schema: str, make, per: int) -> DataFrame:
    """mapInArrow in steps of `per` rows: make() gives a function from a batch to a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, per):
                out = work(batch.slice(at, per))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in target], schema=target)

    return rows.mapInArrow(run, schema)


def align(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """Each document's numbers of tokens, groups and links, its groups' hash, and its different pairs with their numbers."""

    def make():
        own = aligner(byte_bpe, piece_bpe)
        return lambda batch: {"row": batch["row"], "doc_id": batch["doc_id"]} | own.work(pa.array(batch["text"]).fill_null(""))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _batches(rows, ALIGNED, make, 1000)


def summed(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    return pair[at], np.add.reduceat(n[order], at) if len(at) else np.zeros(0, np.int64)


def counts(aligned: DataFrame, held: int = 1 << 21) -> DataFrame:
    """pair, n (links of the corpus that hold it), best (no pair of its B id has more). Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            pair = np.concatenate([pair, np.asarray(batch["pairs"].flatten(), np.int64)])
            n = np.concatenate([n, np.asarray(batch["times"].flatten(), np.int64)])
            pair, n = summed(pair, n)
            if len(pair) > held:
                yield pa.RecordBatch.from_pydict({"pair": pair, "n": n})
                pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_pydict({"pair": pair, "n": n})

    total = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    path = new_path(aligned.sparkSession, "pairs")
    total.write.parquet(path)
    total = aligned.sparkSession.read.parquet(path).withColumn("b", F.col("pair") % (1 << BITS))
    top = total.groupBy("b").agg(F.max("n").alias("top"))
    return total.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))  # one row an id of B


def frequent(counted: DataFrame, most: int) -> int:
    """The least n for which no more than `most` pairs have n or more, to a sixteenth of a power of two."""
    level = F.floor(F.log2("n") * 16).cast("int")
    held, least = 0, None
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # 1,024 levels at most
        held += r["count"]
        if held > most:
            break
        least = r["level"]
    return (1 << 62) if least is None else int(np.ceil(2 ** (least / 16) - 1e-9))


def compare(docs: DataFrame, byte_bpe: str, piece_bpe: str, most: int = 1 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    spark = docs.sparkSession
    path = new_path(spark, "aligned")
    align(docs, byte_bpe, piece_bpe).write.option("compression", "zstd").parquet(path)
    aligned = spark.read.parquet(path)
    counts_path = new_path(spark, "counts")
    counts(aligned).write.parquet(counts_path)
    counted = spark.read.parquet(counts_path)
    least = frequent(counted, most)
    hot = counted.filter(F.col("n") >= least).toArrow()  # `most` rows at the utmost
    keys, n, best = hot["pair"].to_numpy(), hot["n"].to_numpy(), hot["best"].to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], n[order], best[order]))

    def make():
        keys, number, best = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            pair, times = np.asarray(batch["pairs"].flatten(), np.int64), np.asarray(batch["times"].flatten(), np.int64)
            size = np.asarray(pc.list_value_length(batch["pairs"]), np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            found = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)

            def total(x: np.ndarray) -> np.ndarray:
                upto = np.concatenate([[0], np.cumsum(x)])
                ends = np.concatenate([[0], np.cumsum(size)])
                return upto[ends[1:]] - upto[ends[:-1]]

            value = times * np.where(found, number[at], 0) if len(keys) else np.zeros(len(pair), np.int64)
            is_best = times * (found & best[at]) if len(keys) else np.zeros(len(pair), np.int64)
            rest = np.concatenate([[0], np.cumsum(np.bincount(doc[~found], minlength=len(size)))]).astype(np.int32)
            cold = {"cold": pair[~found], "cold_times": times[~found].astype(np.int32)}
            out = {c: batch[c] for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            return out | {"n_best": total(is_best), "count_sum": total(value)} | {c: pa.ListArray.from_arrays(pa.array(rest), pa.array(x)) for c, x in cold.items()}

        return work

    looked_path = new_path(spark, "looked")
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, cold array<long>, cold_times array<int>"
    _batches(aligned, schema, make, 1000).write.option("compression", "zstd").parquet(looked_path)
    looked = spark.read.parquet(looked_path)
    cold = looked.select("row", F.explode(F.arrays_zip("cold", "cold_times")).alias("c")).select("row", F.col("c.cold").alias("pair"), F.col("c.cold_times").alias("times"))
    rest = cold.join(counted.filter(F.col("n") < least), "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best")
    )
    add = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    return looked.drop("cold", "cold_times").join(rest, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", add("n_best", "_best"), add("count_sum", "_sum"), "groups_sha256")
