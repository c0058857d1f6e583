"""Operator 13: token ids of documents in ORC files, in order of their ids, with row indexes and Bloom filters.

write() deals documents by ranges of their ids, encodes them where they lie in order, and writes one ORC file a range.
A file's rows are part (the file's number, in order), offset (ids of the file before this document), doc_id, n_tokens
and ids. Integers are run-length encoded by ORC; each thousand rows have an index entry (least and largest doc_id) and
a Bloom filter on doc_id. A stripe is read by one task, so a large file is read by several.

directory() has one row a file: its first and last doc_id, its documents and ids, and how many ids lie before it. That
is all that places of tokens in the whole corpus need, so nothing is sorted or counted again on reading. find()
reads the documents of some ids: ORC skips files, stripes and groups of rows by indexes and filters. tokens()
reads a stretch of the corpus: only files that hold a part of it are read, and of ids no other column's pages.

Defined cases: a null text is the empty text, so it has the end id alone; documents without an id come first; documents
that share an id lie by a hash of their texts, copies in any order (they may lie in several files, so a hot id doesn't
make a large one); an empty table gives an empty directory; of other columns none is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path
from .encoders import word_ends

SCHEMA = "part int, offset long, doc_id long, n_tokens int, ids array<int>"
#: Rows between entries of the row index, and with them between Bloom filters.
STRIDE = 1000


def id_lists(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.field("element", pa.int32())))


def encoded(rows: DataFrame, tokenizer: str, end: int | None, per: int = 1000) -> DataFrame:
    """Ids of rows (doc_id, text) in their order, with `end` after each document's; parts are numbered by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, offset = word_ends(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, per):
                some = batch.slice(at, per)
                ids, n = encoder.encode(pa.array(some["text"]).fill_null(""))
                if end is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end), n + 1
                before = offset + np.cumsum(n) - n
                offset += int(n.sum())
                lists = [pa.array(np.full(len(n), part, np.int32)), pa.array(before.astype(np.int64)), some["doc_id"], pa.array(n.astype(np.int32)), id_lists(ids, n)]
                yield pa.RecordBatch.from_arrays(lists, ["part", "offset", "doc_id", "n_tokens", "ids"])

    return rows.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end: int | None = 1, stripe_bytes: int = 32 << 20) -> None:
    """ORC files of the documents' ids at `path`, in ascending order of doc_id over file numbers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"_text": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = ["doc_id", "_text", "_row"]  # the row's number parts even copies, so that no range is larger than others
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = encoded(ranged, tokenizer, end).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    out.option("orc.create.index", "true").option("orc.row.index.stride", str(STRIDE)).option("orc.stripe.size", str(stripe_bytes)).option("compression", "zstd").orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: part, first, last (doc_id), n_docs, n_tokens, start (ids of all files before)."""
    files = read(spark, path).groupBy("part").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
    )
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a file


def placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of the files with start, the ids of all documents before each."""
    starts = F.broadcast(files.select("part", F.col("start").alias("_before")))  # one row a file
    return rows.join(starts, "part").withColumn("start", F.col("_before") + F.col("offset")).drop("_before")


def find(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents."""
    return read(spark, path).filter(F.col("doc_id").isin([int(i) for i in doc_ids]))


def tokens(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """doc_id, at (place in the corpus), ids: the ids from `start` to before `stop`, a row a document that has some."""
    files = directory(spark, path).filter((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    first, last = files.agg(F.min("part"), F.max("part")).first()
    rows = read(spark, path).filter(F.lit(False) if first is None else F.col("part").between(first, last))  # pruned by the files' metadata
    near = placed(rows, files).filter((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    skip = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    n = F.least(F.col("start") + F.col("n_tokens"), F.lit(stop)) - F.col("start") - skip
    return near.select("doc_id", (F.col("start") + skip).alias("at"), F.slice("ids", (skip + 1).cast("int"), n.cast("int")).alias("ids"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            raw, ends = memoryview(np.ascontiguousarray(lists.values, "<i4")).cast("B"), (np.asarray(lists.offsets, np.int64) * 4).tolist()
            crc = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["part"], batch["offset"], batch["doc_id"], batch["n_tokens"], crc], ["part", "offset", "doc_id", "n_tokens", "ids_crc32"])

    rows = read(spark, path).mapInArrow(run, "part int, offset long, doc_id long, n_tokens int, ids_crc32 long")
    return placed(rows, directory(spark, path)).select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end: int | None = 1) -> DataFrame:
    """Write the documents' ids in the shared folder and read their digest back."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end)
    return digest(docs.sparkSession, path)
