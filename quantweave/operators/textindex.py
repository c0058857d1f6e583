"""A stored inverted index of texts, added to in batches, and BM25 over it.

An index is a folder: `postings` (batch, bucket, term, block, n, most, shortest, docs: a row a term and block of documents) and
`documents` (batch, doc, length). Both are Parquet, parted by batch, postings also by the bucket of the term's
hash and sorted by term within; so a query reads the folders of its terms' buckets, and of those only row groups
that can hold the terms. A batch that is added again replaces itself.

A block is some thousand documents that lay side by side. With each of its terms it keeps the highest frequency and the shortest
length, which bound what the term can add to a score there, whatever the idf and the mean length have become since. The best k are
found in two steps: the blocks of highest bounds give a score that k documents reach, and only blocks whose bound is as
high are read after that. Bounds are read without the lists.

Defined cases: null texts have no words and are documents of length 0; a word is a run of a to z of the lower-cased text;
repeated query terms count once; terms that no document has add nothing; keys may be null; an empty batch adds
nothing. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

BUCKETS, BLOCK = 64, 1024
K1, B = 1.5, 0.75


def words(text: str | Column) -> Column:
    """The words of a text: runs of a to z, lower-cased."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), lambda w: w != "")


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _lists(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Of rows (doc, words) that lie side by side, each block's lists: a row a term, terms in any order."""
    at = TaskContext.get().partitionId() << 33
    for batch in batches:
        for start in range(0, batch.num_rows, block):
            some = batch.slice(start, block)
            keys, words = some["doc"], some["words"]
            length = np.asarray(pc.list_value_length(words), np.int64)
            coded = words.flatten().dictionary_encode()
            # a pair of a term and a document is one number; they come ordered by term, then document
            pairs, tf = np.unique(np.asarray(coded.indices, np.int64) * len(length) + np.repeat(np.arange(len(length)), length), return_counts=True)
            term, doc = np.divmod(pairs, len(length))
            first = np.flatnonzero(np.diff(term, prepend=-1))
            n, size = np.diff(np.append(first, len(term))), length[doc]
            if len(first):
                tfs = tf.astype(np.int32)
                entries = pa.StructArray.from_arrays([keys.take(pa.array(doc)), pa.array(tfs), pa.array(size.astype(np.int32))], ["doc", "tf", "length"])
                docs = pa.ListArray.from_arrays(pa.array(np.append(first, len(term)).astype(np.int32)), entries)
                columns = [coded.dictionary.take(pa.array(term[first])), pa.array(np.full(len(first), at)), pa.array(n.astype(np.int32)), pa.array(np.maximum.reduceat(tfs, first)), pa.array(np.minimum.reduceat(size, first).astype(np.int32)), docs]
                yield pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "most", "shortest", "docs"])
            at += 1


def add(docs: DataFrame, path: str, keys: list[str], batch: str, text: str = "text", block: int = BLOCK, buckets: int = BUCKETS) -> None:
    """Index a batch of documents.

    A block's lists are made in the task where its documents lie; what is shuffled, once, are finished lists.
    """
    rows = docs.select(F.struct(*keys).alias("doc"), words(text).alias("words"))
    rows.select("doc", F.size("words").alias("length")).write.mode("overwrite").parquet(f"{path}/documents/batch={batch}")
    entry = StructType().add("doc", rows.schema["doc"].dataType).add("tf", "integer").add("length", "integer")
    schema = StructType().add("term", "string").add("block", "long").add("n", "integer").add("most", "integer").add("shortest", "integer").add("docs", ArrayType(entry))
    lists = rows.mapInArrow(lambda batches: _lists(batches, block), schema)
    # a bucket may hold most lists, so a large one is several tasks' and files'
    out = lists.withColumn("bucket", bucket_of(F.col("term"), buckets)).hint("rebalance", "bucket")
    out.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")


def postings(spark: SparkSession, path: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The lists of some terms; only their buckets are listed and read."""
    wanted = sorted(set(terms))
    if not wanted:
        return spark.read.parquet(f"{path}/postings").limit(0)
    rows = spark.createDataFrame([(t,) for t in wanted], "t string").select(bucket_of(F.col("t"), buckets).alias("b")).distinct().collect()  # as many as terms
    return spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin([r["b"] for r in rows]) & F.col("term").isin(wanted))


def totals(spark: SparkSession, path: str) -> tuple[int, float]:
    """Number of documents and their mean length, from the listing's lengths alone."""
    row = spark.read.parquet(f"{path}/documents").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    return row["n"], float(row["mean"] or 0.0)


def weight(tf: Column, length: Column, mean: float) -> Column:
    """What a term adds to a score, but for its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-300)))


def idfs(found: DataFrame, n: int) -> DataFrame:
    """term, idf: a row a query term."""
    df = found.groupBy("term").agg(F.sum("n").alias("df"))
    return df.select("term", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def _scored(found: DataFrame, idf: DataFrame, mean: float) -> DataFrame:
    each = found.join(F.broadcast(idf), "term").select("batch", "block", "idf", F.explode("docs").alias("d"))
    # a document lies in one block, so its place tells it apart from another one with the same key only by that
    return each.groupBy("d.doc", "d.length", "batch", "block").agg(F.sum(F.col("idf") * weight(F.col("d.tf"), F.col("d.length"), mean)).alias("score"))


def scores(spark: SparkSession, path: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The key columns and score of every document with one of the terms."""
    found = postings(spark, path, terms, buckets)
    n, mean = totals(spark, path)
    return _scored(found, idfs(found, n), mean).select("doc.*", "score")


def bounds(found: DataFrame, idf: DataFrame, mean: float) -> DataFrame:
    """batch, block, bound: no document of the block scores more."""
    top = F.col("idf") * weight(F.col("most"), F.col("shortest"), mean)
    return found.join(F.broadcast(idf), "term").groupBy("batch", "block").agg(F.sum(top).alias("bound"))


def search(spark: SparkSession, path: str, terms: list[str], k: int, buckets: int = BUCKETS, first: int = 4) -> DataFrame:
    """The key columns and score of the k best documents, ties (to nine places) by key."""
    found = postings(spark, path, terms, buckets)
    n, mean = totals(spark, path)
    idf = idfs(found, n)
    limit = bounds(found, idf, mean)
    order = [F.round("score", 9).desc(), F.col("doc")]
    best = [r.asDict() for r in limit.orderBy(F.desc("bound"), "batch", "block").limit(first).collect()]
    reached = 0.0
    if best:
        some = F.lit(False)
        for r in best:
            some = some | ((F.col("batch") == r["batch"]) & (F.col("block") == r["block"]))
        least = _scored(found.filter(some), idf, mean).orderBy(*order).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).first()
        reached = least["s"] if least["n"] == k else 0.0
    good = limit.filter(F.col("bound") >= reached - 1e-6).select("batch", "block")
    return _scored(found.join(good, ["batch", "block"], "left_semi"), idf, mean).orderBy(*order).limit(k).select("doc.*", "score")


def has_batch(spark: SparkSession, path: str, batch: str) -> bool:
    try:
        spark.read.parquet(f"{path}/documents/batch={batch}")
    except AnalysisException:
        return False
    return True
