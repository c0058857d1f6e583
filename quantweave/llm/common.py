"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, once A-Z are lower-cased: a run of digits, a-z and any character beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text. Lower-casing bytes touches A-Z alone; null has no words."""
    return WORD.findall(text.lower()) if text else []


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(id as text) mod 3 is 1. A null id is never learned from, so it is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column: Python gets them without decoding."""
    return F.col(name).cast("string").cast("binary")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where that is unset (one machine, tests) a temporary folder is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if not folder and not current and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not folder:
        folder = current or tempfile.mkdtemp(prefix="checkpoints-")
    if not current:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_name(name: str, taken: Iterable[str]) -> str:
    """A name like this one that none of `taken` is, whatever the case: Spark's column names are the same in any case."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: written to the shared folder once and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def per_batch(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """mapInArrow for row-wise work: make() builds a function from a batch to a dict of columns, once a task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if not batch.num_rows:
                continue
            work = work or make()
            out = work(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name] for f in target], schema=target)

    return df.mapInArrow(run, schema)


class Memo(dict):
    """A dict that fills itself by a function and starts anew beyond a size: bounded memory, same results."""

    def __init__(self, function: Callable, limit: int) -> None:
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.function(key)
        return value


def id_hash(key: str) -> Column:
    """A number from 0 to 2^31 - 1 by which samples are ordered, whatever the partitions."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 31))


def hash_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` rows of least id_hash. Rows that can't be among them are left out where they lie, so that what
    tasks send for the final order doesn't grow with their number."""
    n = rows.count()
    order = [id_hash(key), F.col(key)]
    if n > 2 * most:
        few = rows.filter(id_hash(key) < int((1 << 31) * min(1.0, (1.2 * most + 200) / n)))
        if few.count() >= most:
            return few.orderBy(*order).limit(most)
    return rows.orderBy(*order).limit(most)
