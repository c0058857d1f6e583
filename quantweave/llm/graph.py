"""Joins that hold for hot keys, and connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, new_path, stored


def look_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", size: str | None = None) -> DataFrame:
    """rows joined with table (one row a key) on a key of which any value may hold most rows.

    Keys with more than 1 / (4 * partitions) of the rows are fewer than 4 * partitions: their rows of the table are
    broadcast, and rows that have them stay where they lie. The others are shuffled as usual; rows without a key aren't.
    `size` names a column of the table with the number of rows of each key, where that is known. Both inputs are
    read twice or more: they should be stored.
    """
    counts = table.select(key, F.col(size).alias("_n")) if size else stored(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = [r[0] for r in counts.filter(F.col("_n") > max(1, total // (4 * parts))).select(key).collect()]
    extra = [c for c in table.columns if c != key]
    have = rows.filter(F.col(key).isNotNull())
    if hot:
        is_hot = F.col(key).isin(hot)
        out = have.filter(~is_hot).join(table.filter(~is_hot), key, how).unionByName(have.filter(is_hot).join(F.broadcast(table.filter(is_hot)), key, how))
    else:
        out = have.join(table, key, how)
    if how == "left":
        types = dict(table.dtypes)
        out = out.unionByName(rows.filter(F.col(key).isNull()).withColumns({c: F.lit(None).cast(types[c]) for c in extra}))
    return out


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(id, label) for every end of edges (a long, b long): label is the least id of its component.

    Each round takes the least label of the neighbours, then the label of the label, so that paths shorten by
    half: a path of n takes about log2(n) rounds. A round's labels are a table in the shared folder; the one before
    goes. Joins are made by look_up(), since a hub is the key of most edges and its label that of most nodes.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "labels")
        df.write.parquet(path)
        return spark.read.parquet(path), path

    both = stored(edges.select("a", "b").filter("a <> b").unionByName(edges.selectExpr("b as a", "a as b").filter("a <> b")).distinct())
    degrees = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    labels, path = written(degrees.select(F.col("a").alias("id"), F.least("a", "m").alias("label"), F.col("n")))
    for _ in range(most_rounds):
        near = look_up(both, labels.select(F.col("id").alias("b"), "label", "n"), "b", size="n").groupBy("a").agg(F.min("label").alias("m"))
        low, low_path = written(labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("was"), F.least("label", "m").alias("label"), "n"))
        up = low.select(F.col("id").alias("label"), F.col("label").alias("next"))
        out = look_up(low, up, "label").select("id", F.col("next").alias("label"), "n", (F.col("next") < F.col("was")).alias("changed"))
        old, (labels, new) = path, written(out)
        discard(spark, old, low_path)
        path = new
        if labels.filter("changed").isEmpty():
            return labels.select("id", "label")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
