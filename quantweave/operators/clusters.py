"""Groups of alike rows, and the rules that describe them."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored


#: Rows of a part: fits are some two hundred rounds, and each sends a result from every part to the driver.
PART = 100_000


def auto_cluster(rows: DataFrame, features: list[str], most: int, seed: int = 7) -> DataFrame:
    """rows with a cluster: standardised features, k-means, the k from 2 to `most` of best silhouette."""
    raw = VectorAssembler(inputCols=features, outputCol="_raw").transform(rows.na.drop(subset=features)).persist()
    v = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(raw).transform(raw).coalesce(raw.count() // PART + 1).persist()
    best = None
    try:
        v.count()
        raw.unpersist()
        for k in range(2, most + 1):
            model = KMeans(k=k, featuresCol="_x", predictionCol="cluster", seed=seed).fit(v)
            s = ClusteringEvaluator(featuresCol="_x", predictionCol="cluster").evaluate(model.transform(v))
            if best is None or s > best[0]:
                best = (s, model)
        return stored(best[1].transform(v).drop("_raw", "_x"))
    finally:
        v.unpersist()
        raw.unpersist()


def rules(rows: DataFrame, features: list[str]) -> DataFrame:
    """cluster, support, coverage and each feature's 10% to 90% range."""
    q = lambda f, p: F.percentile(f, F.lit(p))
    total = rows.count()
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("support"), (F.count(F.lit(1)) / F.lit(total)).alias("coverage"), *[q(f, p).alias(f"{f}_{n}") for f in features for p, n in ((0.1, "lo"), (0.9, "hi"))])
