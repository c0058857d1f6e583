"""Clusters are fitted with as many tasks as rows need, whatever their partitions."""

from __future__ import annotations

from quantweave.operators import clusters


def test_fits_of_few_rows_take_few_tasks(spark):
    rows = spark.range(0, 240, 1, 48).selectExpr("id", "id % 3 * 10 + id % 7 * 0.01 as x", "id % 3 * 5 + id % 5 * 0.01 as y")
    sc = spark.sparkContext
    sc.setJobGroup("clusters", "clusters")
    try:
        found = clusters.auto_cluster(rows, ["x", "y"], 4)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert found.groupBy("cluster").count().filter("count = 80").count() == 3
    seen = sc.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("clusters") for s in seen.getJobInfo(j).stageIds}
    tasks = sum(i.numTasks for s in stages if (i := seen.getStageInfo(s)))
    assert len(stages) > 20 and tasks < 10 * len(stages)
