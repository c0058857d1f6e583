"""An index is made with one shuffle, of finished lists, and its listing holds no words."""

from __future__ import annotations

from quantweave.operators import textindex


def test_lists_are_shuffled_once(spark, tmp_path):
    path, sc = str(tmp_path / "index"), spark.sparkContext
    docs = spark.range(0, 300, 1, 3).selectExpr("id", "concat('gold dust ', repeat('gold ', cast(id % 4 as int))) as text")
    sc.setJobGroup("index", "index")
    try:
        textindex.add(docs, path, ["id"], "a", block=50)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    seen = sc.statusTracker()
    ran = {s for j in seen.getJobIdsForGroup("index") for s in seen.getJobInfo(j).stageIds if (i := seen.getStageInfo(s)) and i.numCompletedTasks}
    assert len(ran) == 3  # the listing; the lists; their files
    assert set(spark.read.parquet(f"{path}/documents").columns) == {"doc", "length", "batch"}
    rows = textindex.postings(spark, path, ["gold"]).collect()
    assert [r.n for r in rows] == [50] * 6 and all(r.most == 4 and r.shortest == 2 for r in rows)
