"""The inverted index beside plain BM25, its pruning, and batches."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from quantweave.operators import textindex


def plain(texts, terms):
    docs = {k: re.findall("[a-z]+", (t or "").lower()) for k, t in texts.items()}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for t in set(terms):
        df = sum(t in d for d in docs.values())
        for k, d in docs.items():
            if tf := Counter(d)[t]:
                out[k] = out.get(k, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / mean))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(0)
    out = {i: " ".join(f"w{'abcdefghij'[x % 10]}{'xyz'[x % 3]}" for x in rng.zipf(1.5, int(rng.integers(1, 60))) % 30) for i in range(900)}
    return out | {900: None, 901: "", 902: "Wax! waX, WAX the-wax"}


def test_scores_and_best_of_batches(spark, tmp_path, texts):
    path, rows = str(tmp_path / "index"), list(texts.items())
    schema = "id long, text string"
    textindex.add(spark.createDataFrame(rows[:500], schema).repartition(3), path, ["id"], "a", block=50)
    textindex.add(spark.createDataFrame(rows[500:] + rows[:1], schema), path, ["id"], "b", block=50)
    textindex.add(spark.createDataFrame(rows[500:], schema), path, ["id"], "b", block=50)  # replaces the batch
    textindex.add(spark.createDataFrame([], schema), path, ["id"], "empty")
    assert textindex.has_batch(spark, path, "a") and not textindex.has_batch(spark, path, "c")
    assert textindex.totals(spark, path)[0] == len(texts)
    for terms in (["wax"], ["wbx", "wcy", "wbx", "nowhere"], ["wax", "wby", "wdz", "the"]):
        want = plain(texts, terms)
        got = {r.id: r.score for r in textindex.scores(spark, path, terms).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
        for k in (1, 7, 2000):
            best = [(r.id, r.score) for r in textindex.search(spark, path, terms, k).collect()]
            order = sorted(want, key=lambda i: (-round(want[i], 9), i))[:k]
            assert [i for i, _ in best] == order and all(s == pytest.approx(want[i]) for i, s in best)
    assert textindex.search(spark, path, ["nowhere"], 5).count() == 0 and textindex.search(spark, path, [], 5).count() == 0


def test_only_the_terms_buckets_and_the_best_blocks_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    # a block whose documents are short and full of the term, and many where it is rare
    rows = [(i, "gold gold gold" if i < 40 else "gold " + "dust " * 50) for i in range(2000)]
    textindex.add(spark.createDataFrame(rows, "id long, text string").coalesce(1), path, ["id"], "a", block=100)
    found = textindex.postings(spark, path, ["gold"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*term", plan)
    assert {r[0] for r in found.selectExpr("_metadata.file_path").distinct().collect()} and all("bucket=" in r[0] for r in found.selectExpr("_metadata.file_path").collect())
    n, mean = textindex.totals(spark, path)
    limits = sorted((r.bound for r in textindex.bounds(found, textindex.idfs(found, n), mean).collect()), reverse=True)
    best = textindex.search(spark, path, ["gold"], 5)
    fifth = sorted((r.score for r in best.collect()), reverse=True)[4]
    assert [r.id for r in best.collect()] == [0, 1, 2, 3, 4] and sum(b >= fifth - 1e-6 for b in limits) == 1 < len(limits)


def test_keys_of_several_columns_and_clashing_names(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [("a", 1, "one two", 5), ("a", 2, "two two", 6), (None, 1, "two", 7), ("b", 1, None, 8)]
    textindex.add(spark.createDataFrame(rows, "conv string, turn int, body string, length int"), path, ["conv", "turn"], "x", text="body")
    got = {(r.conv, r.turn): r.score for r in textindex.scores(spark, path, ["two"]).collect()}
    assert set(got) == {("a", 1), ("a", 2), (None, 1)} and got["a", 2] > got["a", 1]
