"""Operator 6: n-gram Jaccard join by MinHash banding.

Documents are sets of word n-grams (a text of fewer words, but not none, is one n-gram of all its words). Two
documents are linked if the Jaccard similarity of their sets is at least the threshold. Band and row counts are
chosen so that a pair at the threshold shares a band with the target probability.

1. One pass over the texts gives each row a set id and its band hashes; equal sets become one node.
2. Nodes are shuffled on band hashes. Nodes that share a bucket are candidates, and no others: a node's home is the
   least node of all its buckets, and the nodes of one home are cut into blocks. A unit of work is a pair of blocks
   that have a bucket in common; it is looked for among blocks, which are fewer than nodes.
3. In each unit all pairs are verified on the full sets by a sparse product. A pair is in one unit only. Only counts
   and a spanning forest leave a unit, so a group is never expanded into rows of pairs, and none needs to fit into
   one task; groups that are chained by chance collisions share few units.
4. Components of the verified links are the classes.

N-grams are 64-bit hashes of their words, and set ids 128-bit hashes of their sorted n-grams: two different sets of
10^10 are taken for one with probability below 1e-18, two n-grams of a pair with about 1e-13.

Defined cases: texts that are null or have no word are linked to nothing, and each is its own class; rows without an
id are judged like others, but give no class its id (null, if none of its rows has one); repeated rows count as
documents of their own; rows that share an id but not a text are judged one by one; an empty table gives no rows; of
other columns none is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, per_batch, stored, text_bytes, words_of
from .graph import components, look_up

MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int


def choose_banding(threshold: float, recall: float, most: int = 256) -> Banding:
    """The most rows a band (fewest false candidates) for which `bands * rows <= most` hashes reach the recall at the threshold."""
    best = None
    for rows in range(1, 33):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows <= most:
            best = Banding(bands, rows)
    if best is None:
        raise ValueError("no banding reaches the recall with so few hashes")
    return best


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that hashes are spread evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a whole text."""
    import xxhash

    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(ids))
    h = np.full(len(ids) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * MIX + ids[i : i + len(h)]
    return np.unique(mixed(h))


class Signer:
    """Band hashes of sets."""

    def __init__(self, banding: Banding, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        k = banding.bands * banding.rows
        self.banding = banding
        self.add = rng.integers(0, 2**64, k, np.uint64)[:, None]
        self.multiply = (rng.integers(0, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]

    def bands(self, grams: np.ndarray, step: int = 2048) -> np.ndarray:
        least = None
        for at in range(0, len(grams), step):
            x = ((grams[None, at : at + step] ^ self.add) * self.multiply).min(axis=1)
            least = x if least is None else np.minimum(least, x)
        rows = mixed(least).reshape(self.banding.bands, self.banding.rows)
        h = np.arange(self.banding.bands, dtype=np.uint64)  # a band's number is part of its key
        for i in range(self.banding.rows):
            h = h * MIX + rows[:, i]
        return mixed(h).view(np.int64)


def text_key() -> Column:
    """A name of a row's text by which it is found again; null if the text is."""
    return F.unhex(F.md5(text_bytes()))


def fingerprints(docs: DataFrame, n: int, banding: Banding) -> DataFrame:
    """row (a number of its own), doc_id, key of its text, set id (null without words), bands array<long>."""

    def make():
        from pyspark import TaskContext

        signer, state = Signer(banding), [TaskContext.get().partitionId() << 33]

        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingle_set(t, n) for t in batch["text"].to_pylist()]
            first, state[0] = state[0], state[0] + batch.num_rows
            return {
                "row": np.arange(first, state[0]),
                "doc_id": batch["doc_id"],
                "key": batch["key"],
                "set_id": [set_id(s) for s in sets],
                "bands": [signer.bands(s) if len(s) else None for s in sets],
            }

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), text_bytes().alias("text"))
    return per_batch(rows, "row long, doc_id long, key binary, set_id binary, bands array<long>", make)


def set_id(grams: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def candidate_units(nodes: DataFrame, block: int) -> DataFrame:
    """(i, j, node, block): the nodes of each unit, a pair of blocks with a common bucket (i = j: of one block)."""
    members = stored(nodes.select("node", F.explode("bands").alias("bucket")))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    shared = stored(look_up(members, stored(buckets), "bucket", size="n"))  # bucket, node, hub, n
    homes = stored(shared.groupBy("node").agg(F.min("hub").alias("home")))
    sizes = homes.groupBy("home").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / block))
    # equal names of two blocks would only make them one
    placed = stored(look_up(homes, stored(sizes), "home", size="size").select("node", F.xxhash64("home", part).alias("block")))
    blocks = shared.join(placed, "node").groupBy("bucket", "block").agg(F.count("*").alias("own"))
    other = blocks.select("bucket", F.col("block").alias("j"))
    pairs = stored(blocks.withColumnRenamed("block", "i").join(other, "bucket").filter("i < j or i = j and own > 1").select("i", "j").distinct())
    ends = pairs.select("i", "j", F.col("i").alias("block")).unionByName(pairs.filter("i <> j").select("i", "j", F.col("j").alias("block")))
    return ends.join(placed, "block").select("i", "j", "node", "block")


def _gram_counts(left: list[np.ndarray], right: list[np.ndarray] | None, step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets: left with left, or left with right. Only n-grams of two sets or more matter."""
    sets = left + (right or [])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right) if right is not None else len(left)))
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        a, b = np.searchsorted(column, [at, at + step])
        m = np.zeros((len(sets), step), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m[: len(left)] @ (m[len(left) :] if right is not None else m).T
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """The least index of each index's component."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def verify_unit(rows: list[dict], threshold: float) -> list[tuple[int, int, int]]:
    """(node, root, links) of one unit: rows of one block, or of two blocks of which only pairs across count."""
    rows = sorted(rows, key=lambda r: (r["block"], r["node"]))
    i, j = rows[0]["i"], rows[0]["j"]
    sets = [np.frombuffer(r["grams"], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets], np.float64)
    copies = np.array([r["copies"] for r in rows], np.int64)
    cut = sum(r["block"] == i for r in rows) if i != j else len(rows)
    if i != j and cut in (0, len(rows)):
        return []
    both = _gram_counts(sets[:cut], sets[cut:] if i != j else None)
    x, y = sizes[:cut, None], (sizes[None, cut:] if i != j else sizes[None, :])
    linked = both >= threshold * (x + y - both) - 1e-9
    if i == j:
        np.fill_diagonal(linked, False)
        links = linked @ copies
        a, b = np.nonzero(np.triu(linked))
    else:
        links = np.concatenate([linked @ copies[cut:], linked.T @ copies[:cut]])
        a, b = np.nonzero(linked)
        b = b + cut
    nodes = [r["node"] for r in rows]
    order = np.argsort(nodes)  # so that the least index is the least node
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    root = _forest(len(nodes), place[a], place[b])
    return [(nodes[k], nodes[order[root[place[k]]]], int(links[k])) for k in np.flatnonzero(links).tolist()]


def verified(units: DataFrame, threshold: float) -> DataFrame:
    """node, root, links of each unit (i, j)."""
    units = units.repartition("i", "j").sortWithinPartitions("i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            got = verify_unit(rows, threshold)
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in range(3)], names=["node", "root", "links"])

        key, unit = None, []
        for batch in batches:
            for row in batch.to_pylist():
                k = (row["i"], row["j"])
                if k != key and unit:
                    yield out(unit)
                    unit = []
                key = k
                unit.append(row)
        if unit:
            yield out(unit)

    return units.mapInArrow(run, "node long, root long, links long")


def _classes(docs: DataFrame, n: int, threshold: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows' prints, and set_id, best (least of its class: late, doc_id, key), n_links of every set."""
    banding = choose_banding(threshold, recall)
    prints = stored(fingerprints(docs, n, banding))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")).alias("best")
    nodes = stored(prints.filter("set_id is not null").groupBy("set_id").agg(F.min("row").alias("node"), best, F.count("*").alias("copies"), F.first("bands").alias("bands")))
    units = stored(candidate_units(nodes, block))
    out = nodes.select("set_id", "node", "best", "copies")
    if units.isEmpty():
        return prints, stored(out.select("set_id", "best", (F.col("copies") - 1).alias("n_links")))
    wanted = units.select("node").distinct().join(nodes.select("node", "copies", F.col("best.key").alias("key")), "node")
    # one text of each node in a unit; its n-grams are made again where they are needed
    texts = docs.select(text_key().alias("key"), text_bytes().alias("text")).filter("key is not null").groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")

    def make():
        return lambda batch: {"node": batch["node"], "copies": batch["copies"], "grams": [shingle_set(t, n).tobytes() for t in batch["text"].to_pylist()]}

    grams = stored(per_batch(texts.select("node", "copies", "text"), "node long, copies long, grams binary", make))
    found = stored(verified(units.join(grams, "node"), threshold))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    ties = found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not ties.isEmpty():
        labels = components(ties)
        roots = stored(out.join(labels.select(F.col("id").alias("node"), F.col("label").alias("root")), "node").select("node", "root", "best"))
        names = stored(roots.groupBy("root").agg(F.min("best").alias("least"), F.count("*").alias("n")))
        named = look_up(roots.select("node", "root"), names, "root", size="n").select("node", "least").join(counts, "node")
        out = out.join(named, "node", "left").select("set_id", F.coalesce("least", "best").alias("best"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    else:
        out = out.select("set_id", "best", (F.col("copies") - 1).alias("n_links"))
    return prints, stored(out)


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 256) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), n_links (other documents that are linked to it), one row per row of docs."""
    prints, sets = _classes(docs, n, threshold, recall, block)
    rows = look_up(prints.select("doc_id", "set_id"), sets, "set_id", "left")
    return rows.select("doc_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 256) -> DataFrame:
    """docs with one row of each class: that of the least id (rows without one come last), then of the least key of its text.

    Rows are told apart by id and text. Of rows with both the same, which are one document, the least by the other
    columns stays; rows without a word are classes of their own by id and text.
    """
    prints, sets = _classes(docs, n, threshold, recall, block)
    kept = sets.select("best.doc_id", "best.key").distinct().unionByName(prints.filter("set_id is null").select("doc_id", "key").distinct())
    names, types = docs.columns, dict(docs.dtypes)
    id_, key, place, best_id, best_key = (fresh_name(name, names) for name in ("id", "key", "place", "best_id", "best_key"))
    order = [F.col(f"`{c}`") for c in names if not types[c].startswith(("map", "variant"))]
    rows = docs.withColumns({id_: F.col("doc_id").cast("long"), key: text_key()})
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(id_, key).orderBy(*order))).filter(F.col(place) == 1)
    kept = kept.select(F.col("doc_id").alias(best_id), F.col("key").alias(best_key))
    # null ids and null texts are values here
    return rows.join(kept, F.col(id_).eqNullSafe(F.col(best_id)) & F.col(key).eqNullSafe(F.col(best_key)), "left_semi").select(*[F.col(f"`{c}`") for c in names])
