"""Operator 10: benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A window is n consecutive
words of an item; an item of fewer words, but not none, is one window of its own length. A document word inside
any occurrence of a window is hit. A document is contaminated if at least one word is hit and hits are at least
a share of its words.

What is broadcast is flat: the items' words as one run of bytes, and for each window its 64-bit hash, its place
there and its item: about 24 bytes a window besides the text. Documents are scanned by a rolling hash of their words,
and a hit is held against the bytes. Only up to `max_bytes` of it are broadcast; beyond, `hits_by_join` is used:
windows of documents that pass a Bloom filter of the items' hashes (16 MB, whatever their number) are joined with the
items' by 128-bit hashes.

Defined cases: null texts have no words; items without words have no window; items without an id hit words but have
no name; the same window in many items counts for each; an empty benchmark hits nothing; empty tables give no rows;
repeated rows and rows that share an id or have none are judged by their own texts; texts are read whole; of other
columns none is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh_name, per_batch, stored, text_bytes, words_of
from .graph import look_up

BASE, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Of the Bloom filter: bits, the parts in which it is put together, and hashes a window.
BLOOM_BITS, BLOOM_PARTS, BLOOM_HASHES = 1 << 27, 64, 3


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(ids: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """A hash of the k words from each place."""
    n = len(ids) - k + 1
    h = np.full(max(n, 0), k, np.uint64)
    for i in range(k if n > 0 else 0):
        h = h * base + ids[i : i + n]
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Windows:
    """The items' words in one run of bytes, and for each length of window: sorted hashes, first and last byte, item."""

    text: bytes
    names: tuple[str | None, ...]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @property
    def nbytes(self) -> int:
        return len(self.text) + sum(x.nbytes for t in self.tables.values() for x in t)


class TooLarge(ValueError):
    """The benchmark's windows are more than may be broadcast."""


def windows(benchmark: DataFrame, n: int = 13, max_bytes: int = 64_000_000) -> Windows:
    """The windows of all items. Raises TooLarge if they take more than `max_bytes` bytes."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), text_bytes().alias("text"))
    # a word has one byte and one before the next at least, so windows are no more than half of the bytes
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if size > max_bytes:
        raise TooLarge(f"benchmark of {size} bytes; at most {max_bytes} are broadcast")
    parts, at, names, found = [], 0, [], {}
    for row in rows.collect():
        words = words_of(bytes(row["text"]) if row["text"] is not None else None)
        if not words:
            continue
        k, item = min(n, len(words)), len(names)
        names.append(row["item"])
        ends = at + np.cumsum([len(w) + 1 for w in words]) - 1
        starts = ends - np.array([len(w) for w in words])
        parts.append(b" ".join(words))
        at += len(parts[-1]) + 1
        h = rolling(word_hashes(words), k)
        found.setdefault(k, []).append((h, starts[: len(h)], ends[k - 1 :], np.full(len(h), item, np.int32)))
    tables = {}
    for k in sorted(found):
        h, a, b, item = (np.concatenate(x) for x in zip(*found.pop(k)))
        order = np.argsort(h, kind="stable")
        tables[k] = h[order], a[order].astype(np.int32), b[order].astype(np.int32), item[order]
    got = Windows(b" ".join(parts), tuple(names), tables)
    if got.nbytes > max_bytes:
        raise TooLarge(f"windows of {got.nbytes} bytes; at most {max_bytes} are broadcast")
    return got


class Matcher:
    def __init__(self, windows: Windows) -> None:
        self.windows = windows
        self.known: dict[tuple[int, bytes], tuple[int, ...]] = {}

    def items(self, k: int, h: np.uint64, words: list[bytes]) -> tuple[int, ...]:
        """The items that have this window; none if only the hash is the same."""
        key = k, b" ".join(words)
        if key not in self.known:
            hashes, a, b, item = self.windows.tables[k]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = tuple(dict.fromkeys(int(item[i]) for i in range(lo, hi) if self.windows.text[a[i] : b[i]] == key[1]))
        return self.known[key]

    def judge(self, texts: list[bytes | None]) -> list[tuple[int, np.ndarray, set[int]]]:
        """(number of words, hit word positions, items) of each text; the texts are scanned as one sequence."""
        cut = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in cut], np.int64)
        every = [w for words in cut for w in words]
        ids, first = word_hashes(every), np.cumsum(lengths) - lengths
        room = np.repeat(first + lengths, lengths) - np.arange(len(ids))  # words from here to the end of the text
        covered, items = np.zeros(len(ids) + 1, np.int64), [set() for _ in texts]
        for k, (hashes, *_) in self.windows.tables.items():
            h = rolling(ids, k)
            at = np.searchsorted(hashes, h)
            places = np.flatnonzero((hashes[np.minimum(at, len(hashes) - 1)] == h) & (room[: len(h)] >= k))
            for place in places.tolist():
                if names := self.items(k, h[place], every[place : place + k]):
                    covered[place] += 1
                    covered[place + k] -= 1
                    items[int(np.searchsorted(first, place, "right")) - 1].update(names)
        hit = np.cumsum(covered) > 0
        return [(int(n), np.flatnonzero(hit[s : s + n]), x) for s, n, x in zip(first.tolist(), lengths.tolist(), items)]


def is_contaminated(n_words: int, n_hit: int, share: float) -> bool:
    return n_hit > 0 and n_hit >= share * n_words - 1e-9


def _found(got: list[tuple[int, np.ndarray, set[int]]], names: tuple[str | None, ...], share: float) -> dict:
    items = [sorted({names[i] for i in g[2]} - {None}) for g in got]
    return {
        "n_words": [g[0] for g in got],
        "n_hit": [len(g[1]) for g in got],
        "n_items": [len(x) for x in items],
        "items": items,
        "hit_words": [g[1].astype(np.int32) for g in got],
        "contaminated": [is_contaminated(g[0], len(g[1]), share) for g in got],
    }


FOUND = "n_words long, n_hit long, n_items long, items array<string>, hit_words array<int>, contaminated boolean"


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: float = 0.05, max_bytes: int = 64_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items array<string>, hit_words array<int>, contaminated for every row."""
    try:
        shared = docs.sparkSession.sparkContext.broadcast(windows(benchmark, n, max_bytes))
    except TooLarge:
        return hits_by_join(docs, benchmark, n, share)

    def make():
        matcher = Matcher(shared.value)

        def work(batch: pa.RecordBatch, step: int = 500) -> dict:
            got = []
            for at in range(0, batch.num_rows, step):
                got += matcher.judge(batch["text"].slice(at, step).to_pylist())
            return {"doc_id": batch["doc_id"], **_found(got, shared.value.names, share)}

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return per_batch(rows, f"doc_id long, {FOUND}", make)


def _pair(ids: np.ndarray, k: int) -> np.ndarray:
    """128-bit hashes of all windows of k words, as rows of two numbers."""
    return np.stack([rolling(ids, k), rolling(ids, k, OTHER)], axis=1)


def _bloom_places(h: np.ndarray) -> np.ndarray:
    """The bits of each hash pair, one row for each of the filter's hashes."""
    return np.stack([(h[:, 0] + np.uint64(i) * (h[:, 1] | np.uint64(1))) >> np.uint64(64 - 27) for i in range(BLOOM_HASHES)]).astype(np.int64)


def bloom_filter(items: DataFrame) -> np.ndarray:
    """The Bloom filter of the windows a, b of items, put together part by part; its size is fixed."""
    span = BLOOM_BITS // BLOOM_PARTS

    def run(batches):
        bits = np.zeros(BLOOM_BITS, bool)
        for batch in batches:
            h = np.stack([batch["a"].to_numpy(), batch["b"].to_numpy()], axis=1).view(np.uint64)
            bits[_bloom_places(h).ravel()] = True
        for part in range(BLOOM_PARTS):
            own = bits[part * span : (part + 1) * span]
            if own.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    def either(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": rows["part"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["bits"]]).tobytes()]})

    whole = np.zeros(BLOOM_BITS // 8, np.uint8)
    parts = items.select("a", "b").coalesce(32).mapInArrow(run, "part int, bits binary").groupBy("part").applyInPandas(either, "part int, bits binary")
    for row in parts.collect():  # BLOOM_PARTS rows at most, 16 MB in all
        whole[row["part"] * span // 8 : (row["part"] + 1) * span // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return whole


def text_key() -> Column:
    return F.unhex(F.md5(text_bytes()))


def text_hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: float = 0.05) -> DataFrame:
    """key (md5 of a text) and what hits() finds in it, for every different text with a hit; for a benchmark of any size."""
    spark = docs.sparkSession

    def make_items():
        def work(batch: pa.RecordBatch) -> dict:
            names, lengths, told, pairs = [], [], [], [np.zeros((0, 2), np.uint64)]
            for item, t in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
                words = words_of(t)
                if words:
                    k = min(n, len(words))
                    pairs.append(_pair(word_hashes(words), k))
                    names += [item] * len(pairs[-1])
                    lengths += [k] * len(pairs[-1])
                    told += [b" ".join(words[i : i + k]) for i in range(len(pairs[-1]))]
            both = np.concatenate(pairs).view(np.int64)
            return {"item": names, "k": lengths, "a": both[:, 0], "b": both[:, 1], "window": told}

        return work

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), text_bytes().alias("text"))
    items = stored(per_batch(items, "item string, k int, a long, b long, window binary", make_items).distinct())
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # n of them at most
    shared = spark.sparkContext.broadcast((lengths, bloom_filter(items)))

    def make_places():
        def work(batch: pa.RecordBatch) -> dict:
            lengths, bits = shared.value
            keys, counts, places, sizes, told = [], [], [], [], []
            for key, t in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
                words = words_of(t)
                ids = word_hashes(words)
                for k in lengths:
                    h = _pair(ids, k)
                    bit = _bloom_places(h)
                    near = np.flatnonzero(((bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).all(axis=0)) if len(h) else []
                    keys += [key] * len(near)
                    counts += [len(ids)] * len(near)
                    places += list(near)
                    sizes += [k] * len(near)
                    told += [b" ".join(words[i : i + k]) for i in near]
            return {"key": keys, "n_words": counts, "at": places, "k": sizes, "window": told}

        return work

    texts = docs.select(text_key().alias("key"), text_bytes().alias("text")).filter("key is not null").groupBy("key").agg(F.first("text").alias("text"))
    places = stored(per_batch(texts, "key binary, n_words long, at int, k int, window binary", make_places))
    # a place once, whatever the number of items that have its window
    # words decide, hashes only chose the places; a common window's places are split by the adaptive join
    known = items.select("k", "window").distinct()
    found = stored(places.join(known, ["k", "window"]))
    words = found.select("key", "n_words", F.explode(F.sequence("at", F.col("at") + F.col("k") - 1)).alias("at")).distinct()
    words = words.groupBy("key", "n_words").agg(F.sort_array(F.collect_list("at")).alias("hit_words"))  # the places of one text
    names = found.select("key", "k", "window").distinct().join(items.filter("item is not null"), ["k", "window"]).groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = words.join(names, "key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.size("hit_words").cast("long")
    return stored(out.select("key", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hit_words", ((n_hit > 0) & (n_hit >= share * F.col("n_words") - 1e-9)).alias("contaminated")))


def hits_by_join(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: float = 0.05) -> DataFrame:
    """As hits(), for a benchmark of any size; every different text is scanned once, and rows get what their text has."""

    def make_counts():
        return lambda batch: {"doc_id": batch["doc_id"], "key": batch["key"], "words": [len(words_of(t)) for t in batch["text"].to_pylist()]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), text_bytes().alias("text"))
    rows = stored(per_batch(rows, "doc_id long, key binary, words long", make_counts))
    found = look_up(rows, text_hits(docs, benchmark, n, share), "key", "left")
    none = F.lit(0).cast("long")
    return found.select(
        "doc_id", F.col("words").alias("n_words"), F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _filter(docs: DataFrame, benchmark: DataFrame, n: int, share: float, max_bytes: int, change) -> DataFrame:
    """docs after change(batch, texts, [(hit words, contaminated)]) of each batch."""
    if dict(docs.dtypes)["text"] != "string":
        docs = docs.withColumn("text", F.col("text").cast("string"))
    names = docs.columns
    try:
        shared = docs.sparkSession.sparkContext.broadcast(windows(benchmark, n, max_bytes))
    except TooLarge:
        # what was found in a row's text is joined to it
        key, hit = fresh_name("key", names), fresh_name("hit_words", names)
        bad = stored(text_hits(docs, benchmark, n, share).filter("contaminated").select(F.col("key").alias(key), F.col("hit_words").alias(hit)))
        rows = look_up(docs.withColumn(key, text_key()), bad, key, "left").select(*[F.col(f"`{c}`") for c in names], F.col(hit))

        def run_joined(batches):
            for batch in batches:
                found = [(np.array(h or [], np.int64), h is not None) for h in batch[hit].to_pylist()]
                own = batch.select(names)
                yield change(own, [t.encode() if t is not None else None for t in own["text"].to_pylist()], found)

        return rows.mapInArrow(run_joined, docs.schema)

    def run(batches, step: int = 500):
        matcher = Matcher(shared.value)
        for batch in batches:
            raw = [t.encode() if t is not None else None for t in batch["text"].to_pylist()]
            got = []
            for at in range(0, len(raw), step):
                got += matcher.judge(raw[at : at + step])
            yield change(batch, raw, [(g[1], is_contaminated(g[0], len(g[1]), share)) for g in got])

    return docs.mapInArrow(run, docs.schema)


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: float = 0.05, max_bytes: int = 64_000_000) -> DataFrame:
    """docs without the contaminated rows: one pass, no shuffle (a join by text for a benchmark over `max_bytes`)."""
    return _filter(docs, benchmark, n, share, max_bytes, lambda batch, raw, got: batch.filter(pa.array([not bad for _, bad in got], pa.bool_())))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: float = 0.05, max_bytes: int = 64_000_000) -> DataFrame:
    """docs where contaminated texts lose their hit stretches, from the first to the last word of each; n_chars follows."""

    def change(batch: pa.RecordBatch, raw: list[bytes | None], got: list) -> pa.RecordBatch:
        out = []
        for t, (hit, bad) in zip(raw, got):
            if not bad:
                out.append(t.decode() if t is not None else None)
                continue
            spans = [m.span() for m in WORD.finditer(t.lower())]
            runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
            keep, at = [], 0
            for r in runs:
                keep.append(t[at : spans[r[0]][0]])
                at = spans[r[-1]][1]
            out.append(b"".join([*keep, t[at:]]).decode())
        columns = {f.name: batch[f.name] for f in batch.schema}
        columns["text"] = pa.array(out, batch.schema.field("text").type)
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([len(t) if bad else n for t, n, (_, bad) in zip(out, columns["n_chars"].to_pylist(), got)], batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return _filter(docs, benchmark, n, share, max_bytes, change)
