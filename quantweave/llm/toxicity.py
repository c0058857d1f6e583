"""Operator 3: toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and the first three to six characters of longer words. A term has an axis of its own if toxic
examples have it more often beyond doubt: the likelihood ratio of that, as a number of standard deviations, is above
`sure`. There is no other cut, by number or by frequency. All words, of whatever term, are counted on one more axis, so
that one chance hit in a long text lies far from many hits in a short one. Document frequencies are counted over all
documents. Examples with the same vector are one entry with counts of labels. Each term has an inverted list of
entries, cut into blocks with the largest weight of each: blocks are visited by falling upper bound until none can
better the k-th best example, so the k nearest examples are exact. Votes weigh by nearness; a monotone map, fitted
on votes that leave the example itself out, turns them into probabilities. A document without any term that has an
axis gets the rate of such examples.

The labelled sample is bounded by `examples` rows, in the order of a hash of their id.

Defined cases: null, empty and wordless texts have no terms; labels that are null or without a document teach
nothing; of repeated labels the larger counts; of labelled rows that share an id the least text; without labels
of both kinds every score is 0, and without any term with an axis it is the examples' rate; of examples as near as
the k-th all share the last places; an empty table gives no rows; of other columns none is read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, hash_sample, held_out, per_batch, stored, text_bytes, words_of


#: The pseudo-term of a text's length, and the weight of an octave of it.
LENGTH, LENGTH_WEIGHT = -1, 1.0


def length_of(words: int) -> int:
    return round(8 * math.log2(1 + words))


def terms_of(word: bytes) -> tuple[str, ...]:
    """The word itself, and what it begins with if it is longer."""
    w = word.decode("utf-8", "replace")
    return (w, *(f"{w[:n]}*" for n in (3, 4, 5, 6) if len(w) > n))


@dataclass
class BlockMaxIndex:
    """Entries (unit vectors as term -> weight) behind inverted lists that are cut into blocks with their maxima.

    A block has for each of its terms the places and weights of the entries that hold it; a visit adds up a query's lists.
    """

    size: int = 0
    block: int = 2048
    place: dict[int, int] = field(default_factory=dict)  # term -> row of `most`
    most: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # the largest weight of each term in each block
    lists: list[dict[int, tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)  # of each block: row -> (places in the block, weights)

    @staticmethod
    def build(entries: list[dict[int, float]], block: int = 2048) -> BlockMaxIndex:
        place = {t: i for i, t in enumerate(sorted({t for e in entries for t in e}))}
        n = -(-len(entries) // block)
        most, lists = np.zeros((len(place), n)), []
        for b in range(n):
            held: dict[int, tuple[list[int], list[float]]] = {}
            for i, e in enumerate(entries[b * block : (b + 1) * block]):
                for t, w in e.items():
                    at, weights = held.setdefault(place[t], ([], []))
                    at.append(i)
                    weights.append(w)
            lists.append({row: (np.array(at), np.array(weights)) for row, (at, weights) in held.items()})
            for row, (_, weights) in lists[-1].items():
                most[row, b] = weights.max()
        return BlockMaxIndex(len(entries), block, place, most, lists)

    def nearest(self, query: dict[int, float], k: int, counts: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The entries of largest cosine above 0 as (cosine, entry), best first, ties to the smaller entry: k of them,
        or with counts of examples, those that hold the k nearest examples and all that are as near as the last."""
        used = [(self.place[t], w) for t, w in query.items() if t in self.place]
        if not used:
            return []
        rows, values = [r for r, _ in used], np.array([w for _, w in used])
        bound = values @ self.most[rows]
        best_s, best_i, least = np.zeros(0), np.zeros(0, np.int64), 0.0
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or bound[b] < least - 1e-11:
                break
            sums, lists = np.zeros(min(self.block, self.size - b * self.block)), self.lists[b]
            for r, w in used:
                if r in lists:
                    at, weights = lists[r]
                    sums[at] += w * weights
            sums = sums.round(12)
            # of one block no more than its k best entries can count, and what is as near as the last of them
            floor = max(least, np.partition(sums, len(sums) - k)[len(sums) - k]) if len(sums) > k else least
            near = np.flatnonzero((sums >= floor) & (sums > 0))
            if len(near):
                s, i = np.concatenate([best_s, sums[near]]), np.concatenate([best_i, near + b * self.block])
                order = np.lexsort((i, -s))
                best_s, best_i = s[order], i[order]
                if counts is None:
                    best_s, best_i = best_s[:k], best_i[:k]
                    least = best_s[-1] if len(best_s) == k else 0.0
                else:
                    held = np.cumsum(counts[best_i])
                    if held[-1] >= k:
                        least = best_s[int(np.searchsorted(held, k))]
                        best_s, best_i = best_s[best_s >= least], best_i[best_s >= least]
        return list(zip(best_s.tolist(), best_i.tolist()))


@dataclass(frozen=True)
class ToxicityModel:
    terms: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    toxic: np.ndarray  # of each entry: toxic examples
    total: np.ndarray  # and all examples
    example: np.ndarray  # the least doc_id of its examples
    empty_rate: float
    raw: np.ndarray  # calibration: votes ...
    probability: np.ndarray  # ... and their probabilities
    k: int = 15

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        """Unit vector of term counts; LENGTH counts words, rounded to an eighth of an octave."""
        v = {t: (1 + math.log(n)) * self.idf[t] if t != LENGTH else LENGTH_WEIGHT * n / 8 for t, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: float(x / norm) for t, x in v.items()}

    def vote(self, counts: dict[int, int], own: tuple[int, int] | None = None) -> tuple[float | None, list[tuple[float, int]]]:
        """Share of toxic votes among the k nearest examples, and their entries; own (entry, label) leaves one example out.

        Examples that are as near as the k-th share the places that nearer ones leave."""
        near = self.index.nearest(self.vector(counts), self.k + (own is not None), self.total)
        top = bottom = left = 0.0
        at = 0
        while at < len(near) and left < self.k:
            cosine, toxic, total = near[at][0], 0.0, 0.0
            while at < len(near) and near[at][0] == cosine:
                entry = near[at][1]
                mine = own is not None and entry == own[0]
                toxic += self.toxic[entry] - (own[1] if mine else 0)
                total += self.total[entry] - (1 if mine else 0)
                at += 1
            share = min(1.0, (self.k - left) / total) if total else 0.0
            weight = share / (0.05 + max(0.0, 1 - cosine))
            top, bottom, left = top + weight * toxic, bottom + weight * total, left + share * total
        return (top / bottom if bottom > 0 else None), near

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[float, int]]]:
        if not counts or not self.index.size:
            return self.empty_rate, []
        raw, near = self.vote(counts)
        return (self.empty_rate if raw is None else float(np.interp(raw, self.raw, self.probability))), near


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: distinct x and their non-decreasing means."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, count, least x, most x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        if pools and pools[-1][3] == a:
            pools[-1][0] += b
            pools[-1][1] += 1
        else:
            pools.append([b, 1, a, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = hi
    xs = np.array([v for p in pools for v in p[2:4]])
    ys = np.array([p[0] / p[1] for p in pools for _ in range(2)])
    return xs, ys


def fit(docs: DataFrame, labels: DataFrame, examples: int = 8000, sure: float = 4.0, k: int = 15) -> ToxicityModel:
    """Learn from labelled rows that aren't held out: at most `examples` of them."""
    spark = docs.sparkSession
    known = labels.filter(~held_out() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = hash_sample(known, "doc_id", examples).collect()
    nothing = ToxicityModel({}, np.zeros(0), BlockMaxIndex(), np.zeros(0), np.zeros(0), np.zeros(0, np.int64), 0.0, np.array([0.0, 1.0]), np.array([0.0, 0.0]), k)
    if not chosen:
        return nothing
    sample = F.broadcast(spark.createDataFrame([tuple(r) for r in chosen], "doc_id long, toxic int"))  # bounded by `examples`

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(sample, "doc_id")
    texts = stored(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))).coalesce(16)
    n, positive = texts.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not positive or positive == n:
        return nothing

    def make_terms():
        def work(batch: pa.RecordBatch) -> dict:
            every, toxic = Counter(), Counter()
            for x, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                own = {t for w in set(words_of(x)) for t in terms_of(w)}
                every.update(own)
                if label:
                    toxic.update(own)
            return {"term": list(every), "a": [toxic[t] for t in every], "d": list(every.values())}

        return work

    seen = per_batch(texts, "term string, a long, d long", make_terms).groupBy("term").agg(F.sum("a").alias("a"), F.sum("d").alias("d"))
    a, b = F.col("a").cast("double"), (F.col("d") - F.col("a")).cast("double")
    part = lambda x, all_: F.when(x > 0, x * F.log(x * n / all_)).otherwise(0.0)
    g = 2 * sum(part(x, row * total) for x, row, total in ((a, a + b, positive), (b, a + b, n - positive), (positive - a, n - a - b, positive), (n - positive - b, n - a - b, n - positive)))
    evidence = F.when(a * n > (a + b) * positive, g - sure**2)
    terms = {r["term"]: i for i, r in enumerate(seen.filter(evidence > 0).orderBy("term").select("term").collect())}  # no more than the sample has
    if not terms:
        return replace(nothing, empty_rate=positive / n)

    shared = spark.sparkContext.broadcast(terms)

    def make_df():
        lookup = lookup_of(shared.value)

        def work(batch: pa.RecordBatch) -> dict:
            found: Counter[int] = Counter()
            for x in batch["text"].to_pylist():
                found.update({i for w in set(words_of(x)) for i in lookup[w]})
            found[-1] = batch.num_rows
            return {"term": list(found), "n": list(found.values())}

        return work

    every = per_batch(docs.select(text_bytes().alias("text")), "term int, n long", make_df).groupBy("term").agg(F.sum("n").alias("n")).collect()
    freq = {r["term"]: r["n"] for r in every}
    idf = np.array([math.log((1 + freq[-1]) / (1 + freq.get(i, 0))) + 1 for i in range(len(terms))])

    def make_vectors():
        lookup = lookup_of(shared.value)

        def work(batch: pa.RecordBatch) -> dict:
            words = [words_of(x) for x in batch["text"].to_pylist()]
            counts = [counted(w, lookup) for w in words]
            out = {"doc_id": batch["doc_id"], "toxic": batch["toxic"]}
            return out | {"terms": [list(c) for c in counts], "counts": [list(c.values()) for c in counts]}

        return work

    rows = per_batch(texts, "doc_id long, toxic int, terms array<int>, counts array<int>", make_vectors).collect()
    model = ToxicityModel(terms, idf, BlockMaxIndex(), np.zeros(0), np.zeros(0), np.zeros(0, np.int64), 0.0, np.array([0.0, 1.0]), np.array([0.0, 1.0]), k)
    entries: dict[tuple, list] = {}
    own, empty = [], [0, 0]
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        counts = dict(zip(r["terms"], r["counts"]))
        if not counts:
            empty[0] += r["toxic"]
            empty[1] += 1
            continue
        key = tuple(sorted(counts.items()))
        e = entries.setdefault(key, [len(entries), 0, 0, r["doc_id"]])
        e[1] += r["toxic"]
        e[2] += 1
        own.append((counts, e[0], r["toxic"]))
    # entries with the same terms share blocks, which keeps their maxima low
    order = sorted(entries, key=lambda key: ([t for t, _ in key if t != LENGTH], key))
    place = {entries[key][0]: i for i, key in enumerate(order)}
    entries, own = {key: entries[key] for key in order}, [(c, place[e], t) for c, e, t in own]
    index = BlockMaxIndex.build([model.vector(dict(key)) for key in entries])
    stats = np.array([e[1:] for e in entries.values()], np.int64).reshape(-1, 3)
    base = positive / n
    rate = (empty[0] + base) / (empty[1] + 1)
    model = ToxicityModel(terms, idf, index, stats[:, 0].astype(float), stats[:, 1].astype(float), stats[:, 2], rate, model.raw, model.probability, k)
    votes = [(model.vote(c, (e, t))[0], t) for c, e, t in own]
    votes = [(v, t) for v, t in votes if v is not None]
    if votes:
        # two made-up votes at the ends keep probabilities off 0 and 1
        x, y = isotonic(np.array([v for v, _ in votes] + [0.0, 1.0]), np.array([t for _, t in votes] + [0.0, 1.0]))
        model = ToxicityModel(terms, idf, index, model.toxic, model.total, model.example, rate, x, np.clip(y, 0.001, 0.999), k)
    return model


def lookup_of(terms: dict[str, int], limit: int = 300_000) -> Memo:
    """Word -> numbers of its kept terms."""
    # a term begins as its word does: most words are told by that
    heads = {t.removesuffix("*")[:3] for t in terms}

    def find(word: bytes) -> tuple[int, ...]:
        if word[:12].decode("utf-8", "ignore")[:3] not in heads:
            return ()
        return tuple(terms[t] for t in terms_of(word) if t in terms)

    return Memo(find, limit)


def counted(words: list[bytes], lookup: Memo) -> dict[int, int]:
    """How often each kept term comes up, and how many words there are if any does."""
    out: dict[int, int] = {}
    for word, n in Counter(words).items():
        for i in lookup[word]:
            out[i] = out.get(i, 0) + n
    if out:
        out[LENGTH] = length_of(len(words))
    return out


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, memo: int = 50_000) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (the nearest examples' doc_ids) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit()

    def make():
        model = shared.value
        lookup = lookup_of(model.terms)

        def judge(key: tuple) -> tuple[float, list[int]]:
            p, near = model.score(dict(key))
            return p, [int(model.example[e]) for _, e in near[:5]]

        seen = Memo(judge, memo)

        def work(batch: pa.RecordBatch) -> dict:
            got = []
            for x in batch["text"].to_pylist():
                got.append(seen[tuple(sorted(counted(words_of(x), lookup).items()))])
            return {
                "doc_id": batch["doc_id"],
                "held_out": batch["held_out"],
                "score": [g[0] for g in got],
                "predicted": [int(g[0] >= threshold) for g in got],
                "evidence": [g[1] for g in got],
            }

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_bytes().alias("text"))
    return per_batch(rows, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>", make)
