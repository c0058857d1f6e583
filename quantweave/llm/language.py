"""Operator 5: language by compression with per-language zstandard raw-content dictionaries.

A dictionary is a bounded part of the text of one language: pieces of all its learned texts, from first to last, by
the order of a hash. A whole text is cut into blocks; each block is compressed with every dictionary, and the
language with the smallest sum is chosen. A text whose two best sums lie close together is rejected: by less than a
fiftieth (on held-out texts that rejects most texts of languages that were not learned), or by less than that where
learned texts, kept from the dictionaries, lie closer. Texts and dictionaries are lower-cased first, and every text
is followed by a run that compresses to almost nothing: zstandard stores a block as it is unless that saves enough,
and then every dictionary would give the same size.

Defined cases: a null text and a text without a letter get `und`, score 0, and are rejected; ties go to the
language with more learned documents, then by name; with nothing to learn from every row is `und`; an empty
table gives no rows; repeated rows are scored alike; of other columns none is read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, id_hash, per_batch

UNKNOWN = "und"
PADDING = b"\x01" * 200
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries, the most frequent language first."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int = 6
    #: The shortest match: four bytes, so that parts of words count.
    match: int = 4
    block: int = 8192
    #: Bytes of compressed size that count as one nat when sums are turned into a score.
    scale: float = 6.0
    #: The least difference of the best two sums, as a share of the best. fit() lowers it where its texts ask for that.
    margin: float = 0.02


def fit(docs: DataFrame, size: int = 64_000, piece: int = 400, total: int = 32_000_000, apart: int = 60, lost: float = 0.005, **options) -> LanguageModel:
    """Dictionaries from learned rows, for every language that they have: at most `size` characters of a language, and
    `total` of all, in pieces of `piece`. These bounds are the sample that the model is fitted on; scoring reads
    whole texts. Of a fifth of the documents, which the dictionaries don't see, at most `apart` a language are scored
    whole, for the margin, unless that is given.

    Pieces and documents are taken in the order of hashes of their ids, so that they don't depend on the partitions.
    """
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select(F.col("lang").cast("string").alias("lang"), "doc_id", F.col("text").cast("string").alias("text"))
    seen = F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(5)) > 0
    pieces = F.ceil(F.length("text") / piece).cast("int")
    counts = rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.when(seen, pieces)).alias("pieces"), F.sum(pieces).alias("all"), F.sum((~seen).cast("int")).alias("apart")).orderBy(F.desc("docs"), "lang").collect()
    if not counts:
        return LanguageModel((), (), **options)
    names = [r["lang"] for r in counts]
    # of the rarest languages all documents are seen
    rare = [r["lang"] for r in counts if r["pieces"] is None]
    seen = (seen | F.col("lang").isin(rare)) if rare else seen
    most = max(1, min(size, total // len(names)) // piece)

    def few(of: str, n: int) -> Column:
        """The share of a language's hashes that holds n of the least with room to spare."""
        return F.coalesce(*[F.when(F.col("lang") == r["lang"], min(1.0, (4 * n + 100) / max(1, r[of] or r["all"]))) for r in counts])

    # what can't be among the first is left out where it lies; Spark keeps `most` pieces of the rest in each task
    cut = rows.filter(seen).select("lang", "doc_id", "text", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("at"))
    cut = cut.withColumn("h", F.pmod(F.xxhash64("doc_id", "at"), F.lit(1 << 31))).filter(F.col("h") < few("pieces", most) * float(1 << 31))
    cut = cut.select("lang", "h", F.lower(F.substring("text", F.col("at") * piece + 1, F.lit(piece))).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    sample = cut.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).collect()
    own: dict[str, list[str]] = {name: [] for name in names}
    for r in sorted(sample, key=lambda r: r["n"]):
        own[r["lang"]].append(r["text"])
    model = LanguageModel(tuple(names), tuple("\n".join(own[n]).encode() for n in names), **options)
    if "margin" in options or len(names) < 2:
        return model
    test = rows.filter(~seen).filter(id_hash("doc_id") < few("apart", apart) * float(1 << 31))
    test = test.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(id_hash("doc_id"), "doc_id", "text"))).filter(F.col("n") <= apart)
    told = predict(test, model, keep=("lang",)).select("lang", "lang_pred", "margin").collect()
    return replace(model, margin=least_margin([r["margin"] for r in told if r["lang_pred"] == r["lang"]], lost, model.margin))


def least_margin(right: list[float], lost: float, most: float) -> float:
    """`most`, or less where a larger share than `lost` of rightly told texts (or than a twentieth, of too few texts to
    show that share) would lie below it. A tie is always too close.
    """
    share = lost if len(right) * lost >= 1 else 0.05
    return max(0.001, min(most, float(np.quantile(right, share, method="lower")))) if right else most


def scorer(model: LanguageModel):
    """Whole text -> (language, score, relative margin)."""
    import zstandard

    packers = []
    for data in model.dictionaries:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(model.level, source_size=model.block, dict_size=len(data), min_match=model.match, write_content_size=False, write_checksum=False, write_dict_id=False)
        d.precompute_compress(compression_params=how)
        packers.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d))

    def score(text: str | None) -> tuple[str, float, float]:
        if not packers or text is None or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        data = b" " + text.lower().encode() + b" " + PADDING
        blocks = [data[i : i + model.block] for i in range(0, len(data), model.block)]
        sums = [sum(len(p.compress(b)) for b in blocks) for p in packers]
        best = min(range(len(sums)), key=sums.__getitem__)  # the first of equals
        if len(sums) == 1:
            return model.languages[0], 1.0, 1.0
        rest = min(s for i, s in enumerate(sums) if i != best)
        weight = sum(math.exp(max(-700.0, (sums[best] - s) / model.scale)) for s in sums)
        return model.languages[best], 1.0 / weight, (rest - sums[best]) / sums[best]

    return score


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected for every row, and text columns to keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit()

    def make():
        score = scorer(shared.value)

        def work(batch: pa.RecordBatch) -> dict:
            got = [score(t) for t in batch["text"].to_pylist()]
            return {
                **{c: batch[c] for c in ("doc_id", "held_out", *keep)},
                "lang_pred": [g[0] for g in got],
                "score": [g[1] for g in got],
                "margin": [g[2] for g in got],
                "rejected": [g[0] == UNKNOWN or g[2] < shared.value.margin for g in got],
            }

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"), *[F.col(c).cast("string").alias(c) for c in keep])
    return per_batch(rows, "doc_id long, held_out boolean, " + "".join(f"{c} string, " for c in keep) + "lang_pred string, score double, margin double, rejected boolean", make)


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs without the rows that are rejected; one pass, nothing is shuffled or joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = scorer(shared.value)
        for batch in batches:
            got = [score(t) for t in batch["text"].to_pylist()]
            yield batch.filter(pa.array([g[0] != UNKNOWN and g[2] >= shared.value.margin for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
