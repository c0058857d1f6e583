"""Operator 9: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a rank file (base64 token, rank). The library's byte-level alphabet writes each byte as one
character, so that any bytes can be tokens; merges are all splits of a token into two tokens, by the token's
rank. A text is cut by the pattern and each match is encoded on its own. Ids of matches are kept for reuse, so
a batch sends only its new matches through the library.

One thing can't be told to the library: two merges that overlap and give the same token have the same rank, and
the leftmost is due, while the library ranks them by their place in the list of merges. That takes a stretch x y z
where x y and y z are the same token, so z repeats x's length of it. Matches that hold such a stretch (`overlaps`)
are merged here by rank and place instead.

Offsets are code points: a token that holds a part of a character spans that whole character. Decoding turns the
library's tokens back by the reversed byte table, joins the bytes and reads UTF-8 after that, so characters that are
split between tokens come back.

Defined cases: a null text is the empty text (no ids); strings that look like special tokens are ordinary
text; empty tables, very long texts and repeated rows need nothing special; of other columns none is read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch


@dataclass(frozen=True)
class BytePairs:
    """The bytes of a rank file and the pattern that cuts texts."""

    data: bytes
    pattern: str

    @staticmethod
    def load(path: str | Path, pattern: str) -> BytePairs:
        return BytePairs(Path(path).read_bytes(), pattern)

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines())}


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it is visible, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def library_tokenizer(ranks: dict[bytes, int]):
    """A tokenizers.Tokenizer that takes each input as one match of the pattern."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    table = byte_alphabet()
    shown = {token: "".join([table[b] for b in token]) for token in ranks}
    merges = [
        (shown[token[:i]], shown[token[i:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        if len(token) > 1
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    tokenizer = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


def overlaps(ranks: dict[bytes, int]) -> set[bytes]:
    """All x y z of tokens x, y, z for which x y and y z are one and the same token."""
    out = set()
    for t in ranks:
        for p in range(1, len(t)):
            x, y, z = t[:p], t[p:], t[-p:]
            if y == t[:-p] and x in ranks and y in ranks and z in ranks:
                out.add(t + z)
    return out


def merge_leftmost(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: the pair of least rank is merged first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    start, end, after = list(range(n)), [*range(1, n + 1)], [*range(1, n + 1)]  # of the part at each place; after: where the next one is
    before = list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] - start[i] != size:
            continue  # one of the two parts has been merged since
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[start[i] : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]] - start[i]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[start[h] : end[i]])) is not None:
            heapq.heappush(heap, (r, h, end[i] - start[h]))
    return [ranks[piece[start[i] : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, vocabulary: BytePairs, memo: int = 200_000) -> None:
        import ahocorasick
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.ranks = vocabulary.ranks()
        self.pattern = regex.compile(vocabulary.pattern)
        self.tokenizer = library_tokenizer(self.ranks)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.tokenizer.get_vocab().items():
            self.bytes_of[rank] = bytes(byte_of[c] for c in token)
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)
        self.ties = ahocorasick.Automaton()
        for stretch in overlaps(self.ranks):
            self.ties.add_word(stretch.decode("latin-1"), None)
        self.ties.make_automaton()
        self.tied = len(self.ties) > 0
        self.seen: dict[str, bytes] = {}
        self.memo = memo

    def has_tie(self, piece: bytes) -> bool:
        return self.tied and next(self.ties.iter(piece.decode("latin-1")), None) is not None

    def learn(self, pieces: list[str]) -> None:
        """Ids of new matches, as little-endian 32-bit bytes."""
        plain = []
        for piece in pieces:
            raw = piece.encode()
            if len(raw) > 2 and self.has_tie(raw):
                self.seen[piece] = np.array(merge_leftmost(raw, self.ranks), "<u4").tobytes()
            else:
                plain.append(piece)
        for piece, got in zip(plain, self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)):
            self.seen[piece] = np.array(got.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None], step: int = 200) -> list[bytes]:
        """The ids of each text as little-endian 32-bit bytes."""
        out = []
        for at in range(0, len(texts), step):
            cut = [self.pattern.findall(t) if t else [] for t in texts[at : at + step]]
            need = set().union(*cut)
            if len(self.seen) + len(need) > self.memo:
                self.seen.clear()
            if new := [p for p in need if p not in self.seen]:
                self.learn(new)
            out += [b"".join(map(self.seen.__getitem__, pieces)) for pieces in cut]
        return out

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> np.ndarray:
        """(start, end) of each token in code points, end exclusive."""
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        if not len(ends):
            return np.zeros((0, 2), np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        return np.stack([char[np.concatenate([[0], ends[:-1]])], char[ends - 1] + 1], axis=1)


def _codec(spark: SparkSession, vocabulary: BytePairs):
    shared = spark.sparkContext.broadcast(vocabulary)  # a vocabulary file: its size is fixed
    return lambda: Codec(shared.value)


def encode(docs: DataFrame, vocabulary: BytePairs, offsets: bool = True) -> DataFrame:
    """doc_id, ids array<int>, and with offsets: starts and ends array<int>."""
    make_codec = _codec(docs.sparkSession, vocabulary)

    def make():
        codec = make_codec()

        def work(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch["text"].to_pylist()]
            ids = codec.encode(texts)
            out = {"doc_id": batch["doc_id"], "ids": [np.frombuffer(i, "<u4").astype(np.int32) for i in ids]}
            if offsets:
                spans = [codec.offsets(t, i).astype(np.int32) for t, i in zip(texts, ids)]
                out |= {"starts": [s[:, 0] for s in spans], "ends": [s[:, 1] for s in spans]}
            return out

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_batch(rows, "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets, make)


def decode(encoded: DataFrame, vocabulary: BytePairs) -> DataFrame:
    """doc_id, data binary (the bytes of ids), text string (as UTF-8; bytes that are none become U+FFFD). Null ids are no ids."""
    make_codec = _codec(encoded.sparkSession, vocabulary)

    def make():
        codec = make_codec()

        def work(batch: pa.RecordBatch) -> dict:
            data = [codec.decode_bytes(np.array(i or [], "<u4").tobytes()) for i in batch["ids"].to_pylist()]
            return {"doc_id": batch["doc_id"], "data": data, "text": [d.decode("utf-8", "replace") for d in data]}

        return work

    return per_batch(encoded.select("doc_id", "ids"), "doc_id long, data binary, text string", make)


def round_trip(docs: DataFrame, vocabulary: BytePairs) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    make_codec = _codec(docs.sparkSession, vocabulary)

    def make():
        codec = make_codec()

        def work(batch: pa.RecordBatch) -> dict:
            ids = codec.encode(batch["text"].to_pylist())
            return {
                "doc_id": batch["doc_id"],
                "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode_bytes(i)).hexdigest() for i in ids],
            }

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_batch(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def tokenise(docs: DataFrame, vocabulary: BytePairs) -> DataFrame:
    """Documents as training rows: doc_id, lang, source, n_chars, n_tokens, ids, decodes (the ids decode to the text)."""
    make_codec = _codec(docs.sparkSession, vocabulary)

    def make():
        codec = make_codec()

        def work(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch["text"].to_pylist()]
            ids = codec.encode(texts)
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)], dtype=np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            out = {c: batch[c] for c in ("doc_id", "lang", "source", "n_chars")}
            return out | {
                "n_tokens": np.diff(ends).astype(np.int64),
                "ids": pa.ListArray.from_arrays(pa.array(ends), flat).cast(pa.list_(pa.field("element", pa.int32()))),
                "decodes": [codec.decode_bytes(i) == t.encode() for t, i in zip(texts, ids)],
            }

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    return per_batch(rows, "doc_id long, lang string, source string, n_chars long, n_tokens long, ids array<int>, decodes boolean", make)
