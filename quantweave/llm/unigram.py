"""Operator 8: token counts of a unigram tokenizer without its tokens: count-only Viterbi.

The vocabulary is a list of (piece, score). A text is cut at white space (as str.split cuts); each word gets
U+2581 before it and is segmented on its own. An Aho-Corasick automaton lists the pieces that end at each
position; a forward pass keeps the best score and the number of pieces of the best path, nothing else.

Tie rules, as the tokenizers library has them: at a position, starts are tried from the leftmost, and only a
strictly better score replaces a path. Where no one-character piece starts, an unknown character costs
(least score - 10); a run of unknown characters is one piece, or, with byte fallback, as many pieces as it has
UTF-8 bytes. Scores are added as doubles.

Defined cases: null and blank texts have 0 tokens; an empty table gives no rows; texts are counted whole;
repeated rows are counted alike; of other columns none is read.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, per_batch

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Unigram:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_fallback: bool = False


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message; values of length-delimited fields are bytes."""
    at, end = 0, len(data)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    while at < end:
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def load(path: str | Path) -> Unigram:
    """Pieces and scores of a SentencePiece model file. Control, unknown and byte pieces never match text."""
    import struct

    pieces, scores, fallback = [], [], False
    for number, value in _fields(Path(path).read_bytes()):
        if number == 1:
            x = dict(_fields(value))
            kind = x.get(3, 1)  # 1 normal, 4 user-defined; 6 byte
            fallback |= kind == 6
            if kind in (1, 4):
                pieces.append(x[1].decode())
                scores.append(struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0])
    return Unigram(tuple(pieces), tuple(scores), fallback)


def counter(model: Unigram):
    """Word (with its mark) -> number of pieces of the best path."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    least = min(model.scores, default=0.0)
    for piece, score in zip(model.pieces, model.scores):
        if piece:
            automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    unknown, fallback = least - UNKNOWN_PENALTY, model.byte_fallback

    def count(word: str) -> int:
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in automaton.iter(word) if model.pieces else ():
            ends[end + 1].append(match)
        single = [False] * n
        for i in range(n):
            single[i] = any(length == 1 for length, _ in ends[i + 1])
        best, pieces, run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top, count_, in_run = None, 0, False
            # the longest match starts leftmost, and is tried first
            for length, score in sorted(ends[end], reverse=True):
                s = best[end - length] + score
                if top is None or s > top:
                    top, count_, in_run = s, pieces[end - length] + 1, False
            if not single[end - 1]:
                s = best[end - 1] + unknown
                if top is None or s > top:
                    cost = len(word[end - 1].encode()) if fallback else (0 if run[end - 1] else 1)
                    top, count_, in_run = s, pieces[end - 1] + cost, True
            best[end], pieces[end], run[end] = top, count_, in_run
        return pieces[n]

    return count


def count_tokens(docs: DataFrame, model: Unigram, memo: int = 400_000) -> DataFrame:
    """doc_id, n_words, n_tokens for every row. Counts of words are kept for reuse, at most `memo` in a task's process."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary: its size is fixed

    def make():
        count = counter(shared.value)
        seen = Memo(lambda word: count(SPACE + word), memo)

        def work(batch: pa.RecordBatch) -> dict:
            words = [(t or "").split() for t in batch["text"].to_pylist()]
            return {"doc_id": batch["doc_id"], "n_words": [len(w) for w in words], "n_tokens": [sum(map(seen.__getitem__, w)) for w in words]}

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_batch(rows, "doc_id long, n_words long, n_tokens long", make)
