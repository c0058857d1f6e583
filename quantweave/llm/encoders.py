"""Ids of many texts from tokenizer libraries that take microseconds a word: each new word goes through the library once.

Texts are cut at spaces where that changes nothing for the tokenizer. A batch's distinct pieces are found by Arrow's
dictionary encoding; those that the worker process hasn't met are joined by spaces, encoded by the library, and cut
apart again at the tokens that begin (or end) a word. What is known is forgotten once it takes `limit` bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space beside other white space, at the start, or alone: where a cut at the space may change tokens.
_WIDE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}"
UNSURE = f"[{_WIDE}] | [{_WIDE}]|^ | $"
#: Latin letters that normalisation leaves alone, then marks (no apostrophe: it may begin a match that goes on with letters).
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

Ids = tuple[np.ndarray, np.ndarray]  # ids one after another; how many each has


def pieces(texts: pa.Array, unsure: str | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut at spaces: where each text's pieces begin (and end), each piece's place among the distinct ones, and those.

    A text in which the pattern `unsure` is found is one piece. No text may be null.
    """
    whole = pc.match_substring_regex(texts, unsure) if unsure else None
    hard = whole is not None and pc.any(whole).as_py()
    cut = pc.split_pattern(pc.if_else(whole, "", texts) if hard else texts, " ")
    ends = np.cumsum(np.concatenate([[0], np.asarray(pc.list_value_length(cut), np.int64)]))
    flat = cut.flatten()
    if hard:
        mask = np.zeros(len(flat), bool)
        mask[ends[:-1][np.asarray(whole)]] = True
        flat = pc.replace_with_mask(flat, pa.array(mask), texts.filter(whole))
    coded = flat.dictionary_encode()
    return ends, np.asarray(coded.indices), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def expand(ids: Ids, index: np.ndarray, ends: np.ndarray) -> Ids:
    """From the ids of distinct pieces to those of texts."""
    flat, size = ids
    n = size[index]
    upto = np.concatenate([[0], np.cumsum(n)])
    kind = np.int32 if upto[-1] < 2**31 else np.int64
    at = np.arange(upto[-1], dtype=kind) + np.repeat(((np.cumsum(size) - size)[index] - upto[:-1]).astype(kind), n)
    return flat[at], np.diff(upto[ends])


#: Bytes of an entry besides its piece and ids: the headers of a text and of bytes, rounding, and a place in a dict that isn't full.
ENTRY = 192


class Known(dict):
    """Piece -> its ids as little-endian 32-bit bytes; learn() gives those of new pieces."""

    def __init__(self, learn: Callable[[list[str]], Iterable[bytes]], limit: int = 96_000_000) -> None:
        super().__init__()
        self.learn, self.limit, self.held = learn, limit, 0

    def ids(self, distinct: list[str]) -> Ids:
        new = [p for p in distinct if p not in self]
        if new and self.held + sum(map(len, new)) + ENTRY * len(new) > self.limit:
            self.clear()
            self.held, new = 0, distinct
        got = list(self.learn(new))
        self.update(zip(new, got))
        self.held += sum(map(len, new)) + sum(map(len, got)) + ENTRY * len(new)
        got = list(map(self.__getitem__, distinct))
        return np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4


def _packed(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _apart(groups: list[list[str]], encoded: Iterable[list[int]], first: np.ndarray | None, last: np.ndarray | None) -> dict[str, bytes]:
    """Ids of words that were encoded joined: `first` marks ids that begin a word, `last` those that end one."""
    out = {}
    for words, ids in zip(groups, encoded):
        ids = np.array(ids, "<u4")
        at = np.flatnonzero(first[ids]) if first is not None else np.concatenate([[0], np.flatnonzero(last[ids]) + 1])[:-1]
        if len(at) == len(words):  # else they are encoded alone
            raw, bounds = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            out.update((w, raw[a:b]) for w, a, b in zip(words, bounds, bounds[1:]))
    return out


def _dealt(words: list[str], per: int = 256) -> list[list[str]]:
    return [words[i : i + per] for i in range(0, len(words), per)]


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _marks(tokenizer, test: Callable[[str], bool]) -> np.ndarray:
    vocabulary = tokenizer.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for t, i in vocabulary.items() if test(t)]] = True
    return out


class WordEnds:
    """A tokenizers file with lower case, dropped white space and word ends (</w>)."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        #: For lower-case words of letters, which the file's normaliser and pattern leave as they are.
        self.bare = _tokenizer(path)
        from tokenizers import normalizers, pre_tokenizers

        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = _marks(self.tokenizer, lambda t: t.endswith("</w>"))
        self.known = Known(self.learn, 80_000_000)
        self.marks = Known(lambda new: map(_packed, self._encode(new)))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> list[bytes]:
        # a word of letters is one match and so are the marks after it
        simple = {p: (m[1].lower(), m[2]) for p in new if (m := SIMPLE.fullmatch(p))}
        groups = _dealt(list({w for w, _ in simple.values()}))
        words = _apart(groups, (e.ids for e in self.bare.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)), None, self.last)
        self.marks.ids(list({m for _, m in simple.values()}))
        rest = [p for p in new if p not in simple or simple[p][0] not in words]
        alone = dict(zip(rest, map(_packed, self._encode(rest))))
        return [alone[p] if p in alone else words[simple[p][0]] + self.marks[simple[p][1]] for p in new]

    def encode(self, texts: pa.Array) -> Ids:
        """White space is dropped and no match spans it, so texts are cut at every space and line end, and before the mark after a letter."""
        texts = pc.replace_substring(texts, "\n", " ")
        # without combining marks, which could join a letter, A-Z may be lowered first
        texts = pc.if_else(pc.match_substring_regex(texts, r"\p{M}|<\|"), texts, pc.ascii_lower(texts))
        cut = pc.replace_substring_regex(texts, r"([A-Za-z])([.,])", r"\1 \2")
        ends, index, distinct = pieces(cut)
        return expand(self.known.ids(distinct), index, ends)


class ByteLevel:
    """A tokenizers file of byte-level BPE; special tokens' strings are plain text. Pieces are encoded with a space before them."""

    def __init__(self, path: str) -> None:
        from .bpe import byte_alphabet

        self.tokenizer = _tokenizer(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.first = np.array([t[:1] == b" " for t in self.bytes_of])

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> list[bytes]:
        groups = _dealt([p for p in new if p and " " not in p and p == p.strip()])
        known = _apart(groups, self._encode([" " + " ".join(g) for g in groups]), self.first, None)
        rest = [p for p in new if p not in known]
        known.update(zip(rest, map(_packed, self._encode([" " + p for p in rest]))))
        return [known[p] for p in new]


class Pieces:
    """A sentencepiece model, which puts a space before each text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(t[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", t) else t.replace("▁", " ").encode() for t in names]
        self.first = np.array([t[:1] == "▁" for t in names])
        #: A piece with a space after another character could span a cut.
        self.spans = any(re.search("[^▁]▁", t) for t in names)
        self.space = self.model.piece_to_id("▁")

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []

    def learn(self, new: list[str]) -> list[bytes]:
        groups = _dealt([p for p in new if p and " " not in p and "▁" not in p])
        known = _apart(groups, self._encode([" ".join(g) for g in groups]), self.first, None)
        rest = [p for p in new if p not in known]
        known.update(zip(rest, map(_packed, self._encode(rest))))
        return [known[p] for p in new]


@lru_cache(maxsize=4)
def word_ends(path: str) -> WordEnds:
    """One a worker process, with what it has learned."""
    return WordEnds(path)


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@lru_cache(maxsize=4)
def sentence_pieces(path: str) -> Pieces:
    return Pieces(path)
