"""Operators 11 to 13 beside the libraries, plain loops and what is in the files."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from pyspark.sql import functions as F

from quantweave.llm import crosstok, encoders, hardneg, tokenfiles
from quantweave.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS, BYTES, PIECES = (public_tokenizers.path(p) for p in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    None, "", " ", "  ", "a", "Hello, world. It's a test!", "tabs\tand\nlines\n\n  and  gaps ", "<|endoftext|> is plain here", "▁ is a mark", "İstanbul ǰ H̱ é É ß ﬁ", "中文字符没有空格", "\x1c\x85 x y",
    "don't,'s we'll 1.5 a.,b", "😀 emoji 👩‍👩‍👧", "word " * 3000, "x" * 5000, "Hello, world. It's a test!", "nul\x00byte", " lead and trail ", "deadbeef" * 9 + "&&&",
]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def tokenizer(path, plain=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain
    return t


characters = st.text(st.one_of(st.sampled_from(list(" \n\t.,'sStT<|>▁aeéÉ́̇1½'  \x1c\x85İßﬁ中")), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(characters, min_size=1, max_size=5))
def test_pieces_give_the_libraries_ids(texts):
    import sentencepiece

    got, n = encoders.word_ends(WORDS).encode(pa.array(texts))
    want = [tokenizer_of["word"].encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(got, np.cumsum(n)[:-1])] == want
    (a, n_a), (b, n_b) = crosstok.aligner(BYTES, PIECES).encode(pa.array(texts))
    model = tokenizer_of.setdefault("piece", None) or sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tokenizer_of["piece"] = model
    for t, x, y in zip(texts, np.split(a, np.cumsum(n_a)[:-1]), np.split(b, np.cumsum(n_b)[:-1])):
        own_a, own_b = plain_ids(t)
        assert x.tolist() == own_a and y.tolist() == own_b


tokenizer_of = {"word": tokenizer(WORDS), "byte": tokenizer(BYTES, True)}


def plain_bytes():
    byte_of = {c: b for b, c in enumerate(__import__("quantweave.llm.bpe", fromlist=["x"]).byte_alphabet())}
    vocabulary = {i: t for t, i in tokenizer_of["byte"].get_vocab().items()}
    return lambda i: bytes(byte_of[c] for c in vocabulary[i])


def plain_ids(t):
    """A's and B's ids as the contract has them; none where their bytes aren't the space and the text."""
    import sentencepiece

    model = tokenizer_of.get("piece") or sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tokenizer_of["piece"] = model
    if not t:
        return [], []
    a, b = tokenizer_of["byte"].encode(" " + t, add_special_tokens=False).ids, model.encode(t)
    shown = tokenizer_of.setdefault("bytes", plain_bytes())
    want = (" " + t).encode()
    if b"".join(map(shown, a)) != want or b"".join(map(piece_bytes, b)) != want:
        return [], []
    return a, b


def piece_bytes(i):
    p = tokenizer_of["piece"].id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()


# ---- 11


def plain_alignment(texts):
    """Rows by the definition: groups by common ends, links by comparing ranges."""
    shown = tokenizer_of.setdefault("bytes", plain_bytes())
    rows, counts = [], Counter()
    for t in texts:
        a, b = plain_ids(t)
        spans = []
        for ids, size in ((a, lambda i: len(shown(i))), (b, lambda i: len(piece_bytes(i)))):
            at, own = 0, []
            for i in ids:
                own.append((at, at + size(i), i))
                at += size(i)
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, start = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for s, x, i in own if start <= s and x <= e) for own in spans))
            start = e
        links, k = [], 0
        for s, e, i in spans[0]:
            while k < len(spans[1]) and spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((i, spans[1][j][2]))
                j += 1
        counts.update(links)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [(na, nb, ng, len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), h) for na, nb, ng, ls, h in rows]


@pytest.mark.parametrize("most", [1 << 20, 20, 0])
def test_alignment_against_the_definition(spark, most):
    want = plain_alignment(TEXTS)
    d = docs_of(spark, TEXTS).withColumns({"row": F.lit("x"), "pairs": F.lit(1), "ROW": F.lit(2)} if most == 20 else {"pairs": F.lit(1)}) if most != 20 else docs_of(spark, TEXTS).withColumn("Row", F.lit("x"))
    got = {r.doc_id: tuple(r)[1:] for r in crosstok.compare(d.repartition(3), BYTES, PIECES, most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert [got[i] for i in range(len(TEXTS))] == want
    assert want[0] == (0, 0, 0, 0, 0, 0, "") and want[8][0] == 0 and want[14][0] > 3000


def test_alignment_of_no_rows_repeated_rows_and_rows_without_id(spark):
    assert crosstok.compare(docs_of(spark, ["a"]).limit(0), BYTES, PIECES).count() == 0
    rows = spark.createDataFrame([(None, "same text"), (1, "same text"), (1, "same text"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, crosstok.compare(rows, BYTES, PIECES).select("doc_id", "n_links", "count_sum").collect()), key=str)
    n = plain_alignment(["same text"])[0][3]
    assert got == sorted([(None, n, 3 * n), (1, n, 3 * n), (1, n, 3 * n), (2, 0, 0)], key=str)


def test_groups_break_where_starts_reach_the_running_maximum():
    a, b = crosstok.coalesce(np.array([2, 5, 7, 9]), np.array([3, 5, 6, 9]))
    assert a.tolist() == [0, 0, 1, 1] and b.tolist() == [0, 0, 1, 1]
    x, y = crosstok.links(np.array([2, 5, 7, 9]), np.array([3, 5, 6, 9]))
    assert list(zip(x.tolist(), y.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 2), (2, 3), (3, 3)]


# ---- 12


def plain_negatives(rows):
    """The contract as a loop over all rows, with Python's integers."""
    good = []
    for i, (vec_id, v, label) in enumerate(rows):
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for i, a, label, v in good:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), b, j, other == label) for j, b, other, w in good if j != i]
        for p, b, _, _ in sorted(s for s in scored if s[3])[:5]:
            p = -p
            near = sorted(s for s in scored if not s[3] and 30 * p <= -100 * s[0] <= 90 * p)[:10]
            out += [(a, b, k + 1, c, p, -s) for k, (s, c, _, _) in enumerate(near)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"row": F.lit(1), "V": F.lit(2), "s": F.lit(3)})
    label = F.when(df["vec_id"] % 7 == 0, (df["label"] + 1) % 10).otherwise(df["label"])
    return sorted(map(tuple, hardneg.mine(df, lambda i: i % 100 == 0, label, **options).collect()))


@pytest.mark.parametrize("scale", [1.0, 40.0, 3e5])
def test_hard_negatives_against_a_loop(spark, scale):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 6))
    rows = [(int(i), (scale * (centre[i % 4] + 0.7 * rng.normal(size=6))).round(2).tolist(), int(i % 4)) for i in range(320)]
    rows += [(400, None, 1), (500, [1.0, None], 1), (600, [float("nan")] * 6, 1), (700, [float("inf")] * 6, 2), (800, [0.0] * 6, 1), (900, [], 1), (1000, [1.0, 2.0], 3), (None, [1.0] * 6, 1), (1100, [1.0] * 6, None)]
    rows += [rows[100], rows[5], rows[5], (1200, [scale] * 6, 99)]
    want = plain_negatives(rows)
    assert len(want) > 50 and mined(spark, rows, group=3) == want
    assert hardneg.Fields(6, int(256 * 6 * scale)).plain == (scale < 1e5)


def test_hard_negatives_of_hot_labels_ties_and_few_rows(spark):
    rows = [(i, [1.0, 2.0], 1) for i in range(0, 300)] + [(1000 + i, [0.5, 0.5], 2) for i in range(30)]
    assert mined(spark, rows, slab_bytes=400) == plain_negatives(rows)
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == [] and mined(spark, [(100, None, 1)]) == []
    assert mined(spark, [(100, [], 1), (1, [], 1), (2, [], 2)]) == [(100, 1, 1, 2, 0, 0)]
    with pytest.raises(ValueError, match="long"):
        mined(spark, [(100, [1e12] * 4, 1), (1, [1.0] * 4, 1)])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 1 << 30), st.integers(1, 9), st.integers(1, 4), st.randoms())
def test_packed_products_are_exact(length, bias, n, q, random):
    fields = hardneg.Fields(length, bias)
    make = lambda k: np.array([[random.randint(-bias, bias) for _ in range(length)] for _ in range(k)], np.int64).reshape(k, length)
    c, a = make(n), make(q)
    packed = fields.from_bytes(fields.to_bytes(fields.pack(c)))
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in a] for r in c]
    assert fields.scores(packed, c.sum(axis=1), a).tolist() == want and (fields.fields >= 1)


# ---- 13


def test_token_files_hold_the_librarys_ids(spark):
    rows = [*((100 - i, t) for i, t in enumerate(TEXTS)), (50, "shared id"), (50, "shared id"), (50, None), (None, "no id")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("x"), "OFFSET": F.lit(1), "_row": F.lit(2), "_Text": F.lit(3)})
    path = new_path(spark, "tokens")
    tokenfiles.write(d.repartition(5), path, WORDS)
    files = sorted(tokenfiles.read(spark, path).collect(), key=lambda r: (r.part, r.offset))
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*tokenizer_of["word"].encode(t or "", add_special_tokens=False).ids, 1])
    order = [r.doc_id for r in files]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    got = {}
    for r in files:
        got.setdefault(r.doc_id, []).append(r.ids)
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    corpus = [i for r in files for i in r.ids]
    found = sorted(tokenfiles.digest(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r, f in zip(found, files, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (f.doc_id, at, len(f.ids), zlib.crc32(np.array(f.ids, "<u4").tobytes()))
        at += len(f.ids)
    for a, b in ((0, 10), (5, 2000), (at - 3, at + 9), (at, at + 5), (7, 7)):
        part = sorted(tokenfiles.tokens(spark, path, a, b).collect(), key=lambda r: r["at"])
        assert [i for r in part for i in r.ids] == corpus[a:b]
    listing = tokenfiles.directory(spark, path).collect()
    assert sum(r.n_docs for r in listing) == len(rows) and sum(r.n_tokens for r in listing) == at


def test_token_files_of_no_rows(spark):
    assert tokenfiles.round_trip(docs_of(spark, ["a"]).limit(0), WORDS).count() == 0


def rows_read(df) -> int:
    """Rows that the scan of a plan without a shuffle hands on."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_token_files_are_pruned_and_read_by_stripes(spark):
    import pyarrow.orc as orc

    rng = np.random.default_rng(0)
    d = spark.createDataFrame([(2 * i, " ".join(f"w{x}" for x in rng.integers(0, 999, 40))) for i in range(12_000)], "doc_id long, text string").coalesce(1)
    path = new_path(spark, "tokens")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        tokenfiles.write(d, path, WORDS, stripe_bytes=1 << 18)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    names = [r[0].removeprefix("file:") for r in spark.read.orc(path).select("_metadata.file_path").distinct().collect()]
    assert sum(orc.ORCFile(n.removeprefix("//")).nstripes for n in names) > len(names)
    assert "doc_id" in tokenfiles.find(spark, path, [10])._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert tokenfiles.find(spark, path, [8_000]).count() == 1
    assert 0 < rows_read(tokenfiles.find(spark, path, [8_000])) <= 2 * tokenfiles.STRIDE  # by the row index
    assert rows_read(tokenfiles.find(spark, path, [8_001])) == 0  # within the range of the index, not in the Bloom filter
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        sizes = tokenfiles.read(spark, path).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(sizes) > len(names) and sum(r["count"] for r in sizes) == 12_000
