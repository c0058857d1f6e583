"""Operator 1: incremental secret scan over a ledger of content-addressed blobs.

Every version of a text is a blob, named by its SHA-256. A ledger (a Parquet table) holds a row for each
(blob, rule version) that was ever scanned, with its findings. A scan looks only at the blobs which have no
row for a rule version, appends their rows, and joins findings back to every document, path or version (`keep`).

Names come first: what the ledger lacks is found by 32-byte names, and bodies are read only where something is
missing. Bodies are shuffled only if more than `few` blobs are (fewer names are sent to where the bodies lie).
Two scans that run at once may both append a pair; readers take a pair once.

Defined cases: a null text is the empty text; an empty table gives no rows; repeated rows share one blob and
each get its findings; texts of any length are scanned whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, new_path, per_batch, stored

#: Kinds in the order in which spans with the same start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "private_key", "jwt", "forge_token", "key_block")
BASE = KINDS[:3]
#: Rule version -> the kinds that it scans for. A later version rescans every blob once.
RULES = {"base-1": BASE, "more-1": KINDS[3:6]}
#: What redact() scans for: private_key is the opening line alone, as the SQL has it; key_block is the whole key.
REDACTED = RULES | {"block-1": KINDS[6:]}

ASSIGN = re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Lower-case substrings of which any assignment has one: a cheap test before the pattern.
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# A run that is too short has no longer run inside it, so these may ask for the length at once.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----")
KEY_LINE = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?)-----")
#: What follows an opening line without its closing line: headers, base64 lines, and a shorter last line.
KEY_BODY = re.compile(r"""(?:\s|\\[nr]|[A-Za-z-]+:\x20[^\n]*\n)*(?:[A-Za-z0-9+/=]{16,}(?:["',;>#*+|]|\s|\\[nr])*)*(?:(?<=[\n])[A-Za-z0-9+/]{1,15}={0,2}(?=\s*?(?:\n|\Z)))?""")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
FORGE = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Places of private keys from BEGIN to the END line of the same name, or where that is missing to the last base64 line."""
    lines, out = list(KEY_LINE.finditer(text)), []
    for m, after in zip(lines, [*lines[1:], None]):
        if m[1] == "BEGIN":
            closed = after is not None and after[1] == "END" and after[2] == m[2]
            out.append((m.start(), after.end() if closed else KEY_BODY.match(text, m.end(), after.start() if after else len(text)).end()))
    return out


def find_spans(text: str, kinds: Iterable[str]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive; leftmost and non-overlapping within a kind."""
    found = []
    for kind in kinds:
        if kind == "assign":
            lower = text.lower()
            if any(hint in lower for hint in HINTS):
                # a value that is too short is consumed all the same
                found += [(kind, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        elif kind == "access":
            if "AKIA" in text:
                found += [(kind, *m.span()) for m in ACCESS.finditer(text)]
        elif kind == "hex":
            found += [(kind, *m.span()) for m in HEX.finditer(text)]
        elif kind == "private_key":
            if "PRIVATE KEY-----" in text:
                found += [(kind, *m.span()) for m in PRIVATE_KEY.finditer(text)]
        elif kind == "jwt":
            if ".eyJ" in text:
                found += [(kind, *m.span()) for m in JWT.finditer(text)]
        elif kind == "forge_token":
            if "gh" in text and "_" in text:
                found += [(kind, *m.span()) for m in FORGE.finditer(text)]
        elif kind == "key_block":
            if "PRIVATE KEY" in text:
                found += [(kind, *span) for span in key_blocks(text)]
        else:
            raise ValueError(f"unknown kind of secret: {kind}")
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def blob_id(text: str = "text"):
    """The name of a text's content; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def read_ledger(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _scanned(bodies: DataFrame, plan: dict[str, tuple[str, ...]]) -> DataFrame:
    """blob, version, spans of bodies (blob, body, need: the versions to scan for; null: all)."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            rows = zip(batch["blob"].to_pylist(), batch["body"].to_pylist(), batch["need"].to_pylist())
            got = [(b, v, joined(find_spans(t, kinds))) for b, t, need in rows for v, kinds in plan.items() if need is None or v in need]
            return {"blob": [r[0] for r in got], "version": [r[1] for r in got], "spans": [r[2] for r in got]}

        return work

    return per_batch(bodies.select("blob", "body", "need"), "blob binary, version string, spans string", make)


def scan(docs: DataFrame, ledger: str, rules: dict[str, Iterable[str]] = RULES, text: str = "text", few: int = 1_000_000) -> DataFrame:
    """Scan the blobs of docs that the ledger at this path lacks; append (blob, version, spans); return the whole ledger.

    A hot text is one row of each map task before it is shuffled, and is scanned once, for all versions that it lacks.
    """
    spark = docs.sparkSession
    plan = {version: tuple(kinds) for version, kinds in rules.items()}
    blobs = docs.select(blob_id(text).alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    known = read_ledger(spark, ledger)
    if known is None:
        todo = blobs.groupBy("blob").agg(F.first("body").alias("body")).withColumn("need", F.lit(None).cast("array<string>"))
    else:
        names = blobs.select("blob").distinct()
        wanted = names.select("blob", F.explode(F.array(*[F.lit(v) for v in plan])).alias("version"))
        lacking = wanted.join(known.select("blob", "version"), ["blob", "version"], "left_anti").groupBy("blob").agg(F.collect_set("version").alias("need"))
        lacking = stored(lacking)
        n = lacking.count()
        if not n:
            return known
        if n <= few:  # some 60 bytes each
            lacking = F.broadcast(lacking)
        todo = blobs.join(lacking, "blob").groupBy("blob").agg(F.first("body").alias("body"), F.first("need").alias("need"))
    _scanned(todo, plan).write.mode("append").parquet(ledger)
    return spark.read.parquet(ledger)


def _hits(ledger: DataFrame, rules: Iterable[str], blob: str, found: str) -> DataFrame:
    """All spans of each blob that has any, under the given names; a (blob, version) that was appended twice counts once."""
    # blobs without findings need no row: a row that finds no partner has none
    rows = ledger.filter((F.col("spans") != "") & F.col("version").isin(list(rules))).select("blob", "version", "spans").distinct()
    return rows.groupBy(F.col("blob").alias(blob)).agg(F.concat_ws(",", F.sort_array(F.collect_list("spans"))).alias(found))  # one span list a rule version


def findings(docs: DataFrame, ledger: str | None = None, rules: dict[str, Iterable[str]] = RULES, text: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row of docs, with base_spans and spans (kind:start:end, comma-joined; '' if none).

    Without a ledger a new one is made in the shared folder.
    """
    spark = docs.sparkSession
    seen = scan(docs, ledger or new_path(spark, "secret-ledger"), rules, text)
    blob, found = fresh_name("blob", keep), fresh_name("found", keep)
    both = docs.select(*keep, blob_id(text).alias(blob)).join(_hits(seen, rules, blob, found), blob, "left")
    # order of all spans by start, then kind, then end
    parts = F.filter(F.split(F.coalesce(found, F.lit("")), ","), lambda s: s != "")
    order = F.transform(
        parts,
        lambda s: F.struct(
            F.split(s, ":")[1].cast("int").alias("start"),
            F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.split(s, ":")[0]).alias("kind"),
            F.split(s, ":")[2].cast("int").alias("end"),
            s.alias("span"),
        ),
    )
    spans = F.transform(F.array_sort(order), lambda s: s["span"])
    is_base = lambda s: F.split(s, ":")[0].isin(list(BASE))
    return both.select(*keep, F.array_join(F.filter(spans, is_base), ",").alias("base_spans"), F.array_join(spans, ",").alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans."""
    n = lambda kind: F.size(F.filter(F.split("base_spans", ","), lambda s: s.startswith(f"{kind}:"))).cast("long")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


def cover(text: str, spans: str, mask: str) -> str:
    """The text with every span (kind:start:end, comma-joined) replaced by the mask, spans that overlap by one; linear in both."""
    bounds = sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(","))
    out, at = [], 0
    for a, b in bounds:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _masked(mask: str):
    @F.pandas_udf("string")
    def masked(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or f is None else cover(t, f, mask) for t, f in zip(texts, found)], dtype=object)

    return masked


def redact(docs: DataFrame, mask: str = "[SECRET]", ledger: str | None = None, most_bytes: int = 64_000_000) -> DataFrame:
    """docs with every span of its text replaced by the mask (overlapping spans by one), and n_chars to match.

    A private key is masked whole, with its body and closing line.

    A row's own text is changed where it lies: only names of blobs and their spans are joined.
    """
    spark = docs.sparkSession
    seen = scan(docs, ledger or new_path(spark, "secret-ledger"), REDACTED)
    names = docs.columns
    blob, found = fresh_name("blob", names), fresh_name("found", names)
    hits = stored(_hits(seen, REDACTED, blob, found))
    # where the findings are few, no text is moved; else a hot text's rows are split by the adaptive join
    size = hits.agg(F.sum(F.length(found) + 100)).first()[0] or 0
    joined_docs = docs.withColumn(blob, blob_id("text")).join(F.broadcast(hits) if size <= most_bytes else hits, blob, "left")
    # only texts with a finding go to Python
    done = _masked(mask)(F.when(F.col(found).isNotNull(), F.col("text").cast("string")), F.col(found))
    clean = F.when(F.col(found).isNull(), F.col("text")).otherwise(done)
    out = joined_docs.withColumn("text", clean)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*[F.col(f"`{c}`") for c in names])


def hex_digest(spans: str) -> str:
    """What digest() gives for joined base spans; for checks."""
    return hashlib.sha256(spans.encode()).hexdigest()
