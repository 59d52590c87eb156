"""Secret scan: keyword prefilter, anchored expressions near hits, checksums.

An Aho-Corasick automaton finds the keywords of all kinds in one pass over the
whole text; each kind's expression is tried only at those places. Long runs of
hex digits, which have no keyword, are found by a byte search for 32 digits in
a copy of the text that marks digits. Kinds that embed a CRC-32 in base 62 are
kept only if it is right.

Spans are code points of the text, end exclusive, by start and then in the
order of ``KINDS``. Null and empty texts have no spans. Repeated rows give equal
rows, ties cannot occur within a kind. Very long texts are scanned whole. Empty
tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.common import frugal, to_bytes

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
WORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_MARK = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_LOWER = bytes(range(256)).lower()

SPANS_DDL = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def checksum(body: bytes) -> bytes:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d : d + 1] + out
    return out


def automaton():
    a = ahocorasick.Automaton()
    for w, kind in WORDS.items():
        a.add_word(w, (len(w), kind))
    a.make_automaton()
    return a


def spans_of(text: str | None, words) -> list[tuple[str, int, int]]:
    raw = to_bytes(text)
    found = []
    hits = sorted((end - n + 1, kind) for end, (n, kind) in words.iter(raw.translate(_LOWER).decode("latin-1")))
    after = dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at < after[kind]:
            continue
        m = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}[kind].match(raw, at)
        if not m:
            continue
        after[kind] = m.end()
        good = {"assign": lambda: len(m[2]) >= MIN_ASSIGN, "access": lambda: len(m[0]) >= MIN_ACCESS}.get(kind, lambda: checksum(m[1]) == m[2])()
        if good:
            found.append((m.start(), KINDS.index(kind), m.end()))
    marks, at = raw.translate(_MARK), 0
    while (at := marks.find(b"x" * MIN_HEX, at)) >= 0:
        end = marks.find(b" ", at)
        end = len(marks) if end < 0 else end
        found.append((at, KINDS.index("hex"), end))
        at = end
    found.sort()
    if not found or raw.isascii():
        return [(KINDS[k], a, z) for a, k, z in found]
    place, chars, seen = {}, 0, 0
    for p in sorted({p for a, _, z in found for p in (a, z)}):
        chars += len(raw[seen:p].decode("utf-8"))
        place[p], seen = chars, p
    return [(KINDS[k], place[a], place[z]) for a, k, z in found]


def _redacted(text: str, spans, mask: str) -> str:
    out, at = [], 0
    for _, a, z in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, z)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, mask: str | None = None) -> DataFrame:
    """``docs`` with ``spans``; with ``mask``, the spans of ``text`` (overlapping
    ones as one) are replaced by it instead, and no column is added."""
    kept = [c for c in docs.columns if c != "spans"]
    if len(kept) < len(docs.columns):
        docs = docs.select(*kept)

    def run(batches):
        words = automaton()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = [spans_of(t, words) for t in texts]
            t = pa.Table.from_batches([batch])
            if mask is None:
                value = pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x] for x in spans], pa.list_(_SPAN))
                t = t.append_column("spans", value)
            else:
                value = [_redacted(x, s, mask) if s else x for x, s in zip(texts, spans)]
                t = t.set_column(t.schema.get_field_index("text"), "text", pa.array(value, pa.string()))
            yield from t.to_batches()

    schema = docs.schema if mask is not None else docs.withColumn("spans", F.lit(None).cast(SPANS_DDL)).schema
    return docs.mapInArrow(frugal(run), schema)


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
