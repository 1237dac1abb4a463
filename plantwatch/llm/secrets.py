"""Operator 3: secret scan.

An Aho-Corasick automaton finds keywords in one pass over the text; a regular expression is
tried only at a keyword, anchored there. Keys whose format carries a checksum are then
validated by it. Runs of hex digits have no keyword and are found by a scan of their own.

Base kinds (assign, access, hex) are the leftmost non-overlapping matches of their pattern,
short ones dropped. Checked kinds (github, npm) end in six base-62 digits of the CRC-32 of
what stands between prefix and checksum; a token whose checksum is wrong is not reported.

Defined results: a null or empty text has no secrets; repeated rows are scanned each; null ids
stay null; an empty table gives no rows. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from plantwatch.llm.arrow import map_arrow, texts

# The base patterns and the least lengths of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
# Prefixes of tokens whose last six characters are a checksum.
GITHUB_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
NPM_PREFIX = "npm_"
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
Span = tuple[int, int, str]


def checksum62(body: str) -> str:
    """Six base-62 digits of the CRC-32 of a text."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for word in (*GITHUB_PREFIXES, NPM_PREFIX):
        found.add_word(word, ("npm" if word == NPM_PREFIX else "github", 4))
    found.make_automaton()
    return found


def scan(text: str, keywords) -> list[Span]:
    """All spans of a whole text as (start, end, kind), by start, then in the order of KINDS."""
    low = text.lower()
    if len(low) != len(text):  # one letter becomes two in lower case; offsets must stay
        low = text.replace("İ", "\0").lower()
    out: list[Span] = []
    free = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in keywords.iter(low):
        at = last + 1 - length
        if at < free[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                free[kind] = m.end()
                if len(m[2]) >= LEAST_VALUE:
                    out.append((at, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                free[kind] = m.end()
                if m.end() - at >= LEAST_ACCESS:
                    out.append((at, m.end(), kind))
        elif (m := CHECKED.match(text, at)) and checksum62(m[1]) == m[2]:
            free[kind] = m.end()
            out.append((at, m.end(), kind))
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every secret replaced by a mark; overlapping spans are one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind} removed]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, its secrets as a list of structs, and a digest of the base kinds."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        keywords = automaton()
        for b in batches:
            found = [scan(t, keywords) for i in range(0, b.num_rows, 256) for t in texts(b.column(text_col).slice(i, 256))]
            base = [hashlib.sha256(joined([s for s in x if s[2] in BASE_KINDS]).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in x] for x in found], SPANS),
                 pa.array(base, pa.string())], names=[id_col, "secrets", "base_sha256"])

    return map_arrow(docs.select(id_col, text_col), run,
                     f"`{id_col}` {kind}, secrets array<struct<kind:string,start:bigint,end:bigint>>, base_sha256 string")


def remove_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, with secrets in the text replaced and its length brought up to date."""

    def run(batches):
        keywords = automaton()
        for b in batches:
            new = []
            for i in range(0, b.num_rows, 256):
                for t in b.column(text_col).slice(i, 256).to_pylist():
                    new.append(redact(t, s) if t and (s := scan(t, keywords)) else t)
            columns = dict(zip(b.schema.names, b.columns))
            columns[text_col] = pa.array(new, b.column(text_col).type)
            if length_col in columns:
                was = columns[length_col]
                columns[length_col] = pa.array([None if t is None else len(t) for t in new], was.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return map_arrow(docs, run, docs.schema)
