"""Secret scans: Aho-Corasick keywords, anchored expressions near hits, embedded checksums.

One automaton pass over a text (A-Z lower-cased) finds all keywords. Only there
is the expression of the keyword's kind tried, anchored at the hit. Runs of hex
digits have no keyword: a run of 24 covers four neighbours of every sixth
character, so those samples are its prefilter. Kinds whose tokens carry
a checksum are reported only if it holds.

Texts are scanned as UTF-8 bytes, which any expression of ASCII characters may
be; offsets become code points at the end, for texts with a find. One row in,
one row out: no shuffle, and no more than a batch of texts in memory.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_bytes

# The three base kinds, their keywords and least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Tokens of 30 characters and the CRC-32 of these in six base-62 digits.
CHECKED = {"github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")), "npm": (("npm_",), re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"))}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", *CHECKED)
STRIDE = 6

IS_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))


@cache
def automaton() -> ahocorasick.Automaton:
    words = {w: "assign" for w in ASSIGN_WORDS} | {"akia": "access"} | {w: kind for kind, (keys, _) in CHECKED.items() for w in keys}
    out = ahocorasick.Automaton()
    for w, kind in words.items():
        out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def checksum(text: bytes) -> bytes:
    """CRC-32 in base 62, six digits."""
    value, out = zlib.crc32(text), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit : digit + 1] + out
    return out


def hex_runs(text: bytes) -> Iterator[tuple[int, int]]:
    """Maximal runs of at least ``LEAST_HEX`` lower-case hex digits."""
    need = LEAST_HEX // STRIDE
    sample = IS_HEX[np.frombuffer(text, np.uint8)[::STRIDE]]
    if len(sample) < need:
        return
    close = sample[: len(sample) - need + 1].copy()
    for k in range(1, need):
        close &= sample[k : len(sample) - need + 1 + k]
    end = 0
    for p in (np.flatnonzero(close) * STRIDE).tolist():
        if p >= end:
            start = p
            while start > end and IS_HEX[text[start - 1]]:
                start -= 1
            end = HEX.match(text, start).end()  # type: ignore[union-attr]
            if end - start >= LEAST_HEX:
                yield start, end


def byte_spans(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, in bytes."""
    out = [(a, b, "hex") for a, b in hex_runs(text)]
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in automaton().iter(text.lower().decode("latin-1")))
    behind = dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < behind[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                behind[kind] = m.end()
                if len(m[2]) >= LEAST_VALUE:
                    out.append((start, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                behind[kind] = m.end()
                if m.end() - start >= LEAST_ACCESS:
                    out.append((start, m.end(), kind))
        elif (m := CHECKED[kind][1].match(text, start)) and checksum(m[1]) == m[2]:
            behind[kind] = m.end()
            out.append((start, m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def secrets_in(text: bytes) -> list[dict]:
    """The secrets of a text as kind, start, end (code points, end exclusive)."""
    found = byte_spans(text)
    if not found:
        return []
    before = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    return [{"kind": k, "start": int(before[a]), "end": int(before[b])} for a, b, k in found]


def find_secrets(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of each row of ``docs`` and secrets: array of struct kind, start, end.

    By start, then by kind as in ``KINDS``. Null and empty texts have none.
    Repeated rows stay; an empty table gives no rows; names of other columns
    don't matter.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), text_bytes(text_col).alias("text"))
    schema = rows.select("kept").withColumn("secrets", F.expr("cast(array() as array<struct<kind: string, start: long, end: long>>)")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([secrets_in(t.as_py()) for t in b.column(1)], kind)], names=["kept", "secrets"])

    return rows.mapInArrow(run, schema).select(*[F.col("kept")[c].alias(c) for c in keep], "secrets")


def op5(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def joined(col):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
