"""Substring dedup by content-defined chunks of a gear rolling hash.

A gear hash of 16 bits runs over the UTF-8 bytes: shift left, add the byte's table
value, so it knows the last 16 bytes. Where its top bits are zero, and no such place
came within the ``LEAST`` bytes before, a chunk ends. That depends on nearby bytes
alone: after an insertion, boundaries are the old ones again. Chunks meet by their
digest, of which 96 bits are kept. A run is a row of neighbouring chunks that occur elsewhere, each two
neighbours as neighbours, so they share a source; runs of ``RUN`` characters at least are
shared, and of these all but the first occurrence may be removed.

Of most chunks, only half a digest is shuffled to count them, by partial sums. The digests that
occur again make a Bloom filter, built in segments by the tasks and bounded in
size, and only chunks that pass it travel with their places. If they are too many for the
filter, a join picks the same ones. A chunk that half the corpus holds is met by
its count in a join that Spark may split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, table, text_bytes

WINDOW, LEAST, MOST, CUT_BITS, RUN = 16, 12, 4096, 3, 80
#: Repeated digests up to which the filter is used, its bits for each (at least), and its segments.
FILTER_KEYS, FILTER_BITS, SEGMENTS = 1 << 23, 16, 1024
#: A random number of 16 bits for each byte, from a hash of the byte.
GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=2, key=b"gear").digest() for i in range(256)), "<u2")


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of the last 16 table values, each shifted by its age."""
    h, age = GEAR[data], 1
    while age < WINDOW:
        more = h.copy()
        more[age:] += h[:-age] << age
        h, age = more, 2 * age
    return h


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks, between characters, the last at the end of the data."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    places = np.flatnonzero(gear(data) >> (16 - CUT_BITS) == 0) + 1
    ends = places[np.diff(places, prepend=-LEAST) >= LEAST]
    ends = ends[(ends >= LEAST) & (ends < n)]
    ends = np.append(ends[(data[ends] & 0xC0) != 0x80], n)
    long = np.flatnonzero(np.diff(ends, prepend=0) > MOST)
    if len(long):  # cut what the hash leaves whole, at characters
        more = []
        for k in long:
            at = int(ends[k - 1]) if k else 0
            while ends[k] - at > MOST:
                at += MOST
                while (data[at] & 0xC0) == 0x80:
                    at -= 1
                more.append(at)
        ends = np.union1d(ends, more)
    return ends


def chunks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends in characters, and both halves of the digests, of a text's chunks."""
    data = np.frombuffer(text, np.uint8)
    ends = chunk_ends(data)
    digest = xxhash.xxh3_128_digest
    halves = np.frombuffer(b"".join(digest(text[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)) if len(ends) else b"", "<i8").reshape(-1, 2)
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return chars[ends], halves[:, 0], halves[:, 1]


def chunk_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each document: row, doc_id, ends, a and b (64 and further 32 bits of digests)."""
    kinds = (pa.int32(), pa.int64(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(ends, a, b.astype(np.int32)) for ends, a, b in (chunks(t.as_py()) for t in batch.column(2))]
            offsets = pa.array(np.append(0, np.cumsum([len(f[0]) for f in found])).astype(np.int32))
            whole = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*(f[i] for f in found), np.zeros(0, np.int64)]).astype(np.int64)).cast(t)) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *whole], names=["row", "doc_id", "ends", "a", "b"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, ends array<int>, a array<long>, b array<int>")


def filter_of(keys: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of ``n`` distinct longs (column a): a bit array and the bits in a segment.

    A key's top bits name its segment, so a task can build whole segments; two further parts of it
    name its bits there. All that reaches the driver are the segments' bits.
    """
    width = 1 << max(6, (n * FILTER_BITS // SEGMENTS).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            key = b.column(0).to_numpy().view(np.uint64)
            segment = (key >> np.uint64(54)).astype(np.int64)
            for s in np.unique(segment).tolist():
                bits = own.setdefault(s, np.zeros(width, np.uint8))
                for at in places_in(key[segment == s], width):
                    bits[at] = 1
        for s, bits in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["s", "bits"])

    dealt = keys.select("a").repartition(F.shiftrightunsigned("a", 54))
    out = np.zeros((SEGMENTS, width // 8), np.uint8)
    for r in dealt.mapInArrow(run, "s int, bits binary").collect():
        out[r["s"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.ravel(), width


def places_in(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Both places of each key in its segment."""
    mask = np.uint64(width - 1)
    return (key & mask).astype(np.int64), ((key >> np.uint64(27)) & mask).astype(np.int64)


def passes(key: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    """Which keys the filter may hold: all that it does, and few others."""
    key = key.view(np.uint64)
    base = (key >> np.uint64(54)).astype(np.int64) * width
    ok = np.ones(len(key), bool)
    for at in places_in(key, width):
        at = base + at
        ok &= bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
    return ok


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each chunk a hash of its digest and the next one's; the last chunk's is its own."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.int64).view(np.uint64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x[:-1] ^= (x[1:] << np.uint64(21)) | (x[1:] >> np.uint64(43))
    return x.view(np.int64)


def candidates(rows: DataFrame, again: DataFrame, most_keys: int) -> DataFrame:
    """row, doc_id, k, a, b, pair of the chunks whose half digest is in ``again``, and perhaps some more."""
    n = again.count()
    shared = rows.sparkSession.sparkContext.broadcast(filter_of(again, n) if n <= most_keys else None)
    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "k": pa.int32(), "a": pa.int64(), "b": pa.int32(), "pair": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.diff(batch.column("a").offsets.to_numpy())
            a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("a", "b"))
            which = np.repeat(np.arange(batch.num_rows), at)
            k = np.arange(len(a)) - np.repeat(np.cumsum(at) - at, at)
            pair = pair_keys(a.copy(), b)
            last = np.cumsum(at)[at > 0] - 1
            pair[last] = a[last]
            picked = np.flatnonzero(passes(a, *shared.value)) if shared.value else np.arange(len(a))
            own = pa.array(which[picked])
            columns = (batch.column("row").take(own), batch.column("doc_id").take(own), pa.array(k[picked], pa.int32()), *(pa.array(x[picked]) for x in (a, b, pair)))
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    found = rows.select("row", "doc_id", "a", "b").mapInArrow(run, "row long, doc_id long, k int, a long, b int, pair long")
    return found if n <= most_keys else found.join(again, "a", "left_semi")


def runs_of(places: list[int], tied: set[int], ends: list[int], least: int) -> list[list[int]]:
    """Runs of chunk numbers that cover ``least`` characters or more; k in ``tied``: k and k + 1 may stand in one."""
    out: list[list[int]] = []
    for k in places:
        if out and out[-1][-1] == k - 1 and k - 1 in tied:
            out[-1].append(k)
        else:
            out.append([k])
    return [r for r in out if ends[r[-1]] - (ends[r[0] - 1] if r[0] else 0) >= least]


def spans(row: dict, least: int) -> tuple[list[dict], list[dict], list[int]]:
    """Shared spans, spans to remove and the documents that hold their first occurrence."""
    met = sorted(row["met"] or [], key=lambda m: m["k"])
    by, ends = {m["k"]: m for m in met}, row["ends"]
    tied = {m["k"] for m in met if m["tied"]}

    def span(run: list[int]) -> dict:
        return {"start": ends[run[0] - 1] if run[0] else 0, "end": ends[run[-1]]}

    shared = runs_of(list(by), tied, ends, least)
    removed = [r for run in shared for r in runs_of([k for k in run if by[k]["later"]], tied, ends, least)]
    first = {by[k]["first"] for r in removed for k in r} - {None}
    return [span(r) for r in shared], [span(r) for r in removed], sorted(first)


def find_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """doc_id, n_chars, n_chunks, shared, removed, first_docs for each row of ``docs``.

    ``shared`` has all spans (characters, end exclusive) that also stand elsewhere, in
    another document or again in this one; ``removed`` those stretches of them, of ``run``
    characters at least, whose chunks all come after their first occurrence, which is the one of
    the least doc_id (null last), then the earliest place; ``first_docs`` the documents that hold
    it. Null and empty texts have no chunks. Repeated rows repeat each other; of rows with one
    doc_id and different texts either may be first. An empty table gives no rows; names of other
    columns don't matter.
    """
    rows = cut(chunk_rows(docs, id_col, text_col))
    scratch = Scratch()
    again = scratch.cut(rows.select(F.explode("a").alias("a")).groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"))
    met = cut(candidates(rows, again, filter_keys))
    scratch.drop()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "k")
    # written, so that both sides of the join are shuffled for it alone and Spark can split a frequent chunk's rows
    first = met.groupBy("a", "b").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = cut(first.select("a", "b", F.col("first.row").alias("first_row"), F.col("first.k").alias("first_k"), F.col("first.doc_id").alias("first_doc")))
    later = (F.col("first_row") != F.col("row")) | (F.col("first_k") != F.col("k"))
    # a pair occurs again only if both its chunks do, so the filter's extra chunks don't matter here
    tied = cut(met.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1").select("pair", F.lit(True).alias("tied")))
    met = met.join(first, ["a", "b"]).select("row", "k", "pair", later.alias("later"), "first_doc").join(tied, "pair", "left").select("row", F.struct("k", "later", F.coalesce("tied", F.lit(False)).alias("tied"), F.col("first_doc").alias("first")).alias("m"))
    by_row = met.groupBy("row").agg(F.collect_list("m").alias("met"))
    joined = rows.select("row", "doc_id", "ends").join(by_row, "row", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [spans(r, run) for r in batch.select(["ends", "met"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ends"), *[pa.array([f[i] for f in found], t) for i, t in enumerate((span, span, pa.list_(pa.int64())))]], names=["doc_id", "ends", "shared", "removed", "first_docs"])

    spans_type = "array<struct<start: long, end: long>>"
    out = joined.mapInArrow(finish, f"doc_id long, ends array<int>, shared {spans_type}, removed {spans_type}, first_docs array<long>")
    return out.select("doc_id", F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("n_chars"), F.size("ends").alias("n_chunks"), "shared", "removed", "first_docs")


def cut_spans(text, removed):
    """Column: ``text`` without the spans of column ``removed``."""
    last = F.get(removed, F.size(removed) - 1)["end"]
    kept = F.transform(removed, lambda s, i: F.substring(text, F.coalesce(F.get(removed, i - 1)["end"], F.lit(0)).cast("int") + 1, (s["start"] - F.coalesce(F.get(removed, i - 1)["end"], F.lit(0))).cast("int")))
    return F.when(F.size(removed) > 0, F.concat(F.array_join(kept, ""), F.substring(text, last.cast("int") + 1, F.length(text)))).otherwise(text)


def op4(spark, sf_dir: str) -> DataFrame:
    found = find_repeats(table(spark, sf_dir, "documents"))

    def total(c):
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])

    def text(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", "n_chars", "n_chunks", total("shared").alias("shared_chars"), total("removed").alias("removed_chars"), text("shared").alias("shared_spans"), text("removed").alias("removed_spans"), "first_docs")
