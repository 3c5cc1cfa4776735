"""Benchmark decontamination by an FM-index of each training shard.

A shard is a run of documents of one Spark task, up to ``SHARD_WORDS`` words.
Its words become symbols; a word that no test phrase holds can be part of no
occurrence, so runs of them shrink to a separator, and stretches between
separators that are shorter than the shortest phrase go as well. Over the rest
the task builds a suffix array, the Burrows-Wheeler transform and its wavelet
matrix. All phrases are searched backward at once through the wavelet ranks.
Occurrences are located by walking back to the nearest sampled suffix position
(each ``SAMPLE``-th word of a stretch and each stretch's first), and overlapping
ones merge into removal spans.

Documents are not shuffled. The phrases are sent to the tasks in blocks of about
``BLOCK_WINDOWS``; a larger benchmark makes further passes. Long items are cut into pieces that
overlap by a window less a word, so one item may be spread over several blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_bytes

WINDOW, SHARD_WORDS, SAMPLE = 10, 1_500_000, 8
#: Windows that are sent to the tasks at once, and words in a piece of an item.
BLOCK_WINDOWS, PIECE = 1_000_000, 8192
#: Lower-cases A-Z, keeps digits, a-z and all of U+0080 and above; the rest separates words.
WORD_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD_RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


@dataclass
class Phrases:
    """Test phrases as rows of symbols (from 2 up; 0 ends the text, 1 separates).

    ``owners[first[p] : first[p + 1]]`` are the numbers of the items that hold phrase p. But for the
    vocabulary all is arrays: 4 * window bytes a phrase.
    """

    items: list[str]
    vocabulary: Vocabulary
    symbols: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, bytes]], window: int = WINDOW) -> Phrases:
        items = sorted({i for i, _ in rows})
        number, vocabulary = {x: k for k, x in enumerate(items)}, Vocabulary()
        parts, who = [], []
        for item, text in rows:
            # a word gets the next number when it is first seen
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 2) for w in words_of(text)], np.int32)
            if len(ids):
                short = np.zeros((1, window), np.int32)
                short[0, : len(ids)] = ids[:window]
                parts.append(np.lib.stride_tricks.sliding_window_view(ids, window) if len(ids) >= window else short)
                who.append(np.full(len(parts[-1]), number[item], np.int32))
        every = np.concatenate(parts) if parts else np.zeros((0, window), np.int32)
        symbols, which = np.unique(every, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate([*who, np.zeros(0, np.int32)])]), axis=1).astype(np.int64)
        first = np.append(0, np.cumsum(np.bincount(pairs[0], minlength=len(symbols))))
        return cls(items, vocabulary, symbols, (symbols > 0).sum(1), first, pairs[1])

    def holders(self, phrase: int) -> list[int]:
        return self.owners[self.first[phrase] : self.first[phrase + 1]].tolist()


def suffix_array(s: np.ndarray, most: int) -> np.ndarray:
    """Positions of ``s`` by suffix, by prefix doubling; only groups still tied are sorted again.

    Symbols are in [0, most]; past the end counts as 0.
    """
    n, bits = len(s), max(1, int(most).bit_length())
    h = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(h):
        key <<= bits
        key[: max(0, n - j)] |= s[j:]
    sa = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = start
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied) and h < n:
        act = sa[tied]
        ahead = np.where(act + h < n, rank[np.minimum(act + h, n - 1)] + 1, 0)
        pair = rank[act] * (n + 1) + ahead
        order = np.argsort(pair)
        act, pair = act[order], pair[order]
        sa[tied] = act
        new = np.ones(len(act), bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[act] = tied[np.maximum.accumulate(np.where(new, np.arange(len(act)), 0))]
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


class WaveletMatrix:
    """Rank of any symbol in any prefix, a bit vector with prefix counts for each bit."""

    def __init__(self, s: np.ndarray, most: int):
        self.bits = max(1, int(most).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level) & 1
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """Number of ``c[i]`` before each of ``ends[.][i]``."""
        begin, places = np.zeros(len(c), np.int64), [e.astype(np.int64) for e in ends]
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = (c >> (self.bits - 1 - k)) & 1 == 1
            for x in (begin, *places):
                up = ones[x]
                x[:] = np.where(one, zeros + up, x - up)
        return [x - begin for x in places]


class FMIndex:
    """Of stretches of symbols, each behind a separator; ``at[i]`` is the outer place of text place i."""

    def __init__(self, symbols: np.ndarray, at: np.ndarray, most: int, sample: int = SAMPLE):
        n, gap = len(symbols), symbols == 1
        # For sorting, separators are symbols of their own, in order of place: no comparison passes one.
        gaps = int(gap.sum())
        wide = np.where(gap, np.cumsum(gap), np.where(symbols == 0, 0, symbols + gaps))
        sa = suffix_array(wide, most + gaps)
        self.bwt, self.at = symbols[sa - 1], at
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=most + 1))])
        self.wavelet = WaveletMatrix(self.bwt, most)
        place = np.arange(n)
        from_gap = place - np.maximum.accumulate(np.where(gap, place, 0)) - 1
        self.sampled = ((from_gap % sample == 0) | gap | (symbols == 0))[sa]
        self.nth, self.position = np.cumsum(self.sampled) - 1, sa[self.sampled]

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur and their rows [lo, hi)."""
        live = np.arange(len(lengths))
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), len(self.bwt), np.int64)
        for step in range(int(lengths.max(initial=0))):
            going = live[lengths[live] > step]
            c = symbols[going, lengths[going] - 1 - step]
            a, b = self.wavelet.rank(c, lo[going], hi[going])
            lo[going], hi[going] = self.first[c] + a, self.first[c] + b
            live = live[hi[live] > lo[live]]
        return live, lo[live], hi[live]

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of each range its range's number and its outer place."""
        which = np.repeat(np.arange(len(lo)), hi - lo)
        row = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        found, walk, todo = np.empty(len(row), np.int64), 0, np.arange(len(row))
        while len(todo):
            done = self.sampled[row]
            found[todo[done]] = self.position[self.nth[row[done]]] + walk
            todo, row = todo[~done], row[~done]
            c = self.bwt[row]
            row = self.first[c] + self.wavelet.rank(c, row)[0]
            walk += 1
        return which, self.at[found]


def stretches(symbols: np.ndarray, ends: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Text for the index (separated stretches of known words, 0 at the end) and each place's word."""
    known = symbols > 0
    first = known.copy()
    first[1:] &= ~known[:-1]
    first[ends[(ends > 0) & (ends < len(symbols))]] = True
    first &= known
    begin = np.flatnonzero(first)
    number = np.cumsum(first) - 1
    size = np.bincount(number[known], minlength=len(begin)) if len(begin) else np.zeros(0, np.int64)
    keep = size >= shortest
    chosen = np.flatnonzero(known & keep[np.maximum(number, 0)]) if len(begin) else np.zeros(0, np.int64)
    if not len(chosen):
        return np.zeros(0, np.int64), chosen
    lead = np.flatnonzero(first[chosen])
    return np.append(np.insert(symbols[chosen], lead, 1), 0), np.append(np.insert(chosen, lead, -1), -1)


def scan(texts: list[bytes], phrases: Phrases) -> tuple[list[int], np.ndarray, list[list[int]]]:
    """Number of words and items of each text, and for all words in a row whether they are hit."""
    parts, counts = [], []
    look = phrases.vocabulary.__getitem__
    for t in texts:
        words = words_of(t)
        counts.append(len(words))
        parts.append(np.fromiter(map(look, words), np.int64, len(words)))
    ends = np.cumsum(counts)
    symbols = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    items: list[list[int]] = [[] for _ in texts]
    hit = np.zeros(len(symbols) + 1, np.int64)
    if len(phrases.lengths) and len(symbols):
        text, at = stretches(symbols, ends, int(phrases.lengths.min()))
        if len(text):
            index = FMIndex(text, at, len(phrases.vocabulary) + 1)
            live, lo, hi = index.search(phrases.symbols, phrases.lengths)
            which, place = index.locate(lo, hi)
            np.add.at(hit, place, 1)
            np.add.at(hit, place + phrases.lengths[live[which]], -1)
            doc = np.searchsorted(ends, place, side="right")
            for d, p in np.unique(np.stack([doc, live[which]], 1), axis=0).tolist() if len(doc) else []:
                items[d] += phrases.holders(p)
    return counts, np.cumsum(hit)[:-1] > 0, [sorted(set(x)) for x in items]


def spans_of(hit: np.ndarray) -> np.ndarray:
    """Runs of hit words as (first, end) rows."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def shards(batches: Iterator[pa.RecordBatch], text: str, words: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of each batch in runs of about ``words`` words (of six bytes)."""
    for batch in batches:
        column = batch.column(text)
        size, start = 0, 0
        lengths = pc.binary_length(column).to_pylist()
        for k, n in enumerate(lengths):
            size += n
            if size >= 6 * words or k == len(lengths) - 1:
                yield batch.slice(start, k + 1 - start), [x or b"" for x in column.slice(start, k + 1 - start).to_pylist()]
                size, start = 0, k + 1


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int, piece: int = PIECE) -> Iterator[list[tuple[str, bytes]]]:
    """(item, words) of the pieces of each block, which has about ``most`` windows."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                starts = range(0, max(len(words) - window + 1, 1), piece) if words else ()
                parts = [words[k : k + piece + window - 1] for k in starts]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array([b" ".join(p) for p in parts], pa.binary()), pa.array([max(len(p) - window + 1, 1) for p in parts], pa.int64())], names=["item", "words", "n"])

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text_bytes(text_col).alias("text"))
    # repeated pieces, as of repeated rows, count once
    pieces = cut(rows.mapInArrow(split, "item string, words binary, n long").dropDuplicates(["item", "words"]))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = -(-5 * total // (4 * most)) if total > most else 1
    for b in range(blocks):
        yield [(r["item"], bytes(r["words"])) for r in pieces.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).select("item", "words").collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_windows: int = BLOCK_WINDOWS, keep: tuple[str, ...] = ("doc_id",), carry_text: bool = False) -> DataFrame:
    """Columns ``keep`` of each row of ``docs`` with its words, removal spans and items.

    Adds n_words, spans (array of struct first, end: merged runs of hit words,
    counted from 0, end exclusive) and items (item ids as strings, sorted).
    ``carry_text`` adds clean_text: the text without its spans, searched again
    until no phrase of the block is left; a span leaves its place empty, and what stands before
    and after it stays. Null or empty text: no words, no spans. Null benchmark texts
    have no phrases; a null item id counts as the id ''. Repeated benchmark rows
    count once; repeated documents are rows of their own. With an empty benchmark
    nothing is hit. Names of other columns don't matter.
    """
    spark = docs.sparkSession
    out = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), text_bytes(text_col).alias("text"))
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.expr("cast(array() as array<struct<first: long, end: long>>)"), "items": F.expr("cast(array() as array<string>)"), "clean": F.col("text") if carry_text else F.lit(None).cast("binary")})
    schema = out.schema
    for rows in benchmark_blocks(benchmark, bench_id, bench_text, window, block_windows):
        shared = spark.sparkContext.broadcast(Phrases.of(rows, window))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for batch, texts in shards(batches, "text", shard_words):
                counts, hit, items = scan(texts, phrases)
                ends = np.cumsum(counts)
                marked = np.logical_or.reduceat(np.append(hit, False), np.minimum(ends - counts, len(hit))) & (np.array(counts) > 0) if counts else []
                old_hits, old_items = batch.column("hits"), batch.column("items")
                new_hits, new_items = old_hits.to_pylist(), old_items.to_pylist()
                for d in np.flatnonzero(marked):
                    flags = hit[ends[d] - counts[d] : ends[d]].copy()
                    for s in new_hits[d]:
                        flags[s["first"] : s["end"]] = True
                    new_hits[d] = [{"first": int(a), "end": int(b)} for a, b in spans_of(flags)]
                    new_items[d] = sorted({*new_items[d], *(phrases.items[i] for i in items[d])})
                columns = {"kept": batch.column("kept"), "text": batch.column("text"), "n_words": pa.array(counts, pa.int64()), "hits": pa.array(new_hits, old_hits.type), "items": pa.array(new_items, old_items.type)}
                columns["clean"] = batch.column("clean")
                if carry_text:
                    clean = batch.column("clean").to_pylist()
                    columns["clean"] = pa.array(cleaned(clean, phrases, [d for d, t in enumerate(texts) if marked[d] or clean[d] != t]), pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        out = out.mapInArrow(search, schema)
    names = [F.col("kept")[c].alias(c) for c in keep]
    return out.select(*names, "n_words", F.col("hits").alias("spans"), "items", *([F.col("clean").cast("string").alias("clean_text")] if carry_text else []))


def cleaned(texts: list[bytes], phrases: Phrases, todo: list[int]) -> list[bytes]:
    """The texts, those in ``todo`` without their hit words; what changed is searched again."""
    out = list(texts)
    while todo:
        counts, hit, _ = scan([out[d] for d in todo], phrases)
        at, again = 0, []
        for d, n in zip(todo, counts, strict=True):
            flags, at = hit[at : at + n], at + n
            if flags.any():
                places = [m.span() for m in WORD_RUN.finditer(out[d])]
                text, end = [], 0
                for a, b in spans_of(flags):
                    text.append(out[d][end : places[a][0]])
                    end = places[b - 1][1]
                out[d] = b"".join([*text, out[d][end:]])
                again.append(d)
        todo = again
    return out


def op6(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))

