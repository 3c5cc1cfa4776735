"""Hits as tables, and very long sequences in pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..search.exact import ExactQuery

CHUNK = 16_384


def hits_table(df: DataFrame, hits: Column, *keep: str) -> DataFrame:
    """A row for each hit of an array of ranges: the columns ``keep``, start, stop."""
    return df.select(*keep, F.explode(hits).alias("h")).select(*keep, "h.start", "h.stop")


def in_chunks(df: DataFrame, seq: str, overlap: int, *keep: str, chunk: int = CHUNK) -> DataFrame:
    """Sequences cut into pieces of ``chunk`` symbols and the next ``overlap``; ``offset`` is what stands before.

    Pieces are rows of their own, so one genome is worked on by many tasks.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0)), F.lit(chunk))
    return df.select(*keep, seq, F.explode(starts).alias("offset")).select(*keep, "offset", F.substring(F.col(seq), F.col("offset") + 1, F.lit(chunk + overlap)).alias(seq))


def find_all_long(df: DataFrame, seq: str, query: ExactQuery, *keep: str, chunk: int = CHUNK) -> DataFrame:
    """All hits, overlapping ones too, of sequences of any length: keep, start, stop.

    A piece reports the hits that begin in its own ``chunk`` symbols, so none comes twice.
    """
    pieces = in_chunks(df, seq, max(query.size - 1, 0), *keep, chunk=chunk)
    found = hits_table(pieces, query.find_all(F.col(seq)), *keep, "offset").filter(F.col("start") <= chunk)
    return found.select(*keep, (F.col("start") + F.col("offset")).alias("start"), (F.col("stop") + F.col("offset")).alias("stop"))


def spectrum(df: DataFrame, seq: str, k: int) -> DataFrame:
    """(kmer, n): how often each run of k symbols occurs."""
    # a look ahead at each place captures the run that begins there
    kmers = F.regexp_extract_all(F.col(seq), F.lit("(?=(.{%d}))" % k), F.lit(1))
    return df.select(F.explode(kmers).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def find_patterns(df: DataFrame, seq: str, patterns: list[str], *keep: str, comparator: str = "isequal", a: str = "DNA4") -> DataFrame:
    """Hits of several patterns: keep, pattern, start, stop. All are sought in one pass over the sequences."""
    found = F.array(*[F.struct(F.lit(p).alias("pattern"), ExactQuery(p, comparator, a).find_all(F.col(seq)).alias("hits")) for p in patterns])
    return df.select(*keep, F.explode(found).alias("x")).select(*keep, "x.pattern", F.explode("x.hits").alias("h")).select(*keep, "pattern", "h.start", "h.stop")
