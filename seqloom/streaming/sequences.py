"""Streaming counts over sequences: what needs state is a plain streaming aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.counting import gc_content
from ..functions.transform import canonical, reverse_complement
from ..operators.aggregates import sites


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def annotated(df: DataFrame, seq: str, a: str = "DNA4") -> DataFrame:
    """Reverse complement, canonical form and GC content; for tables and streams alike."""
    family = a[:3]
    return df.withColumns({"revcomp": reverse_complement(F.col(seq), family), "canonical": canonical(F.col(seq), a), "gc": gc_content(F.col(seq), a)})


def running_pfm(df: DataFrame, seq: str) -> DataFrame:
    """(pos, A, C, G, T) so far; for output mode complete or update. State is a row for each place."""
    return sites(df, seq).groupBy(F.col("site").alias("pos")).agg(*[F.count(F.when(F.col("sym") == c, 1)).alias(c) for c in "ACGT"])


def windowed_gc(df: DataFrame, seq: str, time: str, window: str, late: str) -> DataFrame:
    """Mean GC content by window of event time; rows later than ``late`` are dropped by the watermark."""
    scored = df.withWatermark(time, late).withColumn("gc", gc_content(F.col(seq)))
    return scored.groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.avg(F.when(~F.isnan("gc"), F.col("gc"))).alias("gc"))
