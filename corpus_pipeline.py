"""A training corpus from raw documents, stage by stage; see README.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
All but the last return the columns of ``docs``, whatever further ones it has.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontamination, mixing, near_copies, sharding, toxicity
from seqloom.llm.common import delete, shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels of those in ``docs``, finds toxic go."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "text")
    scored = toxicity.score(rows, toxicity.train(docs, table(spark, sf_dir, "labels")), keep=("row",))
    return scored.filter(F.col("p_toxic") < 0.5).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, the one with the least doc_id."""
    return near_copies.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a text that holds nothing else goes."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row"), F.col("text").isNull().alias("none"), "text")
    found = decontamination.decontaminate(rows, table(spark, sf_dir, "benchmark"), keep=("row", "none"), carry_text=True)
    changed = F.size("spans") > 0
    # cutting may join words to a further passage, so what is left is looked at, not what was hit at first
    found = found.filter(~changed | F.col("clean_text").rlike(decontamination.WORD))
    new = {"text": F.when(~F.col("none"), F.col("clean_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("clean_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col("row")[c] if c != "text" else None).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportions of their weights: documents are taken, repeated or left."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "doc_id", "text", "source")
    return mixing.mix_sources(rows).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it."""
    own = ("doc_id", "size", "text_crc32", "shard", "slot")
    return sharding.shard_documents(docs, keep=tuple(c for c in docs.columns if c not in own))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]
#: A fitted model, XXH64 fingerprints and seeded random splits are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written, so that the next reads them once made.

    A stage's rows are deleted when the next one's are written; the last but one's stay for the result.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
