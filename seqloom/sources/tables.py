"""Sequence tables: Parquet in and out with alphabets in the schema, and sequences from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet, alphabet
from ..functions.parse import keep_symbols, parse, try_parse, with_alphabet


def read_sequences(spark: SparkSession, path: str, columns: dict[str, Alphabet | str], strict: bool = True) -> DataFrame:
    """A Parquet table whose named text columns are sequences, checked as they are read; ``strict`` off gives nulls."""
    df = spark.read.parquet(path)
    check = parse if strict else try_parse
    return df.select(*[with_alphabet(check(F.col(c), columns[c]), c, columns[c]) if c in columns else F.col(c) for c in df.columns])


def write_sequences(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet keeps the columns' metadata, and with them the alphabets."""
    df.write.mode(mode).parquet(path)


def from_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences derived from texts: what of each text is a symbol. id, dna2, dna4, rna2, aa, cds."""
    text = F.col(text_col)
    two = keep_symbols(text, "DNA2")
    out = docs.select(F.col(id_col), two.alias("dna2"), keep_symbols(text, "DNA4").alias("dna4"), keep_symbols(text, "AA").alias("aa"))
    size = (3 * F.floor(F.length("dna2") / 3)).cast("int")
    return out.select(id_col, with_alphabet(F.col("dna2"), "dna2", "DNA2"), with_alphabet(F.col("dna4"), "dna4", "DNA4"), with_alphabet(F.translate("dna2", "T", "U"), "rna2", "RNA2"), with_alphabet(F.col("aa"), "aa", "AA"), with_alphabet(F.substring(F.col("dna2"), F.lit(1), size), "cds", "DNA2"))


def register_alphabet_column(df: DataFrame, name: str, a: Alphabet | str) -> DataFrame:
    return df.withColumn(name, with_alphabet(F.col(name), name, alphabet(a)))
