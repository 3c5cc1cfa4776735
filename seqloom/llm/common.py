"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define words: everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``. Only a session in local mode, where
    driver and executors are one process, falls back to a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="seqloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Cuts frames and deletes their files as soon as a later cut holds all that is still needed."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def cut(self, df: DataFrame) -> DataFrame:
        out = cut(df)
        self.made.append(out)
        return out

    def drop(self, *but: DataFrame) -> None:
        """Deletes what was cut so far, but for some frames."""
        for df in self.made:
            if not any(df is x for x in but):
                file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
                if file.isDefined():
                    delete(df.sparkSession, file.get())
        self.made = list(but)


def text_bytes(col: str | Column) -> Column:
    """UTF-8 bytes of a text, null as empty: Python then needn't decode and encode."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def n_words(col: str | Column) -> Column:
    """Number of maximal runs of characters other than white space; null counts as none."""
    text = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
