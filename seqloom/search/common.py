from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = "struct<start: int, stop: int>"


def span(start: Column, size: Column | int) -> Column:
    """start..start+size-1; stop is start-1 if empty."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.struct(start.cast("int").alias("start"), (start + size - 1).cast("int").alias("stop"))


def col(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


#: Stands in a copy of a text where a hit begins (and ends); no sequence has it.
MARK, END = "\x01", "\x02"


def places_of(mark: str, text: Column) -> Column:
    """Places (from 1) of a character in a text, as an array; one pass over the text."""
    found = F.transform(F.split(text, ""), lambda c, i: F.when(c == mark, i + 1))
    return F.filter(found, lambda i: i.isNotNull())
