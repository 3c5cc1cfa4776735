"""Sequences as text for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import Alphabet, alphabet


def to_text(s: Column) -> Column:
    return s


def wrapped(s: Column, width: int = 0) -> Column:
    """Lines of ``width`` symbols; below 1 one line."""
    return s if width < 1 else F.regexp_replace(s, "(.{%d})(?=.)" % width, "$1\n")


def shown(s: Column, width: int = 80) -> Column:
    """One line of at most about ``width`` symbols, the middle left out."""
    half = max(1, width // 2 - 1)
    short = F.concat(F.left(s, F.lit(half)), F.lit("…"), F.right(s, F.lit(half)))
    return F.when(F.length(s) == 0, "< EMPTY SEQUENCE >").when(F.length(s) > width, short).otherwise(s)


def summary(s: Column, a: Alphabet | str = "DNA4") -> Column:
    """Length and kind, like '12nt DNA Sequence'."""
    family = alphabet(a).family
    kind = {"DNA": "nt DNA Sequence", "RNA": "nt RNA Sequence"}.get(family, "aa Amino Acid Sequence")
    return F.concat(F.length(s).cast("string"), F.lit(kind))


def described(s: Column, a: Alphabet | str = "DNA4", width: int = 80) -> Column:
    return F.concat(summary(s, a), F.lit(":\n"), shown(s, width))
