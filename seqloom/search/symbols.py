"""First, last, next and previous symbol of a kind, as a place or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet, alphabet, one_of, sequence, symbols_of
from ..functions.edit import checked
from .common import col

KINDS = ("gap", "ambiguous", "certain", "gc")


def regex_of(what: str, a: Alphabet | str = "DNA4", negate: bool = False) -> str:
    """Class of the symbols of a kind, or of one symbol; a symbol that the alphabet lacks is never found."""
    a = alphabet(a)
    picked = getattr(a, what) if what in KINDS else "".join(c for c in a.symbols if c == what)
    return one_of("".join(c for c in a.symbols if (c in picked) != negate))


def find_next(s: Column, what: str, start: Column | int, a: Alphabet | str = "DNA4", negate: bool = False) -> Column:
    """First place from ``start`` on; null beyond the end, an error before 1."""
    start = col(start)
    at = F.regexp_instr(F.substring(s, start, F.length(s)), F.lit(regex_of(what, a, negate)))
    return checked(start >= 1, F.when((start <= F.length(s)) & (at > 0), at + start - 1), "BoundsError: start", "int")


def find_first(s: Column, what: str, a: Alphabet | str = "DNA4", negate: bool = False) -> Column:
    return find_next(s, what, 1, a, negate)


def find_prev(s: Column, what: str, start: Column | int, a: Alphabet | str = "DNA4", negate: bool = False) -> Column:
    """Last place up to ``start``; null before 1, an error beyond the end."""
    start = col(start)
    at = F.regexp_instr(F.reverse(F.substring(s, F.lit(1), F.greatest(start, F.lit(0)))), F.lit(regex_of(what, a, negate)))
    return checked(start <= F.length(s), F.when((start >= 1) & (at > 0), start - at + 1), "BoundsError: start", "int")


def find_last(s: Column, what: str, a: Alphabet | str = "DNA4", negate: bool = False) -> Column:
    return find_prev(s, what, F.length(s), a, negate)


def find_all(s: Column, what: str, a: Alphabet | str = "DNA4", negate: bool = False) -> Column:
    """All places as an array."""
    rx = regex_of(what, a, negate)
    flags = F.split(F.regexp_replace(F.regexp_replace(s, rx, "\x01"), "[^\x01]", "\x00"), "")
    return F.when(F.length(s) > 0, F.filter(F.transform(flags, lambda c, i: F.when(c == "\x01", i + 1)), lambda i: i.isNotNull())).otherwise(F.when(s.isNotNull(), sequence(F.lit(0))))


def find_where(s: Column, test, start: Column | int = 1) -> Column:
    """First place from ``start`` on whose symbol passes a function of a symbol column; an error before place 1."""
    start = col(start)
    at = F.get(_where(F.substring(s, F.greatest(start, F.lit(1)), F.length(s)), test), F.lit(0))
    return checked(start >= 1, at + start - 1, "BoundsError: start", "int")


def find_last_where(s: Column, test, start: Column | int | None = None) -> Column:
    """Last place up to ``start`` (the last) whose symbol passes; an error beyond the end."""
    start = F.length(s) if start is None else col(start)
    at = F.array_max(_where(F.substring(s, F.lit(1), F.greatest(start, F.lit(0))), test))
    return checked(start <= F.length(s), at, "BoundsError: start", "int")


def find_all_where(s: Column, test) -> Column:
    """All places whose symbol passes, as an array."""
    return _where(s, test)


def _where(s: Column, test) -> Column:
    return F.filter(F.transform(symbols_of(s), lambda c, i: F.when(test(c), i + 1)), lambda i: i.isNotNull())
