"""Exact search: equal symbols, or compatible ones (their bit sets meet)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet, alphabet, escape, one_of, sequence
from .common import MARK, RANGE, col, places_of, span


class ExactQuery:
    """A pattern, checked against the alphabet when made.

    ``comparator`` is 'isequal' or 'iscompatible'. With the latter each pattern
    symbol becomes the class of symbols it is compatible with, a gap one that
    nothing matches.
    """

    def __init__(self, pattern: str, comparator: str = "isequal", a: Alphabet | str = "DNA4"):
        self.alphabet = alphabet(a)
        if comparator not in ("isequal", "iscompatible"):
            raise ValueError("comparator is isequal or iscompatible")
        if any(c not in self.alphabet for c in pattern):
            raise TypeError(f"the pattern is not of {self.alphabet.name}")
        self.pattern, self.size, self.comparator = pattern, len(pattern), comparator
        if comparator == "isequal":
            parts = [escape(c) for c in pattern]
        else:
            parts = [one_of(self.alphabet.where(lambda b, c=c: b & self.alphabet.compat(c) != 0)) for c in pattern]
        self.regex, self.backward = "".join(parts), "".join(reversed(parts))

    def find_next(self, s: Column, start: Column | int) -> Column:
        """The first hit from ``start`` on (at least 1)."""
        start = F.greatest(col(start), F.lit(1))
        if not self.size:
            return F.when(start - 1 <= F.length(s), span(start, 0))
        at = F.regexp_instr(F.substring(s, start, F.length(s)), F.lit(self.regex))
        return F.when((start <= F.length(s)) & (at > 0), span(at + start - 1, self.size))

    def find_first(self, s: Column) -> Column:
        return self.find_next(s, 1)

    def find_prev(self, s: Column, start: Column | int) -> Column:
        """The last hit that ends at ``start`` (at most the length) or before."""
        end = F.least(col(start), F.length(s))
        if not self.size:
            return F.when(end >= 0, span(end + 1, 0))
        at = F.regexp_instr(F.reverse(F.substring(s, F.lit(1), F.greatest(end, F.lit(0)))), F.lit(self.backward))
        return F.when(at > 0, span(end - at - self.size + 2, self.size))

    def find_last(self, s: Column) -> Column:
        return self.find_prev(s, F.length(s))

    def occurs_in(self, s: Column) -> Column:
        if not self.size:
            return F.when(s.isNotNull(), F.lit(True))
        return F.contains(s, F.lit(self.pattern)) if self.comparator == "isequal" else s.rlike(self.regex)

    def starts(self, s: Column, overlap: bool = True) -> Column:
        """Starts of all hits: each hit's first symbol is marked in a copy of equal length.

        Looking ahead takes one symbol at a time and so finds overlapping hits too;
        otherwise the whole hit is replaced and the next is sought behind it.
        """
        if not self.size:
            return F.when(s.isNotNull(), sequence(F.length(s) + 1))
        marked = F.regexp_replace(s, f"(?={self.regex}).", MARK) if overlap else F.regexp_replace(s, self.regex, MARK + "." * (self.size - 1))
        return places_of(MARK, marked)

    def find_all(self, s: Column, overlap: bool = True, first: Column | int | None = None, last: Column | int | None = None) -> Column:
        """All hits; without ``overlap`` each is sought behind the one before. A part first..last is searched as if alone."""
        if first is not None:
            first, last = col(first), col(last)
            hits = self.find_all(F.substring(s, first, F.greatest(last - first + 1, F.lit(0))), overlap)
            return F.transform(hits, lambda h: F.struct((h["start"] + first - 1).alias("start"), (h["stop"] + first - 1).alias("stop")))
        return F.transform(self.starts(s, overlap), lambda i: span(i, self.size)).cast(f"array<{RANGE}>")


def find_all(pattern: str, s: Column, overlap: bool = True, a: Alphabet | str = "DNA4") -> Column:
    return ExactQuery(pattern, "isequal", a).find_all(s, overlap)
