"""Approximate search by edit distance.

A hit ends at the first place (from the left) where some substring is within k edits
of the pattern; of the substrings ending there it is the leftmost of the least
distance. The dynamic program runs over Arrow batches, a row of it for each pattern
symbol: NumPy works on all places of a text at once, and only one row is held.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet, alphabet
from .common import RANGE, col, span

#: A cell is (distance, start) in one number, so that the least is the leftmost of the least distance.
SHIFT = 32
EDIT = np.int64(1 << SHIFT)


def cells(match: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each end 0..n the least (distance, start) of the substrings that end there.

    ``match[i, c]``: pattern symbol i meets the symbol with code c. A row needs the cell to
    the left only as the running minimum of what can be reached by further insertions.
    """
    n = len(codes)
    ramp = np.arange(n + 1, dtype=np.int64) << SHIFT
    row = np.arange(1, n + 2, dtype=np.int64)  # the empty substring behind each place
    for meets in match:
        new = row + EDIT
        np.minimum(new[1:], row[:-1] + np.where(meets[codes], 0, EDIT), out=new[1:])
        row = np.minimum.accumulate(new - ramp) + ramp
    return row


def hits(match: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops, from 1, of the best substring at each end within ``k`` edits."""
    row = cells(match, codes)[1:]
    ends = np.flatnonzero(row >> SHIFT <= k)
    return row[ends] & (EDIT - 1), ends + 1


def coder(a: Alphabet) -> np.ndarray:
    """Code of each byte; what the alphabet lacks has one more, which meets nothing."""
    out = np.full(256, len(a), np.int64)
    for k, c in enumerate(a.symbols):
        out[ord(c)] = k
    return out


class ApproximateQuery:
    """A pattern of at most 64 symbols.

    ``comparator`` is 'isequal', 'iscompatible', or a function that says of a text symbol and a
    pattern symbol whether they meet.
    """

    def __init__(self, pattern: str, comparator: str | Callable[[str, str], bool] = "isequal", a: Alphabet | str = "DNA4"):
        self.alphabet = a = alphabet(a)
        if len(pattern) > 64:
            raise ValueError("patterns have at most 64 symbols")
        if not callable(comparator) and comparator not in ("isequal", "iscompatible"):
            raise ValueError("comparator is isequal, iscompatible or a function")
        if any(c not in a for c in pattern):
            raise TypeError(f"the pattern is not of {a.name}")
        self.pattern, self.comparator = pattern, comparator
        same = comparator if callable(comparator) else a.compatible if comparator == "iscompatible" else str.__eq__
        self.match = np.array([[*(bool(same(x, p)) for x in a.symbols), False] for p in pattern], bool).reshape(len(pattern), len(a) + 1)

    def _first(self, s: Column, k: int, backward: bool = False) -> Column:
        match, code = self.match[::-1] if backward else self.match, coder(self.alphabet)

        @F.pandas_udf(RANGE)
        def search(texts: pd.Series) -> pd.DataFrame:
            found = []
            for t in texts:
                starts, stops = hits(match, code[np.frombuffer(t.encode("latin-1", "replace"), np.uint8)], k) if t else ((), ())
                found.append((int(starts[0]), int(stops[0])) if len(stops) else (None, None))
            return pd.DataFrame({n: pd.array([f[i] for f in found], "Int32") for i, n in enumerate(("start", "stop"))})

        hit = search(s)
        return F.when(hit["start"].isNotNull(), hit)

    def _checked(self, k: int) -> None:
        if k < 0:
            raise ValueError("k is not negative")

    def find_next(self, s: Column, k: int, start: Column | int) -> Column:
        self._checked(k)
        start = F.greatest(col(start), F.lit(1))
        if k >= len(self.pattern):
            return F.when(s.isNotNull(), span(start, 0))
        hit = self._first(F.substring(s, start, F.length(s)), k)
        return F.when((start <= F.length(s)) & hit.isNotNull(), F.struct((hit["start"] + start - 1).cast("int").alias("start"), (hit["stop"] + start - 1).cast("int").alias("stop")))

    def find_first(self, s: Column, k: int) -> Column:
        return self.find_next(s, k, 1)

    def find_prev(self, s: Column, k: int, start: Column | int) -> Column:
        """The mirror image: reversed pattern and text, places mapped back."""
        self._checked(k)
        end = F.least(col(start), F.length(s))
        if k >= len(self.pattern):
            return F.when(s.isNotNull(), span(end + 1, 0))
        hit = self._first(F.reverse(F.substring(s, F.lit(1), F.greatest(end, F.lit(0)))), k, backward=True)
        return F.when((end >= 1) & hit.isNotNull(), F.struct((end - hit["stop"] + 1).cast("int").alias("start"), (end - hit["start"] + 1).cast("int").alias("stop")))

    def find_last(self, s: Column, k: int) -> Column:
        return self.find_prev(s, k, F.length(s))

    def occurs_in(self, s: Column, k: int) -> Column:
        return F.when(s.isNotNull(), self.find_first(s, k).isNotNull())

    def find_all(self, s: Column, k: int) -> Column:
        """Every end within ``k`` edits with its best substring, in order of the ends: array of ranges.

        With ``k`` of the pattern's size or more the empty range before each place and behind the last.
        """
        self._checked(k)
        match, code, loose = self.match, coder(self.alphabet), k >= len(self.pattern)

        @F.pandas_udf(f"array<{RANGE}>")
        def search(texts: pd.Series) -> pd.Series:
            out = []
            for t in texts:
                if t is None:
                    out.append(None)
                elif loose:
                    out.append([{"start": i + 1, "stop": i} for i in range(len(t) + 1)])
                else:
                    found = hits(match, code[np.frombuffer(t.encode("latin-1", "replace"), np.uint8)], k)
                    out.append([{"start": a, "stop": b} for a, b in zip(*(x.tolist() for x in found), strict=True)])
            return pd.Series(out)

        return search(s)
