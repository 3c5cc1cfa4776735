"""Position frequency and weight matrices: scores of windows and search.

Windows are scored by NumPy over Arrow batches, all of a text at once, one matrix column
after the other.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

#: Row of the matrix for each byte; symbols other than the bases have none.
CODES = np.full(256, 4, np.int64)
CODES[[ord(c) for c in "ACGTU"]] = 0, 1, 2, 3, 3


class PWM:
    """Scores of A, C, G and T (or U) at each place: ``columns[p]`` has four numbers."""

    def __init__(self, columns: list[list[float]]):
        if any(len(c) != 4 for c in columns):
            raise ValueError("a matrix has four rows")
        self.columns = [list(map(float, c)) for c in columns]
        self.size = len(columns)

    @classmethod
    def of_counts(cls, counts: list[list[float]], prior: list[float] = (0.25, 0.25, 0.25, 0.25), pseudo: float = 0.0) -> PWM:
        """log2 of each frequency over the prior; a zero count scores minus infinity."""
        if any(p <= 0 for p in prior) or abs(sum(prior) - 1) > 1e-9:
            raise ValueError("a prior is positive and sums to 1")
        out = []
        for c in counts:
            total = sum(c) + 4 * pseudo
            out.append([math.log2((x + pseudo) / total / p) if x + pseudo else -math.inf for x, p in zip(c, prior, strict=True)])
        return cls(out)

    @classmethod
    def of_frame(cls, pfm: DataFrame, prior: list[float] = (0.25, 0.25, 0.25, 0.25), pseudo: float = 0.0) -> PWM:
        """From a long table (pos, sym, value) of counts: four rows for each place of the motif."""
        rows = {(r["pos"], "T" if r["sym"] == "U" else r["sym"]): r["value"] for r in pfm.collect()}
        size = max((p for p, _ in rows), default=0)
        return cls.of_counts([[rows.get((p, c), 0) for c in "ACGT"] for p in range(1, size + 1)], prior, pseudo)

    @property
    def max_score(self) -> float:
        return sum(map(max, self.columns))

    def score_at(self, s: Column, place: Column | int) -> Column:
        """Sum over the window from ``place`` on; symbols other than the four add nothing."""
        place = col(place)
        total = F.lit(0.0)
        for k, scores in enumerate(self.columns):
            c = F.substring(s, place + k, F.lit(1))
            total = total + F.when(c == "A", scores[0]).when(c == "C", scores[1]).when(c == "G", scores[2]).when((c == "T") | (c == "U"), scores[3]).otherwise(0.0)
        return F.when(place.between(1, F.length(s) - self.size + 1), total).when(s.isNotNull() & place.isNotNull(), F.raise_error(F.lit("BoundsError: window")).cast("double"))

    def _scores(self, text: str) -> np.ndarray:
        codes = CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
        n = max(0, len(codes) - self.size + 1)
        total = np.zeros(n)
        for k, scores in enumerate(self.columns):
            total += np.array([*scores, 0.0])[codes[k : k + n]]
        return total

    def _hits(self, text: str, threshold: float, start: int, stop: int) -> np.ndarray:
        """Places from ``start`` to ``stop`` whose window scores ``threshold`` or more; only those windows are read."""
        first, last = max(start, 1), min(stop, len(text) - self.size + 1)
        if last < first:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self._scores(text[first - 1 : last + self.size - 1]) >= threshold) + first

    def scores(self, s: Column) -> Column:
        """Score of each window, as an array."""

        @F.pandas_udf("array<double>")
        def score(texts: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else self._scores(t) for t in texts])

        return score(s)

    def find_all(self, s: Column, threshold: float) -> Column:
        """Places whose window scores ``threshold`` or more."""

        @F.pandas_udf("array<int>")
        def search(texts: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else self._hits(t, threshold, 1, len(t)) for t in texts])

        return search(s)

    def _one(self, s: Column, threshold: float, start: Column, stop: Column, which: int) -> Column:
        @F.pandas_udf("int")
        def search(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
            found = [self._hits(t, threshold, int(a), int(b)) if t is not None and a == a and b == b else () for t, a, b in zip(texts, starts, stops, strict=True)]
            return pd.Series([int(f[which]) if len(f) else None for f in found], dtype="Int32")

        return search(s, start, stop)

    def find_next(self, s: Column, threshold: float, start: Column | int = 1) -> Column:
        return self._one(s, threshold, col(start), F.length(s), 0)

    def find_first(self, s: Column, threshold: float) -> Column:
        return self.find_next(s, threshold, 1)

    def find_prev(self, s: Column, threshold: float, start: Column | int) -> Column:
        return self._one(s, threshold, F.lit(1), col(start), -1)

    def find_last(self, s: Column, threshold: float) -> Column:
        return self.find_prev(s, threshold, F.length(s))


def query_of(sequences: DataFrame, name: str, prior: list[float] = (0.25, 0.25, 0.25, 0.25)) -> PWM:
    """A weight matrix from a table of sequences, 0.01 added to each count."""
    from ..operators.aggregates import pfm

    return PWM.of_frame(pfm(sequences, name), prior, 0.01)
