"""Random sequences. A draw depends on a key, the place and the seed, so reruns and retries agree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import Alphabet, alphabet, sequence

#: Steps in [0, 1) that a draw can take.
STEPS = 1 << 30


@dataclass(frozen=True)
class UniformSampler:
    symbols: tuple[str, ...]

    def __post_init__(self):
        if not self.symbols:
            raise ValueError("nothing to draw from")

    def pick(self, u: Column) -> Column:
        return F.get(F.split(F.lit("\x1f".join(self.symbols)), "\x1f"), F.floor(u * len(self.symbols)).cast("int"))


@dataclass(frozen=True)
class WeightedSampler:
    """The last symbol's probability is what the others leave."""

    symbols: tuple[str, ...]
    weights: tuple[float, ...]

    def __post_init__(self):
        if len(self.weights) != len(self.symbols) - 1:
            raise ValueError("one probability less than symbols")
        if any(w < 0 for w in self.weights) or sum(self.weights) > 1 + 1e-12:
            raise ValueError("probabilities are not negative and sum to 1 at most")

    def pick(self, u: Column) -> Column:
        out, edge = None, 0.0
        for s, w in zip(self.symbols, self.weights, strict=False):
            edge += w
            out = F.when(u < edge, s) if out is None else out.when(u < edge, s)
        return F.lit(self.symbols[-1]) if out is None else out.otherwise(self.symbols[-1])


def default_sampler(a: Alphabet | str) -> UniformSampler:
    """Uniform over the four bases, or the 20 standard amino acids."""
    a = alphabet(a)
    return UniformSampler(tuple(a.symbols[:20] if a.family == "AA" else a.certain))


def uniform(*key) -> Column:
    """A number in [0, 1) fixed by the key."""
    return F.pmod(F.xxhash64(*key), F.lit(STEPS)) / F.lit(float(STEPS))


def randseq(a: Alphabet | str, length: Column | int, *, key: Column, seed: int = 0, sampler: UniformSampler | WeightedSampler | None = None) -> Column:
    """A random sequence of ``length`` symbols for each value of ``key``."""
    sampler = sampler or default_sampler(a)
    n = F.lit(length) if isinstance(length, int) else length
    return F.when(n < 0, F.raise_error(F.lit("randseq: negative length")).cast("string")).when(n.isNotNull(), F.array_join(F.transform(sequence(n), lambda i: sampler.pick(uniform(F.lit(seed), key, i))), ""))


def randdna(length: Column | int, **kw) -> Column:
    return randseq("DNA4", length, **kw)


def randrna(length: Column | int, **kw) -> Column:
    return randseq("RNA4", length, **kw)


def randaa(length: Column | int, **kw) -> Column:
    return randseq("AA", length, **kw)
