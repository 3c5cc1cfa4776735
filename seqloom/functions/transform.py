"""Whole-sequence transformations and combination."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import Alphabet, alphabet, one_of, symbols_of

# Each nucleotide below the other row's is its complement; N, S, W and the gap are their own.
FROM, TO = "ACGTMRYKVHDB", "TGCAKYRMBDHV"


def reverse(s: Column) -> Column:
    return F.reverse(s)


def complement(s: Column, family: str = "DNA") -> Column:
    if family not in ("DNA", "RNA"):
        raise TypeError("only nucleotides have complements")
    u = str.maketrans("T", "U") if family == "RNA" else {}
    return F.translate(s, FROM.translate(u), TO.translate(u))


def reverse_complement(s: Column, family: str = "DNA") -> Column:
    return F.reverse(complement(s, family))


def order_key(s: Column, a: Alphabet | str = "DNA4") -> Column:
    """A string that sorts as the sequences do, by their symbols' codes."""
    a = alphabet(a)
    return F.translate(s, a.symbols, a.sort_symbols)


def canonical(s: Column, a: Alphabet | str = "DNA4") -> Column:
    """The lesser of a sequence and its reverse complement."""
    rc = reverse_complement(s, alphabet(a).family)
    return F.when(order_key(s, a) <= order_key(rc, a), s).otherwise(rc)


def ungap(s: Column) -> Column:
    return F.replace(s, F.lit("-"), F.lit(""))


def shuffle(s: Column, seed: int | None = None) -> Column:
    """The symbols in random order."""
    return F.array_join(F.shuffle(symbols_of(s), seed), "")


def keep(s: Column, test) -> Column:
    """The symbols that pass: a string of symbols, or a function of a symbol column."""
    if isinstance(test, str):
        return F.array_join(F.filter(symbols_of(s), lambda c: F.contains(F.lit(test), c)), "")
    return F.array_join(F.filter(symbols_of(s), test), "")


def drop(s: Column, symbols: str) -> Column:
    return F.translate(s, symbols, "")


def replace_symbols(s: Column, change) -> Column:
    """Each symbol mapped: a dict of symbols, or a function of a symbol column."""
    if isinstance(change, dict):
        return F.translate(s, "".join(change), "".join(change.values()))
    return F.array_join(F.transform(symbols_of(s), change), "")


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def repeat(s: Column, n: Column | int) -> Column:
    return F.repeat(s, F.lit(n) if isinstance(n, int) else n)


def join(parts: Column) -> Column:
    """One sequence from an array of sequences and symbols."""
    return F.array_join(parts, "")


def equals(a: Column, b: Column, family_a: str = "DNA", family_b: str = "DNA") -> Column:
    """Element-wise; symbols of different families are never equal, so only empty sequences then are."""
    if family_a != family_b:
        return (F.length(a) == 0) & (F.length(b) == 0)
    return a == b


def less(a: Column, b: Column, alpha: Alphabet | str = "DNA4") -> Column:
    return order_key(a, alpha) < order_key(b, alpha)


def hashed(s: Column) -> Column:
    """Equal for equal sequences, whatever they were cut from."""
    return F.when(s.isNotNull(), F.xxhash64(s))


def is_palindromic(s: Column, family: str = "DNA") -> Column:
    return s == reverse_complement(s, family)


def is_canonical(s: Column, a: Alphabet | str = "DNA4") -> Column:
    return order_key(s, a) <= order_key(reverse_complement(s, alphabet(a).family), a)


def longest_run(s: Column) -> Column:
    """Length of the longest run of one symbol."""
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(acc, c):
        n = F.when(acc["c"] == c, acc["n"] + 1).otherwise(F.lit(1))
        return F.struct(c.alias("c"), n.alias("n"), F.greatest(acc["best"], n).alias("best"))

    return F.aggregate(symbols_of(s), start, step, lambda acc: acc["best"])


def is_repetitive(s: Column, n: Column | int | None = None) -> Column:
    """Whether one symbol stands n times in a row; by default, all the time."""
    if n is None:
        return s.rlike(r"^(?:(.)\1*)?$")
    if isinstance(n, int):
        if n < 0:
            raise ValueError("a run is not negative")
        return s.isNotNull() if n == 0 else s.rlike(r"(.)\1{%d}" % (n - 1)) if n > 1 else F.length(s) >= 1
    return longest_run(s) >= n


def has_ambiguity(s: Column, a: Alphabet | str = "DNA4") -> Column:
    symbols = alphabet(a).ambiguous
    return s.rlike(one_of(symbols)) if symbols else F.when(s.isNotNull(), F.lit(False))
