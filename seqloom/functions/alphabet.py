"""Alphabets of biological sequences: symbols, codes, compatibility bits, classes.

A sequence is a string column in upper case. An ``Alphabet`` says which symbols it
may hold, in the order of their codes, which is also the order that sequences sort by.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols in code order. A nucleotide's code is also its bit set (A 1, C 2, G 4, T or U 8).
DNA_ORDER = "-ACMGRSVTWYHKDBN"
RNA_ORDER = "-ACMGRSVUWYHKDBN"
AMINO_ORDER = "ARNDCQEGHILKMFPSTWYVOUBJZX*-"
#: Ambiguous amino acids and what they stand for (X: any of the first 22).
AMINO_SETS = {"B": "ND", "J": "IL", "Z": "QE", "X": AMINO_ORDER[:22]}


@dataclass(frozen=True)
class Alphabet:
    name: str
    symbols: str
    bits: tuple[int, ...] = field(repr=False)
    bits_per_symbol: int = 8
    family: str = "AA"

    def __post_init__(self):
        if len(self.symbols) != len(self.bits) or len(set(self.symbols)) != len(self.symbols):
            raise ValueError("an alphabet has distinct symbols and a bit set for each")
        if any(len(c.encode()) != 1 or c != c.upper() for c in self.symbols):
            raise ValueError("symbols are single ASCII characters in upper case")

    def __len__(self) -> int:
        return len(self.symbols)

    def __iter__(self):
        return iter(self.symbols)

    def __contains__(self, symbol: str) -> bool:
        return len(symbol) == 1 and symbol in self.symbols

    @property
    def complete(self) -> bool:
        """Whether every code of ``bits_per_symbol`` bits is a symbol."""
        return len(self) == 1 << self.bits_per_symbol

    def compat(self, symbol: str) -> int:
        return self.bits[self.symbols.index(symbol)]

    def compatible(self, a: str, b: str) -> bool:
        return self.compat(a) & self.compat(b) != 0

    def where(self, test) -> str:
        """Symbols whose bit set passes ``test``."""
        return "".join(s for s, b in zip(self.symbols, self.bits, strict=True) if test(b))

    @property
    def gap(self) -> str:
        return "-" if "-" in self.symbols else ""

    @property
    def ambiguous(self) -> str:
        return self.where(lambda b: b.bit_count() > 1)

    @property
    def certain(self) -> str:
        """Symbols that stand for one thing; the stop ``*`` is one of them."""
        return self.where(lambda b: b.bit_count() == 1) + ("*" if "*" in self.symbols else "")

    @property
    def gc(self) -> str:
        if self.family == "AA":
            raise ValueError("amino acids have no GC content")
        return self.where(lambda b: b and b & ~6 == 0)

    @property
    def sort_symbols(self) -> str:
        """Characters that sort as the symbols' codes do."""
        return "".join(chr(48 + k) for k in range(len(self)))


def _nucleotides(name: str, order: str, family: str) -> tuple[Alphabet, Alphabet]:
    certain = [order[1 << k] for k in range(4)]
    return (Alphabet(f"{name}2", "".join(certain), (1, 2, 4, 8), 2, family), Alphabet(f"{name}4", order, tuple(range(16)), 4, family))


DNA2, DNA4 = _nucleotides("DNA", DNA_ORDER, "DNA")
RNA2, RNA4 = _nucleotides("RNA", RNA_ORDER, "RNA")
AA = Alphabet("AA", AMINO_ORDER, tuple(sum(1 << AMINO_ORDER.index(c) for c in AMINO_SETS.get(s, s if s not in "*-" else "")) for s in AMINO_ORDER))
REGISTRY: dict[str, Alphabet] = {a.name: a for a in (DNA2, RNA2, DNA4, RNA4, AA)}
ACGT, ACGTN, ACGU, ACGUN = tuple("ACGT"), tuple("ACGTN"), tuple("ACGU"), tuple("ACGUN")
PURINES, PYRIMIDINES = "AGR", "CTUY"


def register(alphabet: Alphabet) -> Alphabet:
    """Makes a custom alphabet known by its name; a known one can't be changed."""
    if REGISTRY.get(alphabet.name, alphabet) != alphabet:
        raise ValueError(f"there is another alphabet {alphabet.name}")
    REGISTRY[alphabet.name] = alphabet
    return alphabet


def alphabet(a: Alphabet | str) -> Alphabet:
    return a if isinstance(a, Alphabet) else REGISTRY[a]


def promote(a: Alphabet | str, b: Alphabet | str) -> Alphabet:
    """The wider of two alphabets of one family; there is none for DNA with RNA."""
    a, b = alphabet(a), alphabet(b)
    if a.family != b.family:
        raise TypeError(f"no common alphabet for {a.name} and {b.name}")
    return a if len(a) >= len(b) else b


def escape(symbols: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in symbols)


def one_of(symbols: str) -> str:
    """Regex class of the symbols; of none, one that nothing matches."""
    return f"[{escape(symbols)}]" if symbols else r"[^\x00-\x{10FFFF}]"


def either_case(a: Alphabet) -> str:
    return escape(a.symbols + "".join(c.lower() for c in a.symbols if c.isalpha()))


def sequence(n: Column) -> Column:
    """1..n as an array, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))


def symbols_of(s: Column) -> Column:
    """The symbols as an array, empty for the empty sequence."""
    return F.array_remove(F.split(s, ""), "")


def try_encode(symbol: Column, a: Alphabet | str) -> Column:
    """Code of a symbol, null if the alphabet lacks it."""
    a = alphabet(a)
    at = F.position(F.upper(symbol), F.lit(a.symbols))
    return F.when((at > 0) & (F.length(symbol) == 1), at - 1)


def encode(symbol: Column, a: Alphabet | str) -> Column:
    a = alphabet(a)
    return F.when(symbol.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(try_encode(symbol, a), F.raise_error(F.concat(F.lit("EncodeError: cannot encode "), symbol, F.lit(f" in {a.name}"))).cast("int")))


def decode(code: Column, a: Alphabet | str) -> Column:
    a = alphabet(a)
    good = code.between(0, len(a) - 1)
    return F.when(good, F.get(F.split(F.lit(a.symbols), ""), code)).when(code.isNotNull(), F.raise_error(F.concat(F.lit(f"DecodeError: {a.name} has no code "), code.cast("string"))))


def compat_bits(symbol: Column, a: Alphabet | str) -> Column:
    """Bit set of a symbol, null if the alphabet lacks it."""
    a = alphabet(a)
    return F.get(F.array(*[F.lit(b) for b in a.bits]), try_encode(symbol, a))


def is_compatible(x: Column, y: Column, a: Alphabet | str) -> Column:
    return compat_bits(x, a).bitwiseAND(compat_bits(y, a)) != 0


def symbol_is(symbol: Column, kind: str, a: Alphabet | str = "DNA4") -> Column:
    """Whether a symbol is gap, ambiguous, certain, gc, purine or pyrimidine."""
    a = alphabet(a)
    classes = {"purine": PURINES, "pyrimidine": PYRIMIDINES}
    return symbol.rlike(f"^{one_of(classes[kind] if kind in classes else getattr(a, kind))}$")
