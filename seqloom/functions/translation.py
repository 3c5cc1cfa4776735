"""Codons to amino acids under the NCBI genetic codes, ambiguous codons included."""

from __future__ import annotations

from functools import cache
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .alphabet import DNA4

# The standard code, codons in the order TTT, TTC, TTA, TTG, TCT, ...
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# NCBI number, name, and what differs from the standard code.
CODES: dict[int, tuple[str, dict[str, str]]] = {
    1: ("standard", {}),
    2: ("vertebrate mitochondrial", {"TGA": "W", "ATA": "M", "AGA": "*", "AGG": "*"}),
    3: ("yeast mitochondrial", {"TGA": "W", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "ATA": "M"}),
    4: ("mold mitochondrial", {"TGA": "W"}),
    5: ("invertebrate mitochondrial", {"TGA": "W", "ATA": "M", "AGA": "S", "AGG": "S"}),
    6: ("ciliate nuclear", {"TAA": "Q", "TAG": "Q"}),
    9: ("echinoderm mitochondrial", {"TGA": "W", "AAA": "N", "AGA": "S", "AGG": "S"}),
    10: ("euplotid nuclear", {"TGA": "C"}),
    11: ("bacterial and plastid", {}),
    12: ("alternative yeast nuclear", {"CTG": "S"}),
    13: ("ascidian mitochondrial", {"TGA": "W", "ATA": "M", "AGA": "G", "AGG": "G"}),
    14: ("alternative flatworm mitochondrial", {"TAA": "Y", "TGA": "W", "AAA": "N", "AGA": "S", "AGG": "S"}),
    15: ("blepharisma macronuclear", {"TAG": "Q"}),
    16: ("chlorophycean mitochondrial", {"TAG": "L"}),
    21: ("trematode mitochondrial", {"TGA": "W", "ATA": "M", "AAA": "N", "AGA": "S", "AGG": "S"}),
    22: ("scenedesmus obliquus mitochondrial", {"TCA": "*", "TAG": "L"}),
    23: ("thraustochytrium mitochondrial", {"TTA": "*"}),
    24: ("pterobranchia mitochondrial", {"TGA": "W", "AGA": "S", "AGG": "K"}),
    25: ("candidate division SR1", {"TGA": "G"}),
}
# Pairs of amino acids that have a symbol of their own.
PAIRS = {frozenset("ND"): "B", frozenset("IL"): "J", frozenset("QE"): "Z"}
#: Symbols a codon may hold, in the order of the table; no gap.
BASES = DNA4.symbols[1:]


@cache
def genetic_code(number: int = 1) -> dict[str, str]:
    """Amino acid of each of the 64 codons, written with T."""
    codons = map("".join, product("TCAG", repeat=3))
    return dict(zip(codons, STANDARD, strict=True)) | CODES[number][1]


@cache
def codon_table(number: int = 1, allow_ambiguous: bool = True) -> str:
    """Amino acid of all 15 ** 3 codons in the order of ``BASES``.

    An ambiguous codon has the amino acid all its codons share, or the symbol of
    their pair, or X. Without ``allow_ambiguous`` those of more than one have '!'.
    """
    code = genetic_code(number)
    members = {b: [c for c in "ACGT" if DNA4.compatible(b, c)] for b in BASES}
    out = []
    for codon in product(BASES, repeat=3):
        found = frozenset(code["".join(c)] for c in product(*(members[b] for b in codon)))
        if len(found) == 1:
            out.append(next(iter(found)))
        else:
            out.append(PAIRS.get(found, "X") if allow_ambiguous else "!")
    return "".join(out)


def translate(s: Column, code: int = 1, allow_ambiguous: bool = True, alternative_start: bool = False, strict: bool = True) -> Column:
    """The protein of a DNA or RNA sequence.

    A length that isn't a multiple of 3, a gap, or (without ``allow_ambiguous``) a
    codon of more than one amino acid stops the query, or with ``strict`` off gives null.
    ``alternative_start`` makes the first residue M.
    """
    letters = "".join(chr(65 + k) for k in range(len(BASES)))
    coded = F.translate(s, BASES + "U", letters + letters[BASES.index("T")])
    table = F.split(F.lit(codon_table(code, allow_ambiguous)), "")

    def digit(c: Column, k: int) -> Column:
        return F.ascii(F.substring(c, k, 1) if k > 1 else c) - 65

    n = len(BASES)
    protein = F.array_join(F.transform(F.regexp_extract_all(coded, F.lit("..."), F.lit(0)), lambda c: F.get(table, digit(c, 1) * n * n + digit(c, 2) * n + digit(c, 3))), "")
    if alternative_start:
        protein = F.when(F.length(s) > 0, F.overlay(protein, F.lit("M"), 1, 1)).otherwise(protein)
    none = F.lit(None).cast("string")
    fail = (lambda text: F.raise_error(F.lit(text)).cast("string")) if strict else (lambda text: none)
    out = F.when(s.isNull(), none).when(F.length(s) % 3 != 0, fail("translate: length is not a multiple of 3")).when(F.contains(s, F.lit("-")), fail("translate: gap in a codon"))
    if not allow_ambiguous:
        out = out.when(F.contains(protein, F.lit("!")), fail("translate: ambiguous codon"))
    return out.otherwise(protein)


def codes_table(spark: SparkSession) -> DataFrame:
    """(code_id, name, codon, aa): all genetic codes."""
    rows = [(k, CODES[k][0], codon, a) for k in CODES for codon, a in genetic_code(k).items()]
    return spark.createDataFrame(rows, "code_id int, name string, codon string, aa string")


def show_code(number: int = 1) -> str:
    """A code as text: four columns of codons, by first, third and second base."""
    code = genetic_code(number)
    rows = ["  ".join(f"{a}{b}{c} {code[a + b + c]}" for b in "TCAG") for a in "TCAG" for c in "TCAG"]
    return f"{CODES[number][0]} genetic code\n" + "\n".join(rows)
