"""Text to sequences: literals, validated parsing, inference and conversion of alphabets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import AA, DNA2, DNA4, RNA2, RNA4, Alphabet, alphabet, either_case, escape

GUESSES = (DNA2, RNA2, DNA4, RNA4, AA)


def literal(text: str, a: Alphabet | str) -> Column:
    """A constant sequence, checked when the plan is built; line ends are dropped, case is folded."""
    a, text = alphabet(a), text.replace("\r", "").replace("\n", "").upper()
    for i, c in enumerate(text, 1):
        if c not in a:
            raise ValueError(f"EncodeError: cannot encode {c!r} at index {i} in {a.name}")
    return F.lit(text)


def dna(text: str) -> Column:
    return literal(text, DNA4)


def rna(text: str) -> Column:
    return literal(text, RNA4)


def aa(text: str) -> Column:
    return literal(text, AA)


def bad_index(text: Column, a: Alphabet | str) -> Column:
    """Place (from 1) of the first character that isn't a symbol, 0 if all are."""
    return F.regexp_instr(text, F.lit(f"[^{either_case(alphabet(a))}]"))


def valid(text: Column, a: Alphabet | str) -> Column:
    return bad_index(text, a) == 0


def try_parse(text: Column, a: Alphabet | str) -> Column:
    """The sequence in upper case; null if a character isn't a symbol.

    Characters are checked before folding: some letters only fold to symbols.
    """
    return F.when(valid(text, a), F.upper(text))


def parse(text: Column, a: Alphabet | str) -> Column:
    """As ``try_parse``, but a bad character stops the query and is named with its place."""
    a = alphabet(a)
    at = bad_index(text, a)
    char = F.substring(text, at, F.lit(1))
    error = F.concat(F.lit("EncodeError: cannot encode byte 0x"), F.lower(F.hex(F.ascii(char))), F.lit(" ('"), char, F.lit("') at index "), at.cast("string"), F.lit(f" in {a.name}"))
    return F.when(at == 0, F.upper(text)).when(text.isNotNull(), F.raise_error(error))


def parse_part(text: Column, start: Column | int, stop: Column | int, a: Alphabet | str) -> Column:
    """Parses characters start..stop."""
    start, stop = (F.lit(x) if isinstance(x, int) else x for x in (start, stop))
    return parse(F.substring(text, start, F.greatest(F.lit(0), stop - start + 1)), a)


def parse_bytes(data: Column, a: Alphabet | str) -> Column:
    return parse(F.decode(data, "ISO-8859-1"), a)


def from_symbols(symbols: Column, a: Alphabet | str) -> Column:
    """A sequence from an array of symbols."""
    return parse(F.array_join(symbols, ""), a)


def keep_symbols(text: Column, a: Alphabet | str) -> Column:
    """The symbols of a text, all other characters dropped; filtered before folding."""
    return F.upper(F.regexp_replace(text, f"[^{either_case(alphabet(a))}]+", ""))


def guess_alphabet(text: Column) -> Column:
    """Name of the first of DNA2, RNA2, DNA4, RNA4, AA that holds all characters; null if none does."""
    out = F.when(valid(text, GUESSES[0]), GUESSES[0].name)
    for a in GUESSES[1:]:
        out = out.when(valid(text, a), a.name)
    return out


def bad_guess(text: Column) -> Column:
    """Place of the first character that no alphabet has; null if one fits."""
    return F.when(~valid(text, AA), bad_index(text, AA))


def bioseq(text: Column) -> Column:
    """struct(alphabet, seq) by inference; text that fits no alphabet stops the query."""
    found = guess_alphabet(text)
    error = F.raise_error(F.concat(F.lit("cannot infer an alphabet: bad character at index "), bad_index(text, AA).cast("string")))
    return F.when(found.isNotNull(), F.struct(found.alias("alphabet"), F.upper(text).alias("seq"))).when(text.isNotNull(), error.cast("struct<alphabet: string, seq: string>"))


def convert(s: Column, source: Alphabet | str, target: Alphabet | str) -> Column:
    """A sequence in another alphabet: T and U change with the family, and what the target lacks stops the query."""
    source, target = alphabet(source), alphabet(target)
    if "AA" in (source.family, target.family) and source.family != target.family:
        raise TypeError(f"{source.name} does not convert to {target.name}")
    if (source.family, target.family) == ("DNA", "RNA"):
        s = F.translate(s, "T", "U")
    elif (source.family, target.family) == ("RNA", "DNA"):
        s = F.translate(s, "U", "T")
    return s if len(target) >= len(source) else parse(s, target)


def empty() -> Column:
    return F.lit("")


def with_alphabet(col: Column, name: str, a: Alphabet | str) -> Column:
    """``col`` named ``name``, its alphabet in the column's metadata."""
    return col.alias(name, metadata={"alphabet": alphabet(a).name})


def alphabet_of(df, name: str) -> Alphabet:
    return alphabet(df.schema[name].metadata["alphabet"])


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "escape")]
