"""Sequence functions on small tables of expected values and against plain Python."""

import itertools
import math
import random
import re
import tracemalloc

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from seqloom.functions import alphabet as A
from seqloom.functions import counting, display, edit, parse, transform, translation
from seqloom.functions import random as rand
from seqloom.operators import aggregates, hits
from seqloom.plans.queries import QUERIES
from seqloom.search import regex, symbols
from seqloom.search.approx import ApproximateQuery
from seqloom.search.exact import ExactQuery
from seqloom.search.pwm import PWM, query_of
from seqloom.search.regex import BioRegex, way_lists, way_ranges

C = F.col
S, T = C("s"), C("t")
COMPLEMENT = dict(zip("-ACMGRSVTWYHKDBN", "-TGKCYSBAWRDMHVN", strict=True))


def table(spark, rows, schema="s string"):
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def values(spark, col, rows, schema="s string"):
    """The column over the rows, which keep their order."""
    rows = [(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, f"k int, {schema}")
    return [r["v"] for r in df.select("k", col.alias("v")).orderBy("k").collect()]


def fails(spark, col, row, schema="s string"):
    with pytest.raises(Exception, match="Error|Mismatch|translate|DimensionMismatch|infer|negative"):
        values(spark, col, [row], schema)


def randomly(rng, symbols, lengths=(0, 1, 10, 32, 200), n=4):
    return ["".join(rng.choices(symbols, k=k)) for k in lengths for _ in range(n)]


# alphabets

def test_alphabets():
    assert (len(A.DNA2), len(A.DNA4), len(A.AA)) == (4, 16, 28)
    assert A.DNA4.complete and A.DNA2.complete and not A.AA.complete
    assert A.DNA4.ambiguous == "MRSVWYHKDBN" and A.DNA4.certain == "ACGT" and A.DNA4.gc == "CGS" and A.DNA2.ambiguous == ""
    assert A.AA.ambiguous == "BJZX" and A.AA.certain.endswith("U*") and len(A.AA.certain) == 23
    assert A.AA.compat("J") == 0x600 and A.AA.compat("X") == (1 << 22) - 1 and A.AA.compat("-") == A.AA.compat("*") == 0
    assert not A.DNA4.compatible("-", "-") and A.DNA4.compatible("N", "A") and not A.DNA4.compatible("R", "Y")
    assert A.promote("DNA2", "DNA4") == A.DNA4
    with pytest.raises(TypeError):
        A.promote("DNA4", "RNA4")
    custom = A.register(A.Alphabet("bits", "01", (1, 2), 1, "bits"))
    assert A.alphabet("bits") is custom and custom.complete
    with pytest.raises(ValueError):
        A.Alphabet("bad", "AA", (1, 2))


def test_codes(spark):
    for a in ("DNA4", "RNA2", "AA"):
        assert values(spark, A.encode(S, a), list(A.alphabet(a))) == list(range(len(A.alphabet(a))))
        assert values(spark, A.decode(A.encode(S, a), a), list(A.alphabet(a))) == list(A.alphabet(a))
    assert values(spark, A.try_encode(S, "DNA2"), ["A", "t", "N", "", None]) == [0, 3, None, None, None]
    fails(spark, A.encode(S, "DNA2"), "N")
    fails(spark, A.decode(C("i"), "DNA2"), (4,), "i int")
    assert values(spark, A.is_compatible(S, T, "DNA4"), [("N", "A"), ("-", "N"), ("S", "W")], "s string, t string") == [True, False, False]
    assert values(spark, A.symbol_is(S, "purine"), list("AGRCT")) == [True, True, True, False, False]


# parsing

def test_parsing(spark):
    assert values(spark, parse.parse(S, "DNA4"), ["acgtn-", "", None]) == ["ACGTN-", "", None]
    assert values(spark, parse.try_parse(S, "DNA2"), ["acgT", "ACGN", "ß", "ACU"]) == ["ACGT", None, None, None]
    with pytest.raises(Exception, match=r"cannot encode byte 0x55 \('U'\) at index 3 in DNA4"):
        values(spark, parse.parse(S, "DNA4"), ["ACU"])
    assert values(spark, parse.guess_alphabet(S), ["", "CGGUAG", "HKW--", "WU", "PLBMW", "QMN!KK", "TU", "acgt"]) == ["DNA2", "RNA2", "DNA4", "RNA4", "AA", None, "AA", "DNA2"]
    assert values(spark, parse.bad_guess(S), ["QMN!KK", "AC"]) == [4, None]
    assert values(spark, parse.bioseq(S), ["acg", "PL"]) == [("DNA2", "ACG"), ("AA", "PL")]
    fails(spark, parse.bioseq(S), "A!")
    assert values(spark, parse.parse_part(S, 2, 3, "DNA2"), ["!AC!"]) == ["AC"]
    assert values(spark, parse.from_symbols(F.split(S, ","), "DNA2"), ["a,c,g"]) == ["ACG"]
    assert values(spark, parse.parse_bytes(S.cast("binary"), "RNA2"), ["acgu"]) == ["ACGU"]
    assert values(spark, parse.dna("ac\r\ngt"), ["x"]) == ["ACGT"]
    with pytest.raises(ValueError):
        parse.rna("ACT")


def test_conversion(spark):
    assert values(spark, parse.convert(S, "DNA4", "RNA4"), ["ACT-N"]) == ["ACU-N"]
    assert values(spark, parse.convert(S, "RNA2", "DNA4"), ["ACU"]) == ["ACT"]
    assert values(spark, parse.convert(S, "DNA4", "DNA2"), ["ACGT"]) == ["ACGT"]
    fails(spark, parse.convert(S, "DNA4", "DNA2"), "ACN")
    with pytest.raises(TypeError):
        parse.convert(S, "AA", "DNA4")


# indexing and mutators

def test_indexing(spark):
    assert values(spark, edit.at(S, 3), ["ACGT"]) == ["G"] and values(spark, edit.try_at(S, 9), ["ACGT"]) == [None]
    assert values(spark, edit.part(S, 2, 3), ["ACGT"]) == ["CG"] and values(spark, edit.part(S, 90, 89), ["ACGT"]) == [""]
    assert values(spark, edit.gather(S, F.array(F.lit(4), F.lit(1), F.lit(1))), ["ACGT"]) == ["TAA"]
    assert values(spark, edit.masked(S, F.array(*map(F.lit, (True, False, True)))), ["ACG"]) == ["AG"]
    for bad in (edit.at(S, 0), edit.at(S, 5), edit.part(S, 3, 5), edit.gather(S, F.array(F.lit(5))), edit.masked(S, F.array(F.lit(True))), edit.put_range(S, 1, 2, "A"), edit.insert(S, 6, "A"), edit.splice(S, 3, 2, "A"), edit.delete(S, 4, 5), edit.resize(S, 5), edit.copy_into(S, 4, "AC")):
        fails(spark, bad, "ACGT")


def test_views_compose(spark):
    view = edit.View.of(S, 3, 10).part(2, 7).part(2, 4)
    assert values(spark, F.struct(view.text(), view.size, view.in_parent(2), view.at(3), view.put("ttt")), ["ABCDEFGHIJKL"]) == [("EFG", 3, 6, "G", "ABCDtttHIJKL")]
    assert values(spark, edit.View.of(S).part(3, 2).text(), ["ACG"]) == [""]
    for bad in (view.part(1, 4).text(), view.at(4), edit.View.of(S, 2, 13).text(), edit.View.of(S, 2, 5).part(0, 2).text()):
        fails(spark, bad, "ABCDEFGHIJKL")


def test_copying_text(spark):
    assert values(spark, edit.copy_text(S, 2, T, "DNA2", 3, 2), [("AAAA", "!!cg!")], "s string, t string") == ["ACGA"]
    assert values(spark, edit.copy_text(S, 1, T, "DNA4"), [("AAAA", "nn")], "s string, t string") == ["NNAA"]
    for bad in (("AAAA", "cx"), ("AA", "acg")):
        fails(spark, edit.copy_text(S, 1, T, "DNA2"), bad, "s string, t string")


def test_masked_replacement_equals_plain_python(spark):
    rows = [r for r in randomly(random.Random(2), "ACGT", (0, 1, 9, 40), 3)]
    new = ["".join(random.Random(k).choices("NRY", k=sum(c in "AT" for c in r))) for k, r in enumerate(rows)]
    want = []
    for r, x in zip(rows, new, strict=True):
        it = iter(x)
        want.append("".join(next(it) if c in "AT" else c for c in r))
    mask = F.transform(A.symbols_of(S), lambda c: c.isin("A", "T"))
    assert values(spark, edit.put_masked(S, mask, T), list(zip(rows, new, strict=True)), "s string, t string") == want
    fails(spark, edit.put_masked(S, mask, F.lit("N")), "AAC")


@pytest.mark.parametrize(("col", "want"), [
    (edit.put(S, 2, "T"), "ATGTA"), (edit.put_range(S, 2, 3, "AA"), "AAATA"), (edit.put_at(S, F.array(F.lit(1), F.lit(5), F.lit(1)), "CGT"), "TCGTG"),
    (edit.put_masked(S, F.array(*map(F.lit, (True, False, False, False, True))), "GG"), "GCGTG"), (edit.copy_into(S, 2, "TTTT", 1, 2), "ATTTA"),
    (edit.push(S, "C"), "ACGTAC"), (edit.push_first(S, "C"), "CACGTA"), (edit.insert(S, 1, "G"), "GACGTA"), (edit.insert(S, 6, "G"), "ACGTAG"),
    (edit.splice(S, 2, 4, "NNNN"), "ANNNNA"), (edit.splice(S, 5, 5, ""), "ACGT"), (edit.delete(S, 1), "CGTA"), (edit.delete(S, 2, 4), "AA"), (edit.delete(S, 2, 1), "ACGTA"),
    (edit.append(S, "GG", "T"), "ACGTAGGT"), (edit.resize(S, 2), "AC"), (edit.pop(S)["rest"], "ACGT"), (edit.pop_first(S)["sym"], "A"),
])
def test_mutators(spark, col, want):
    assert values(spark, col, ["ACGTA"]) == [want]


def test_pop_of_nothing(spark):
    fails(spark, edit.pop(S), "")
    fails(spark, edit.pop_first(S), "")


# transformations

def test_transformations_equal_plain_python(spark):
    rows = randomly(random.Random(1), "-ACMGRSVTWYHKDBN")
    comp = ["".join(COMPLEMENT[c] for c in r) for r in rows]
    assert values(spark, transform.complement(S), rows) == comp
    assert values(spark, transform.reverse_complement(S), rows) == [c[::-1] for c in comp]
    assert values(spark, transform.reverse_complement(transform.reverse_complement(S)), rows) == rows
    key = lambda s: [A.DNA_ORDER.index(c) for c in s]
    assert values(spark, transform.canonical(S), rows) == [min(r, c[::-1], key=key) for r, c in zip(rows, comp, strict=True)]
    assert values(spark, transform.is_canonical(S), rows) == [key(r) <= key(c[::-1]) for r, c in zip(rows, comp, strict=True)]
    assert values(spark, transform.is_palindromic(S), [*rows, "ANT", "ACNT"]) == [r == c[::-1] for r, c in zip(rows, comp, strict=True)] + [True, False]
    assert values(spark, transform.ungap(S), rows) == [r.replace("-", "") for r in rows]
    assert values(spark, transform.complement(S, "RNA"), ["ACGUMK"]) == ["UGCAKM"]
    assert [sorted(x) for x in values(spark, transform.shuffle(S, 3), rows)] == [sorted(x) for x in rows]


def test_amino_order(spark):
    rows = [(a, b) for a, b in itertools.product(["", "A", "R", "AR", "AA", "*", "-", "X"], repeat=2)]
    key = lambda s: [A.AMINO_ORDER.index(c) for c in s]
    assert values(spark, transform.less(S, T, "AA"), rows, "s string, t string") == [key(a) < key(b) for a, b in rows]


def test_repetition(spark):
    def longest(s):
        return max((len(list(g)) for _, g in itertools.groupby(s)), default=0)

    rows = [*randomly(random.Random(2), "AC", (0, 1, 2, 3, 8)), "AAGT"]
    for n in range(5):
        assert values(spark, transform.is_repetitive(S, n), rows) == [longest(r) >= n for r in rows]
    assert values(spark, transform.is_repetitive(S, C("n")), [(r, 2) for r in rows], "s string, n int") == [longest(r) >= 2 for r in rows]
    assert values(spark, transform.is_repetitive(S), rows) == [longest(r) == len(r) for r in rows]
    with pytest.raises(ValueError):
        transform.is_repetitive(S, -1)


def test_combination(spark):
    assert values(spark, transform.keep(S, "AC"), ["ACGTCA", ""]) == ["ACCA", ""]
    assert values(spark, transform.keep(S, lambda c: c != "A"), ["ACGA"]) == ["CG"] and values(spark, transform.drop(S, "A"), ["ACGA"]) == ["CG"]
    assert values(spark, transform.replace_symbols(S, {"A": "T"}), ["ACA"]) == ["TCT"] and values(spark, transform.replace_symbols(S, lambda c: F.lit("N")), ["ACA"]) == ["NNN"]
    assert values(spark, transform.join(F.array(S, T, S)), [("A", "CG")], "s string, t string") == ["ACGA"] and values(spark, transform.repeat(S, 3), ["AC"]) == ["ACACAC"]
    assert values(spark, transform.equals(S, S, "DNA", "RNA"), ["A", ""]) == [False, True]
    assert values(spark, transform.has_ambiguity(S), ["ACGT-", "ACN"]) == [False, True] and values(spark, transform.has_ambiguity(S, "DNA2"), ["ACG"]) == [False]


# counting

def test_counting(spark):
    rows = [*randomly(random.Random(3), "-ACMGRSVTWYHKDBN"), None]
    count = lambda kinds: [None if r is None else sum(c in kinds for c in r) for r in rows]
    assert values(spark, counting.count_gc(S), rows) == count("CGS") and values(spark, counting.count_gaps(S), rows) == count("-")
    assert values(spark, counting.count_ambiguous(S), rows) == count("MRSVWYHKDBN") and values(spark, counting.count_certain(S), rows) == count("ACGT")
    assert values(spark, counting.count_symbol(S, "N"), rows) == count("N") and values(spark, counting.count_where(S, lambda c: c == "N"), rows[:-1]) == count("N")[:-1]
    got = values(spark, counting.gc_content(S), ["", "AC", "SN"])
    assert got[0] != got[0] and got[1:] == [0.5, 0.5]
    with pytest.raises(ValueError):
        counting.count_symbol(S, "E")
    assert values(spark, counting.count_certain(S, "AA"), ["AB*-X"]) == [2]


def test_pairs(spark):
    rows = [("TAWNNA", "TACCTA"), ("TAGCTA", "TACNTA"), ("AACA", "AAG"), ("", "A"), ("A-N", "-AC")]
    schema = "s string, t string"
    assert values(spark, counting.matches(S, T), rows, schema) == [3, 4, 2, 0, 0]
    assert values(spark, counting.mismatches(S, T), rows, schema) == [3, 2, 1, 0, 3]
    assert values(spark, counting.mismatches(S, T, "DNA", "RNA"), rows, schema) == [6, 6, 3, 0, 3]
    assert values(spark, counting.pair_gaps(S, T), rows, schema) == [0, 0, 0, 0, 2]
    assert values(spark, counting.pair_ambiguous(S, T), rows, schema) == [3, 1, 0, 0, 1]
    assert values(spark, counting.pair_certain(S, T), rows, schema) == [3, 5, 3, 0, 0]


# translation

@pytest.mark.parametrize("number", sorted(translation.CODES))
def test_all_codons_of_a_code(spark, number):
    sets = {c: [x for x in "ACGT" if A.DNA4.compatible(c, x)] for c in translation.BASES}
    code, rows, want = translation.genetic_code(number), [], []
    for codon in itertools.product(translation.BASES, repeat=3):
        found = {code["".join(x)] for x in itertools.product(*(sets[c] for c in codon))}
        rows.append("".join(codon))
        want.append(found.pop() if len(found) == 1 else {"DN": "B", "IL": "J", "EQ": "Z"}.get("".join(sorted(found)), "X"))
    whole = "".join(rows)
    assert values(spark, translation.translate(S, number), [whole, whole.replace("T", "U")]) == ["".join(want)] * 2


def test_translation_options(spark):
    rows = {"YUGMGG": "LR", "GAYGARGAM": "DEX", "MUCGGG": "JG", "AAASAAUUU": "KZF", "GAN": "X", "": ""}
    assert values(spark, translation.translate(S), list(rows)) == list(rows.values())
    assert values(spark, translation.translate(S, alternative_start=True), ["GUGUAA", ""]) == ["M*", ""]
    assert values(spark, translation.translate(S, strict=False), ["AC", "A-C", None]) == [None, None, None]
    assert values(spark, translation.translate(S, allow_ambiguous=False), ["CUN", "ACG"]) == ["L", "T"]
    for s in ("ACGTACGT", "A-G"):
        fails(spark, translation.translate(S), s)
    fails(spark, translation.translate(S, allow_ambiguous=False), "GAN")
    assert translation.codes_table(spark).count() == 19 * 64 and "TTT F" in translation.show_code(1)


# text and random sequences

def test_display(spark):
    s = "ACGTACGTAC" * 10
    assert values(spark, display.wrapped(S, 70), [s, ""]) == [s[:70] + "\n" + s[70:], ""] and values(spark, display.wrapped(S, 50), [s]) == [s[:50] + "\n" + s[50:]]
    assert values(spark, display.wrapped(S, 0), [s]) == [s] and values(spark, display.summary(S, "AA"), ["AR"]) == ["2aa Amino Acid Sequence"]
    assert values(spark, display.shown(S, 10), ["", "ACGT", s]) == ["< EMPTY SEQUENCE >", "ACGT", "ACGT…GTAC"]
    assert values(spark, display.described(S), ["ACG"]) == ["3nt DNA Sequence:\nACG"]


def test_random_sequences(spark):
    keys = list(range(400))
    a = values(spark, rand.randdna(50, key=C("i"), seed=1), [(k,) for k in keys], "i int")
    assert a == values(spark, rand.randdna(50, key=C("i"), seed=1), [(k,) for k in keys], "i int") and len(set(a)) == 400
    joined = "".join(a)
    assert all(abs(joined.count(c) / len(joined) - 0.25) < 0.02 for c in "ACGT") and set(joined) == set("ACGT")
    skew = rand.WeightedSampler(("A", "C", "N"), (0.7, 0.2))
    joined = "".join(values(spark, rand.randseq("DNA4", 50, key=C("i"), sampler=skew), [(k,) for k in keys], "i int"))
    assert abs(joined.count("A") / len(joined) - 0.7) < 0.03 and abs(joined.count("N") / len(joined) - 0.1) < 0.02
    assert set("".join(values(spark, rand.randaa(30, key=C("i")), [(k,) for k in keys], "i int"))) == set(A.AMINO_ORDER[:20])
    for symbols_, weights in ((("A",), (0.5,)), (("A", "C"), (1.2,)), (("A", "C"), (-0.1,))):
        with pytest.raises(ValueError):
            rand.WeightedSampler(symbols_, weights)
    fails(spark, rand.randdna(C("i"), key=C("i")), (-1,), "i int")


def test_random_draws_are_xxhash64_of_seed_key_and_place(spark):
    import struct

    import xxhash

    def draw(seed, key, i):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), h)
        return xxhash.xxh64_intdigest(struct.pack("<i", i), h) % rand.STEPS / rand.STEPS

    want = ["".join("ACGT"[int(4 * draw(1, k, i))] for i in range(1, 21)) for k in range(50)]
    assert values(spark, rand.randdna(20, key=C("i"), seed=1), [(k,) for k in range(50)], "i long") == want
    edges = (0.24, 0.48, 0.72, 0.96, 2.0)
    noisy = rand.WeightedSampler(tuple("ACGTN"), (0.24, 0.24, 0.24, 0.24))
    want = ["".join(next(s for s, e in zip("ACGTN", edges, strict=True) if draw(3, k, i) < e) for i in range(1, 21)) for k in range(50)]
    assert values(spark, rand.randseq("DNA4", 20, key=C("i"), seed=3, sampler=noisy), [(k,) for k in range(50)], "i long") == want


# symbol and exact search

def test_symbol_search(spark):
    s = "-ACNGW-"
    row = lambda c: values(spark, c, [s])[0]
    assert row(symbols.find_first(S, "ambiguous")) == 4 and row(symbols.find_last(S, "gap")) == 7 and row(symbols.find_next(S, "gap", 2)) == 7
    assert row(symbols.find_prev(S, "gap", 6)) == 1 and row(symbols.find_first(S, "T")) is None and row(symbols.find_first(S, "gap", negate=True)) == 2
    assert row(symbols.find_next(S, "gap", 8)) is None and row(symbols.find_prev(S, "gap", 0)) is None and row(symbols.find_all(S, "gap")) == [1, 7]
    assert row(symbols.find_where(S, lambda c: c.isin("G", "W"))) == 5 and row(symbols.find_last_where(S, lambda c: c.isin("G", "W"))) == 6
    assert values(spark, symbols.find_all(S, "gap"), ["", None]) == [[], None]
    fails(spark, symbols.find_next(S, "gap", 0), s)
    fails(spark, symbols.find_prev(S, "gap", 8), s)


def meets(q, a, b):
    return a == b if q.comparator == "isequal" else A.DNA4.compatible(a, b)


@pytest.mark.parametrize("comparator", ["isequal", "iscompatible"])
def test_exact_search_equals_brute_force(spark, comparator):
    rng = random.Random(4)
    rows = randomly(rng, "AACCGN-", (0, 1, 3, 12, 40))
    for pattern in ("", "A", "AC", "NA", "ANC", "A-"):
        q, m = ExactQuery(pattern, comparator), len(pattern)
        starts = [[i + 1 for i in range(len(r) - m + 1) if all(meets(q, a, b) for a, b in zip(pattern, r[i : i + m], strict=True))] for r in rows]
        span = lambda i: None if i is None else (i, i + m - 1)  # noqa: B023, E731
        assert values(spark, q.find_all(S), rows) == [[span(i) for i in x] for x in starts]
        apart = []
        for x in starts:
            last, kept = 0, []
            for i in x:
                if i > last or not m:
                    kept.append(span(i))
                    last = i + m - 1
            apart.append(kept)
        assert values(spark, q.find_all(S, overlap=False), rows) == apart
        for at in (-1, 1, 3, 100):
            assert values(spark, q.find_next(S, at), rows) == [span(next((i for i in x if i >= at), None)) for x in starts]
            assert values(spark, q.find_prev(S, at), rows) == [span(next((i for i in reversed(x) if i + m - 1 <= at), None)) for x in starts]
        assert values(spark, q.find_first(S), rows) == [span(x[0] if x else None) for x in starts]
        assert values(spark, q.find_last(S), rows) == [span(x[-1] if x else None) for x in starts]
        assert values(spark, q.occurs_in(S), rows) == [bool(x) for x in starts]


def test_exact_search_details(spark):
    q = ExactQuery("GATC", "iscompatible")
    assert [h[0] for h in values(spark, q.find_all(S), ["NNNNNGATCGATC"])[0]] == [1, 2, 6, 10]
    assert [h[0] for h in values(spark, q.find_all(S, overlap=False), ["NNNNNGATCGATC"])[0]] == [1, 6, 10]
    assert values(spark, ExactQuery("AC").find_all(S, first=3, last=6), ["ACACACAC"]) == [[(3, 4), (5, 6)]]
    with pytest.raises(TypeError):
        ExactQuery("ACU")
    with pytest.raises(ValueError):
        ExactQuery("A", "close")


def test_long_sequences_and_patterns(spark):
    rng = random.Random(5)
    s = "".join(rng.choices("ACGT", k=5000))
    df = table(spark, [(1, s), (2, ""), (3, "ACG")], "id int, s string")
    want = sorted((1, i + 1, i + 3) for i in range(len(s) - 2) if s[i : i + 3] == "ACG") + [(3, 1, 3)]
    for chunk in (7, 100, 10_000):
        assert sorted(map(tuple, hits.find_all_long(df, "s", ExactQuery("ACG"), "id", chunk=chunk).collect())) == want
    found = sorted(map(tuple, hits.find_patterns(df.filter("id = 3"), "s", ["AC", "CG", "T"], "id").collect()))
    assert found == [(3, "AC", 1, 2), (3, "CG", 2, 3)]
    assert {r["kmer"]: r["n"] for r in hits.spectrum(df.filter("id > 1"), "s", 2).collect()} == {"AC": 1, "CG": 1}


# approximate search

def edits(a, b, same):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (not same(x, y))))
        row = new
    return row[-1]


@pytest.mark.parametrize("comparator", ["isequal", "iscompatible"])
def test_approximate_search_equals_brute_force(spark, comparator):
    rng = random.Random(6)
    rows = ["", "A", *randomly(rng, "ACGN", (2, 5, 12), 6)]

    def first(s, pattern, k):
        same = lambda a, b: a == b if comparator == "isequal" else A.DNA4.compatible(a, b)
        for j in range(1, len(s) + 1):
            d, i = min((edits(pattern, s[i - 1 : j], same), i) for i in range(1, j + 2))
            if d <= k:
                return i, j
        return None

    for pattern, k in (("ACG", 0), ("ACG", 1), ("ACGAC", 2), ("NAC", 1)):
        q = ApproximateQuery(pattern, comparator)
        want = [first(r, pattern, k) for r in rows]
        assert values(spark, q.find_first(S, k), rows) == want
        assert values(spark, q.occurs_in(S, k), rows) == [w is not None for w in want]
        back = [first(r[::-1], pattern[::-1], k) for r in rows]
        assert values(spark, q.find_last(S, k), rows) == [w and (len(r) - w[1] + 1, len(r) - w[0] + 1) for r, w in zip(rows, back, strict=True)]
        later = [first(r[2:], pattern, k) for r in rows]
        assert values(spark, q.find_next(S, k, 3), rows) == [w and (w[0] + 2, w[1] + 2) for w in later]


def test_approximate_search_limits(spark):
    assert values(spark, ApproximateQuery("AC").find_next(S, 2, 3), ["ACGT"]) == [(3, 2)]
    with pytest.raises(ValueError):
        ApproximateQuery("A" * 65)
    with pytest.raises(ValueError):
        ApproximateQuery("A").find_first(S, -1)
    long = "T" * 150_000 + "GATTACA" + "T" * 50_000
    assert values(spark, ApproximateQuery("GATCACA").find_first(S, 1), [long]) == [(150_001, 150_007)]


def test_all_approximate_hits_and_other_comparators(spark):
    rng, group = random.Random(9), {"A": "R", "G": "R", "C": "Y", "T": "Y"}
    same_ring = lambda text, pattern: group[text] == group[pattern]
    rows = ["", "A", *randomly(rng, "ACGT", (3, 9, 30), 4)]
    for q, same, pattern, k in ((ApproximateQuery("ACGT"), str.__eq__, "ACGT", 1), (ApproximateQuery("ACGA", same_ring, "DNA2"), same_ring, "ACGA", 1)):
        want = []
        for r in rows:
            best = ((j, min((edits(pattern, r[i - 1 : j], lambda p, t: same(t, p)), i) for i in range(1, j + 2))) for j in range(1, len(r) + 1))
            want.append([(i, j) for j, (d, i) in best if d <= k])
        assert values(spark, q.find_all(S, k), [*rows, None]) == [*want, None]
    assert values(spark, ApproximateQuery("A").find_all(S, 1), ["AC"]) == [[(1, 0), (2, 1), (3, 2)]]


# regular expressions

@pytest.mark.parametrize(("pattern", "alphabet", "syntax", "text", "matched"), [
    ("A+", "DNA4", "pcre", "CAAT", "AA"), ("A+?", "DNA4", "pcre", "CAAT", "A"), ("A{2,}", "DNA4", "pcre", "ACAAA", "AAA"), ("A{,2}C", "DNA4", "pcre", "AAAC", "AAC"),
    ("A{2}", "DNA4", "pcre", "ACA", None), ("[AC]+G", "DNA4", "pcre", "TACG", "ACG"), ("[^A]", "DNA2", "pcre", "AAC", "C"), ("^C", "DNA4", "pcre", "AC", None),
    ("C$", "DNA4", "pcre", "CAC", "C"), ("a c | g t", "DNA4", "pcre", "GGT", "GT"), ("N", "DNA4", "pcre", "-R", "R"), ("A", "DNA4", "pcre", "CN", "N"),
    ("M-x-[DE]", "AA", "prosite", "GMQEA", "MQE"), ("<M", "AA", "prosite", "GM", None), ("{P}-P>", "AA", "prosite", "PPAP", "AP"), ("x(2,3)-C", "AA", "prosite", "GAVLC", "AVLC"),
    ("(AC)*T", "DNA2", "pcre", "ACACT", "ACACT"), ("A(C(G|T))?", "DNA2", "pcre", "ACTA", "ACT"),
])
def test_expressions(spark, pattern, alphabet, syntax, text, matched):
    rx = BioRegex(pattern, alphabet, syntax)
    assert values(spark, rx.matched(S), [text, None]) == [matched, None] and values(spark, rx.occurs_in(S), [text]) == [matched is not None]
    at = None if matched is None else text.index(matched) + 1
    if matched is not None and text.count(matched) == 1:
        assert values(spark, rx.find_first(S), [text]) == [(at, at + len(matched) - 1)] and values(spark, rx.match(S), [text])[0]["start"] == at


@pytest.mark.parametrize(("pattern", "syntax"), [("*", "pcre"), ("A{2,1}", "pcre"), ("(A", "pcre"), ("[A", "pcre"), ("E", "pcre"), ("A)", "pcre"), ("A{,}", "pcre"), ("A.C", "pcre"), ("A--C", "prosite"), ("A(", "prosite")])
def test_bad_expressions(pattern, syntax):
    with pytest.raises(ValueError):
        BioRegex(pattern, "DNA4", syntax)


def test_captures_and_iteration(spark):
    m = values(spark, BioRegex("A(C)?(G)?", "DNA2").match(S), ["TAG", "CC", ""])
    assert (m[0]["start"], m[0]["stop"], m[0]["matched"], m[0]["captured"]) == (2, 3, "AG", [None, "G"]) and m[1:] == [None, None]
    assert values(spark, BioRegex("A", "DNA2").match(S, 3)["start"], ["ACA", "A"]) == [3, None] and values(spark, BioRegex("^A", "DNA2").match(S, 2), ["AA"]) == [None]
    rx = BioRegex("A*", "DNA2")
    assert values(spark, rx.each(S), ["AAA", "CAA", "", "ACA", "AAC"]) == [["AAA"], ["", "AA"], [""], ["A", "A"], ["AA"]]
    assert values(spark, BioRegex("A+C", "DNA2").each_range(S), ["AACTAC", "T", ""]) == [[(1, 3), (5, 6)], [], []]
    ways = values(spark, rx.each_way(S), ["AAA", "", None])
    assert [w["matched"] for w in ways[0]] == ["AAA", "AA", "A", "", "AA", "A", "", "A", ""] and [w["matched"] for w in ways[1]] == [""] and ways[2] is None
    lazy = values(spark, BioRegex("A+?C?", "DNA2").each_way(S), ["AAC"])[0]
    assert [(w["start"], w["matched"]) for w in lazy] == [(1, "A"), (1, "AAC"), (1, "AA"), (2, "AC"), (2, "A")]
    fails(spark, BioRegex("(A|A)*", "DNA2").each_way(S, most=10), "A" * 8)


LONG = 200_000


@pytest.mark.parametrize(("pattern", "native", "text", "found"), [
    ("A(C|G)+T?", True, "A" + "CG" * (LONG // 2) + "T", ["A" + "CG" * (LONG // 2) + "T"]), ("(AC|G)+", False, "T" + "ACG" * (LONG // 3) + "T" + "G" * 9, ["ACG" * (LONG // 3), "G" * 9]),
    ("(A|C|G)+T?", True, "ACG" * (LONG // 3), ["ACG" * (LONG // 3)]), ("(A?C?){1000}G", False, "AC" * 500 + "G", ["AC" * 500 + "G"]), ("((A|C){2})+", True, "AC" * (LONG // 2) + "A", ["AC" * (LONG // 2)]),
    ("(A*)*", False, "", [""]), ("(A*C*)*", False, "TT", ["", ""]), ("A*", True, "", [""]), ("(?:A|CC)*?G", False, "CC" * (LONG // 4) + "G", ["CC" * (LONG // 4) + "G"]),
])
def test_expressions_on_long_and_empty_sequences(spark, pattern, native, text, found):
    rx = BioRegex(pattern, "DNA2")
    assert rx.native is native
    assert values(spark, rx.each(S), [text, None]) == [found, None]
    assert values(spark, rx.matched(S), [text]) == [found[0] if found else None] and values(spark, rx.occurs_in(S), [text, None]) == [bool(found), None]
    at = text.index(found[0]) + 1
    assert values(spark, rx.find_first(S), [text]) == [(at, at + len(found[0]) - 1)] and values(spark, rx.each_range(S), [text])[0][0] == (at, at + len(found[0]) - 1)


def test_every_way_on_long_sequences(spark):
    text = "C" * 5000 + "A" * 600 + "C" + "CG" * (LONG // 2)
    found = values(spark, BioRegex("A+C", "DNA2").each_way(S), [text])[0]
    assert [(w["start"], w["stop"]) for w in found] == [(k, 5601) for k in range(5001, 5601)]
    assert len(values(spark, BioRegex("^(CG|T)+$", "DNA2").each_way(S), ["CG" * (LONG // 2) + "T"])[0]) == 1
    caught = values(spark, BioRegex("(A|AC)(CG?)?T", "DNA2").each_way(S), ["ACGT"])[0]
    assert [(w["matched"], w["captured"]) for w in caught] == [("ACGT", ["A", "CG"])]


def every_way(pattern, text):
    """All ways of an expression over A and C made of literals, groups, | and *: by Python's own parser, one (start, end) for each."""
    from re import _parser

    def run(items, at):
        if not items:
            yield at
            return
        (op, arg), rest = items[0], items[1:]
        if str(op) == "LITERAL":
            if text[at : at + 1] == chr(arg):
                yield from run(rest, at + 1)
        elif str(op) == "IN":
            if text[at : at + 1] in [chr(c) for _, c in arg] and at < len(text):
                yield from run(rest, at + 1)
        elif str(op) == "BRANCH":
            for option in arg[1]:
                for end in run(list(option), at):
                    yield from run(rest, end)
        elif str(op) == "SUBPATTERN":
            for end in run(list(arg[3]), at):
                yield from run(rest, end)
        else:
            least, most, body = arg
            for end in run(list(body), at) if most else ():
                if end > at:
                    yield from run([(op, (max(least - 1, 0), most if most is _parser.MAXREPEAT else most - 1, body)), *rest], end)
            if not least:
                yield from run(rest, at)

    return [(s, e) for s in range(max(1, len(text))) for e in run(list(_parser.parse(pattern)), s)]


@pytest.mark.parametrize("pattern", ["A*C?", "(A|AC)*", "(A(C|A)*){1,2}", "((A|C)A)+C?"])
def test_every_way_equals_brute_force(spark, pattern):
    rows = ["", *randomly(random.Random(4), "AC", (1, 3, 7), 5)]
    found = values(spark, BioRegex(pattern, "DNA2").each_way(S), rows)
    assert [[(w["start"] - 1, w["stop"]) for w in f] for f in found] == [every_way(pattern, r) for r in rows]


@pytest.mark.parametrize("pattern", ["A{2,3}C", "A*?C{0}", "(A?|C)A{1,}?", "^A*C|(?:C|AC)+", "A{2}$"])
def test_every_way_over_runs_and_first_symbols(spark, pattern):
    rows = ["", "A", *randomly(random.Random(5), "AC", (1, 3, 7), 5)]
    found = values(spark, BioRegex(pattern, "DNA2").each_way(S), rows)
    whole = {r: [(i, j) for i in range(max(1, len(r))) for j in range(i, len(r) + 1) if re.compile(pattern).fullmatch(r[:j], i)] for r in rows}
    assert [sorted({(w["start"] - 1, w["stop"]) for w in f}) for f in found] == [whole[r] if not pattern.endswith("$") else [x for x in whole[r] if x[1] == len(r)] for r in rows]


def test_every_way_leaves_in_pieces(spark):
    rx, texts = BioRegex("(A+)C?", "DNA2"), ["A" * 60 + "C", None, "", "ACA"] * 100
    bits = dict(zip(rx.alphabet.symbols, rx.alphabet.bits, strict=True))
    tracemalloc.start()
    got = []
    for a in way_lists(rx.tree, pa.array(texts), rx.groups, bits):
        got += pc.list_value_length(a).to_pylist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [60 * 61 // 2 + 60, None, 0, 3] * 100 and most < 30 << 20
    assert values(spark, F.size(rx.each_way(S)), texts) == got
    fits = len("AAA") + 2 * len("AA") + 3 * len("A")
    assert len(list(way_lists(rx.tree, pa.array(["AAA"] * 9), rx.groups, bits, row=fits))) == 1
    with pytest.raises(ValueError, match="have 10 characters"):
        list(way_lists(rx.tree, pa.array(["A", "AAA"]), rx.groups, bits, row=fits - 1))


@pytest.mark.parametrize("pattern", ["A+C?", "(A|AC)*", "A*?C", "C$", "A{2,}", "[AC]+A?(?:C|CG)*?", "A+(AC?)+$", "[AC]{2,}^", "[^ACGT]+", "A+?C", "A*C", "A+", "A+(|C|G?)", "A{2,}(?:C?|$)"])
def test_ranges_of_every_way(spark, pattern):
    rx, rows = BioRegex(pattern, "DNA2"), [None, "", "A", "T", "AAC" * 9, *randomly(random.Random(7), "ACG", (2, 6, 12), 4)]
    found = values(spark, F.struct(rx.each_way(S).alias("ways"), rx.each_way_range(S).alias("ranges")), rows)
    assert [f["ways"] and [(w["start"], w["stop"]) for w in f["ways"]] for f in found] == [f["ranges"] and [tuple(w) for w in f["ranges"]] for f in found]
    assert found[0]["ranges"] is None and all(f["ranges"] is not None for f in found[1:])
    with pytest.raises(Exception, match="more than 5 ways"):
        values(spark, BioRegex("A+", "DNA2").each_way_range(S, most=5), ["A", "AAA"])
    assert values(spark, F.size(BioRegex("A+", "DNA2").each_way_range(S, most=6)), ["AAA", "AAA"]) == [6, 6]


def test_what_follows_a_run_is_matched_where_it_may_begin(monkeypatch):
    calls, on = [], regex.ways_on
    monkeypatch.setattr(regex, "ways_on", lambda *a: calls.append(0) or on(*a))
    rx = BioRegex("A+C?", "DNA2")
    a = list(way_ranges(rx.tree, pa.array(["A" * 500 + "C"]), rx.groups, dict(zip(rx.alphabet.symbols, rx.alphabet.bits, strict=True))))
    assert sum(len(x.values) for x in a) == 500 * 501 // 2 + 500 and len(calls) == 2


def test_ranges_of_ways_whose_texts_fit_no_row(spark, tmp_path):
    r = 2400
    rx, total = BioRegex("A+C?", "DNA2"), r * (r + 1) * (r + 2) // 6 + r * (r + 3) // 2
    ranges = rx.each_way_range(S)
    chars = F.aggregate(ranges, F.lit(0).cast("long"), lambda n, w: n + w["stop"] - w["start"] + 1)
    assert total > 2**31 and values(spark, F.struct(F.size(ranges).alias("n"), chars.alias("chars")), ["A" * r + "C", "AC"]) == [(r * (r + 1) // 2 + r, total), (2, 3)]
    bits = dict(zip(rx.alphabet.symbols, rx.alphabet.bits, strict=True))
    tracemalloc.start()
    sizes = [len(a.values) for a in way_ranges(rx.tree, pa.array(["A" * 700] * 3), rx.groups, bits)]  # texts of 57 MB each
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [700 * 701 // 2] * 3 and most < 20 << 20
    spark.createDataFrame([(1, "A" * r + "C", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(Exception, match=f"have {total} characters"):
        QUERIES["regex_every_way"](spark, str(tmp_path)).collect()


# matrices and consensus

def test_matrices(spark):
    df = table(spark, ["ACG", "ATG", "AGG", "ACC"])
    rows = {(r["pos"], r["sym"]): r["value"] for r in aggregates.pfm(df, "s").collect()}
    assert len(rows) == 12 and rows[1, "A"] == 4 and rows[1, "C"] == 0 and rows[2, "C"] == 2 and rows[3, "G"] == 3
    scores = {(r["pos"], r["sym"]): r["value"] for r in aggregates.pwm(aggregates.pfm(df, "s")).collect()}
    assert scores[1, "A"] == 2 and scores[1, "T"] == float("-inf") and scores[2, "C"] == 1
    prior = {"A": 0.4, "C": 0.3, "G": 0.2, "T": 0.1}
    assert {(r["pos"], r["sym"]): r["value"] for r in aggregates.pwm(aggregates.pfm(df, "s"), prior).collect()}[1, "A"] == pytest.approx(1.3219, abs=1e-4)
    assert aggregates.max_score(aggregates.pwm(aggregates.pfm(df, "s"))).first()["score"] == pytest.approx(2 + 1 + 1.585, abs=1e-3)
    assert query_of(df, "s").columns[0][0] == pytest.approx(math.log2(4.01 / 4.04 / 0.25))
    for bad in (["AC", "A"], [], ["EF"]):
        with pytest.raises(Exception, match="Mismatch|ArgumentError"):
            aggregates.pfm(table(spark, bad), "s").collect()
    with pytest.raises(ValueError):
        aggregates.pwm(aggregates.pfm(df, "s"), {"A": 1.0, "C": 0.0})


def test_matrix_access(spark):
    m = aggregates.matrix(spark, [[1, 2, 3, 4], [5, 6, 7, 8]], "RNA")
    assert sorted(map(tuple, aggregates.column_of(m, "U").collect())) == [(1, 4.0), (2, 8.0)]
    assert {(r["pos"], r["sym"]): r["value"] for r in aggregates.add_pseudo(aggregates.with_value(m, 2, "A", 0.0), 1).collect()}[2, "A"] == 1
    for bad in (lambda: aggregates.column_of(m, "N"), lambda: aggregates.with_value(m, 1, "R", 0.0), lambda: aggregates.matrix(spark, [[1, 2]])):
        with pytest.raises(ValueError):
            bad()


def test_scores_and_search(spark):
    m, s = PWM([[1.0, 0.0, 0.1, 0.9], [0.1, 0.2, 0.2, 0.5], [0.2, 0.3, 0.0, 0.2]]), "ACGATNATCGCGTANTG"
    assert m.max_score == pytest.approx(1.8) and values(spark, m.score_at(S, 1), [s]) == pytest.approx([1.2])
    for t, first, last in ((1.0, 1, 14), (1.4, 4, 7), (1.8, 7, 7), (2.0, None, None)):
        assert values(spark, m.find_first(S, t), [s]) == [first] and values(spark, m.find_last(S, t), [s]) == [last]
    assert values(spark, m.find_next(S, 1.4, 5), [s]) == [7] and values(spark, m.find_prev(S, 1.4, 6), [s]) == [4] and values(spark, m.find_all(S, 0.0), ["AC", ""]) == [[], []]
    fails(spark, m.score_at(S, 16), s)
    assert PWM([]).max_score == 0


def vote(column):
    n = [sum(c in s for c in column) for s in ("AMRWVHDN", "CMSYVHBN", "GRSKVDBN", "TWYKHDBN")]
    best = max(n)
    return "-" if column.count("-") > best else A.DNA_ORDER[sum(1 << k for k in range(4) if n[k] == best)]


def test_consensus(spark):
    rng = random.Random(7)
    for _ in range(4):
        rows = ["".join(rng.choices("--ACGTNRW", k=12)) for _ in range(rng.randint(1, 7))]
        assert aggregates.majority_vote(table(spark, rows), "s").first()["consensus"] == "".join(vote([r[i] for r in rows]) for i in range(12))
    grouped = aggregates.majority_vote(table(spark, [("x", "AC"), ("x", "AG"), (None, "TTT")], "g string, s string"), "s", by=("g",))
    assert {r["g"]: r["consensus"] for r in grouped.collect()} == {"x": "AS", None: "TTT"}
    with pytest.raises(Exception, match="Mismatch"):
        aggregates.majority_vote(table(spark, ["A", "AC"]), "s").collect()


def test_alignment_matrix_and_join(spark):
    df = table(spark, [(2, "AC"), (1, "GT")], "id int, s string")
    assert sorted(map(tuple, aggregates.seqmatrix(df, "s", "id", "DNA4").collect())) == [(1, 1, "G", 4), (1, 2, "T", 8), (2, 1, "A", 1), (2, 2, "C", 2)]
    assert sorted(map(tuple, aggregates.by_site(df, "s", "id").collect())) == [(1, ["G", "A"]), (2, ["T", "C"])]
    assert aggregates.join_ordered(df, "s", "id").first()["joined"] == "GTAC"
    assert values(spark, aggregates.one_hot(S), ["AN"]) == [[[True, False, False, False], [True] * 4]]
    with pytest.raises(Exception, match="Mismatch"):
        aggregates.seqmatrix(table(spark, [(1, "A"), (2, "AC")], "id int, s string"), "s", "id").collect()
