"""Registered queries over sequences derived from ``documents``, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import counting, display, edit, parse, random, transform, translation
from ..operators import aggregates, hits
from ..search import symbols
from ..search.approx import ApproximateQuery
from ..search.exact import ExactQuery
from ..search.pwm import PWM, query_of
from ..search.regex import ROW, BioRegex
from ..sources.tables import from_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C = F.col

#: The derived sequences in SQL; each twin reads them from s.
DERIVED = """WITH d AS (
  SELECT doc_id, lang, source, text, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS dna2,
         upper(regexp_replace(text, '[^ACGTMRWSYKVHDBNacgtmrwsykvhdbn-]', '', 'g')) AS dna4,
         upper(regexp_replace(text, '[^ARNDCQEGHILKMFPSTWYVOUBJZXarndcqeghilkmfpstwyvoubjzx*-]', '', 'g')) AS aa
  FROM documents
), s AS (
  SELECT *, replace(dna2, 'T', 'U') AS rna2, left(dna2, 3 * (length(dna2) // 3)) AS cds,
         reverse(translate(dna2, 'ACGT', 'TGCA')) AS rc2,
         reverse(translate(dna4, 'ACGTMRYKVHDB', 'TGCAKYRMBDHV')) AS rc4,
         translate(dna4, '-ACMGRSVTWYHKDBN', '0123456789:;<=>?') AS key4
  FROM d
)
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(documents(spark, sf_dir))


def query(sql: str | None = None, derived: bool = True):
    """Registers a function of the sequences as a query; ``sql`` is its twin."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(sequences(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (DERIVED if derived else "") + sql
        return f

    return put


def query_docs(sql: str | None = None):
    """The same for a function of ``documents`` itself."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(documents(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = DERIVED + sql
        return f

    return put


def picked(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("doc_id", *[c.alias(n) for n, c in columns.items()])


def parts(hit: Column, name: str) -> dict[str, Column]:
    return {f"{name}_start": hit["start"], f"{name}_stop": hit["stop"]}


# transformations and order

@query("SELECT doc_id, rc4 AS revcomp, CASE WHEN key4 <= translate(rc4, '-ACMGRSVTWYHKDBN', '0123456789:;<=>?') THEN dna4 ELSE rc4 END AS canonical, CASE WHEN length(dna4) = 0 THEN 'NaN'::DOUBLE ELSE length(regexp_replace(dna4, '[^CGS]', '', 'g')) / length(dna4) END AS gc FROM s")
def revcomp_canonical(s):
    return picked(s, revcomp=transform.reverse_complement(C("dna4")), canonical=transform.canonical(C("dna4")), gc=counting.gc_content(C("dna4")))


@query("SELECT doc_id, reverse(dna4) AS rev, translate(dna4, 'ACGTMRYKVHDB', 'TGCAKYRMBDHV') AS comp, translate(rna2, 'ACGU', 'UGCA') AS rna_comp, reverse(aa) AS aa_rev FROM s")
def reverse_complement_parts(s):
    return picked(s, rev=transform.reverse(C("dna4")), comp=transform.complement(C("dna4")), rna_comp=transform.complement(C("rna2"), "RNA"), aa_rev=transform.reverse(C("aa")))


@query("SELECT doc_id, replace(dna4, '-', '') AS ungapped, regexp_replace(dna4, '[^ACGT]', '', 'g') AS certain, translate(dna2, 'ACGT', 'GTAC') AS mapped, dna2 || dna4 AS joined, repeat(left(dna2, 5), 3) AS thrice FROM s")
def filter_map_concat(s):
    d = C("dna4")
    return picked(s, ungapped=transform.ungap(d), certain=transform.keep(d, "ACGT"), mapped=transform.replace_symbols(C("dna2"), {"A": "G", "C": "T", "G": "A", "T": "C"}), joined=transform.concat(C("dna2"), d), thrice=transform.repeat(F.left("dna2", F.lit(5)), 3))


@query("SELECT doc_id, key4 AS order_key, key4 < translate(rc4, '-ACMGRSVTWYHKDBN', '0123456789:;<=>?') AS lesser, dna4 = rc4 AS same FROM s")
def ordering(s):
    d = C("dna4")
    rc = transform.reverse_complement(d)
    return picked(s, order_key=transform.order_key(d), lesser=transform.less(d, rc), same=transform.equals(d, rc))


@query("SELECT doc_id, translate(aa, 'ARNDCQEGHILKMFPSTWYVOUBJZX*-', '0123456789:;<=>?@ABCDEFGHIJK') AS order_key FROM s")
def amino_ordering(s):
    return picked(s, order_key=transform.order_key(C("aa"), "AA"))


@query("""SELECT doc_id, dna4 = rc4 AS palindromic, regexp_matches(dna4, '[MRWSYKVHDBN]') AS ambiguous, key4 <= translate(rc4, '-ACMGRSVTWYHKDBN', '0123456789:;<=>?') AS canonical,
  regexp_matches(dna2, 'AAA|CCC|GGG|TTT') AS run3, regexp_matches(dna2, '^(A*|C*|G*|T*)$') AS uniform, regexp_matches(aa, '[BJZX]') AS aa_ambiguous FROM s""")
def predicates(s):
    d = C("dna4")
    return picked(s, palindromic=transform.is_palindromic(d), ambiguous=transform.has_ambiguity(d), canonical=transform.is_canonical(d), run3=transform.is_repetitive(C("dna2"), 3), uniform=transform.is_repetitive(C("dna2")), aa_ambiguous=transform.has_ambiguity(C("aa"), "AA"))


@query("SELECT count(DISTINCT dna2) AS n_distinct, count(*) AS n FROM s")
def distinct_by_hash(s):
    return s.agg(F.count_distinct(transform.hashed(C("dna2"))).alias("n_distinct"), F.count("*").alias("n"))


# counting

@query("SELECT doc_id, CASE WHEN length(dna4) = 0 THEN 'NaN'::DOUBLE ELSE length(regexp_replace(dna4, '[^CGS]', '', 'g')) / length(dna4) END AS gc FROM s")
def gc_content(s):
    return picked(s, gc=counting.gc_content(C("dna4")))


@query("""SELECT doc_id, CAST(length(regexp_replace(dna4, '[^CGS]', '', 'g')) AS INT) AS gc, CAST(length(regexp_replace(dna4, '[^-]', '', 'g')) AS INT) AS gaps,
  CAST(length(regexp_replace(dna4, '[^MRWSYKVHDBN]', '', 'g')) AS INT) AS ambiguous, CAST(length(regexp_replace(dna4, '[^ACGT]', '', 'g')) AS INT) AS certain,
  CAST(length(regexp_replace(aa, '[^ARNDCQEGHILKMFPSTWYVOU*]', '', 'g')) AS INT) AS aa_certain, CAST(length(regexp_replace(dna4, '[^N]', '', 'g')) AS INT) AS n FROM s""")
def symbol_counts(s):
    d = C("dna4")
    return picked(s, gc=counting.count_gc(d), gaps=counting.count_gaps(d), ambiguous=counting.count_ambiguous(d), certain=counting.count_certain(d), aa_certain=counting.count_certain(C("aa"), "AA"), n=counting.count_symbol(d, "N"))


@query("""SELECT doc_id, CAST(len(list_filter(range(1, length(dna2) + 1), lambda i: dna2[i] = rc2[i])) AS INT) AS matches,
  CAST(length(dna2) - len(list_filter(range(1, length(dna2) + 1), lambda i: dna2[i] = rc2[i])) AS INT) AS mismatches,
  CAST(least(length(dna2), length(rna2)) AS INT) AS across FROM s""")
def pair_matches(s):
    a, b = C("dna2"), transform.reverse_complement(C("dna2"))
    return picked(s, matches=counting.matches(a, b), mismatches=counting.mismatches(a, b), across=counting.mismatches(a, C("rna2"), "DNA", "RNA"))


@query("""SELECT doc_id, CAST(len(list_filter(range(1, length(dna4) + 1), lambda i: dna4[i] = '-' OR r[i] = '-')) AS INT) AS gaps,
  CAST(len(list_filter(range(1, length(dna4) + 1), lambda i: contains('MRSVWYHKDBN', dna4[i]) OR contains('MRSVWYHKDBN', r[i]))) AS INT) AS ambiguous,
  CAST(len(list_filter(range(1, length(dna4) + 1), lambda i: contains('ACGT', dna4[i]) AND contains('ACGT', r[i]))) AS INT) AS certain
  FROM (SELECT *, reverse(dna4) AS r FROM s)""")
def pair_counts(s):
    a, b = C("dna4"), F.reverse("dna4")
    return picked(s, gaps=counting.pair_gaps(a, b), ambiguous=counting.pair_ambiguous(a, b), certain=counting.pair_certain(a, b))


# parsing, alphabets, conversion

@query_docs("""SELECT doc_id, CASE WHEN regexp_matches(w, '^[ACGTacgt]*$') THEN 'DNA2' WHEN regexp_matches(w, '^[ACGUacgu]*$') THEN 'RNA2' WHEN regexp_matches(w, '^[ACMGRSVTWYHKDBNacmgrsvtwyhkdbn-]*$') THEN 'DNA4'
  WHEN regexp_matches(w, '^[ACMGRSVUWYHKDBNacmgrsvuwyhkdbn-]*$') THEN 'RNA4' WHEN regexp_matches(w, '^[ARNDCQEGHILKMFPSTWYVOUBJZXarndcqeghilkmfpstwyvoubjzx*-]*$') THEN 'AA' END AS guess, k
  FROM (SELECT doc_id, w, CAST(i AS INT) AS k FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS i FROM documents))""")
def guess_alphabets(docs):
    return words(docs).select("doc_id", "k", parse.guess_alphabet(C("w")).alias("guess"))


WORDS = "SELECT doc_id, unnest(string_split(text, ' ')) AS w, CAST(unnest(range(0, len(string_split(text, ' ')))) AS INT) AS k FROM documents"


def words(docs):
    return docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("k", "w"))


@query_docs(f"""SELECT doc_id, k, CASE WHEN regexp_matches(w, '^[ACGTMRWSYKVHDBNacgtmrwsykvhdbn-]*$') THEN upper(w) END AS parsed,
  CAST(instr(regexp_replace(w, '[^ARNDCQEGHILKMFPSTWYVOUBJZXarndcqeghilkmfpstwyvoubjzx*-]', '!', 'g'), '!') AS INT) AS bad FROM ({WORDS})""".join(["SELECT * FROM (", ")"]))
def try_parsing(docs):
    return words(docs).select("doc_id", "k", parse.try_parse(C("w"), "DNA4").alias("parsed"), parse.bad_index(C("w"), "AA").alias("bad"))


@query("SELECT doc_id, 'ACGTN-' AS dna, 'ACGU' AS rna, 'MK*' AS protein, '' AS none, dna4 AS part, dna4 AS bytes, dna2 AS symbols FROM s")
def parse_parts(s):
    d = C("dna4")
    return picked(
        s, dna=parse.dna("acg\r\ntn-"), rna=parse.rna("acgu"), protein=parse.aa("mk*"), none=parse.empty(), part=parse.parse_part(F.concat(F.lit("!?"), F.lower(d), F.lit("!")), F.lit(3), F.length(d) + 2, "DNA4"),
        bytes=parse.parse_bytes(d.cast("binary"), "DNA4"), symbols=parse.from_symbols(A.symbols_of(F.lower("dna2")), "DNA2"),
    )


@query_docs(f"""SELECT doc_id, k, CASE WHEN regexp_matches(w, '^[ACGTacgt]*$') THEN 'DNA2' WHEN regexp_matches(w, '^[ACGUacgu]*$') THEN 'RNA2' WHEN regexp_matches(w, '^[ACMGRSVTWYHKDBNacmgrsvtwyhkdbn-]*$') THEN 'DNA4'
  WHEN regexp_matches(w, '^[ACMGRSVUWYHKDBNacmgrsvuwyhkdbn-]*$') THEN 'RNA4' WHEN regexp_matches(w, '^[ARNDCQEGHILKMFPSTWYVOUBJZXarndcqeghilkmfpstwyvoubjzx*-]*$') THEN 'AA' END AS alphabet,
  CASE WHEN regexp_matches(w, '^[ARNDCQEGHILKMFPSTWYVOUBJZXarndcqeghilkmfpstwyvoubjzx*-]*$') THEN upper(w) END AS seq FROM ({WORDS})""".join(["SELECT * FROM (", ")"]))
def bioseqs(docs):
    found = parse.bioseq(C("w"))
    fits = parse.guess_alphabet(C("w")).isNotNull()
    return words(docs).select("doc_id", "k", F.when(fits, found["alphabet"]).alias("alphabet"), F.when(fits, found["seq"]).alias("seq"))


ALPHABETS = ("DNA2", "RNA2", "DNA4", "RNA4", "AA")
ORACLES["alphabets"] = """SELECT name, substr(syms, CAST(i AS INT), 1) AS symbol, CAST(i - 1 AS INT) AS code, CAST(length(syms) AS INT) AS size, CAST(w AS INT) AS bits_per_symbol, 2 ** w = length(syms) AS complete,
  CAST(CASE WHEN w = 2 THEN 2 ** (i - 1) WHEN w = 4 THEN i - 1 ELSE CASE substr(syms, CAST(i AS INT), 1) WHEN 'B' THEN 12 WHEN 'J' THEN 1536 WHEN 'Z' THEN 96 WHEN 'X' THEN 4194303 WHEN '*' THEN 0 WHEN '-' THEN 0 ELSE 2 ** (i - 1) END END AS INT) AS bits
  FROM (VALUES ('DNA2', 'ACGT', 2), ('RNA2', 'ACGU', 2), ('DNA4', '-ACMGRSVTWYHKDBN', 4), ('RNA4', '-ACMGRSVUWYHKDBN', 4), ('AA', 'ARNDCQEGHILKMFPSTWYVOUBJZX*-', 8)) v(name, syms, w), range(1, 29) r(i) WHERE i <= length(syms)"""
QUERIES["alphabets"] = lambda spark, sf_dir: spark.createDataFrame(
    [(a.name, c, k, len(a), a.bits_per_symbol, a.complete, a.compat(c)) for a in map(A.alphabet, ALPHABETS) for k, c in enumerate(a)],
    "name string, symbol string, code int, size int, bits_per_symbol int, complete boolean, bits int",
)


def _promoted(a: str, b: str) -> str | None:
    try:
        return A.promote(a, b).name
    except TypeError:
        return None


ORACLES["promotion"] = """SELECT a, b, CASE WHEN left(a, 1) <> left(b, 1) THEN NULL WHEN a LIKE '%4' THEN a ELSE b END AS wider
  FROM (VALUES ('DNA2'), ('RNA2'), ('DNA4'), ('RNA4'), ('AA')) x(a), (VALUES ('DNA2'), ('RNA2'), ('DNA4'), ('RNA4'), ('AA')) y(b)"""
QUERIES["promotion"] = lambda spark, sf_dir: spark.createDataFrame([(a, b, _promoted(a, b)) for a in ALPHABETS for b in ALPHABETS], "a string, b string, wider string")


def _refused(call, kind: type[Exception]) -> bool:
    try:
        call()
    except kind:
        return True
    return False


#: What must be refused when a plan is built, and how.
REFUSALS = {
    "a pattern of another alphabet": (lambda: ExactQuery("ACU", a="DNA4"), TypeError),
    "an approximate pattern of another alphabet": (lambda: ApproximateQuery("ACU"), TypeError),
    "an approximate pattern of 65 symbols": (lambda: ApproximateQuery("A" * 65), ValueError),
    "a negative number of edits": (lambda: ApproximateQuery("ACG").find_first(F.lit("ACG"), -1), ValueError),
    "a literal with a foreign symbol": (lambda: parse.dna("ACU"), ValueError),
    "an expression that doesn't end": (lambda: BioRegex("A(C"), ValueError),
    "DNA from amino acids": (lambda: parse.convert(F.lit("A"), "AA", "DNA4"), TypeError),
    "a matrix of three rows": (lambda: PWM([[1.0, 2.0, 3.0]]), ValueError),
    "a matrix entry of an ambiguous symbol": (lambda: aggregates.one_base("N"), ValueError),
    "weights above one": (lambda: random.WeightedSampler(("A", "C", "G"), (0.7, 0.7)), ValueError),
    "a sampler without symbols": (lambda: random.UniformSampler(()), ValueError),
    "an alphabet with a symbol twice": (lambda: A.Alphabet("bad", "AA", (1, 2)), ValueError),
    "a known alphabet with other symbols": (lambda: A.register(A.Alphabet("DNA2", "ACTG", (1, 2, 4, 8), 2, "DNA")), ValueError),
}
ORACLES["refusals"] = "SELECT c AS what, true AS refused FROM (VALUES " + ", ".join("('" + k.replace("'", "''") + "')" for k in REFUSALS) + ") v(c)"
QUERIES["refusals"] = lambda spark, sf_dir: spark.createDataFrame([(k, _refused(*v)) for k, v in REFUSALS.items()], "what string, refused boolean")


@query_docs(f"SELECT doc_id, k, CASE WHEN regexp_matches(w, '[^ACGTacgt]') THEN NULL ELSE list_transform(list_filter(string_split(upper(w), ''), lambda c: c <> ''), lambda c: CAST(instr('ACGT', c) - 1 AS INT)) END AS codes FROM ({WORDS})".join(["SELECT * FROM (", ")"]))
def word_codes(docs):
    codes = F.transform(A.symbols_of(C("w")), lambda c: A.try_encode(c, "DNA2"))
    return words(docs).select("doc_id", "k", F.when(F.forall(codes, lambda x: x.isNotNull()), codes).alias("codes"))


@query("SELECT doc_id, rna2 AS rna, dna2 AS back, dna2 AS wide, dna2 AS narrow FROM s")
def conversions(s):
    wide = parse.convert(C("dna2"), "DNA2", "DNA4")
    return picked(s, rna=parse.convert(C("dna2"), "DNA2", "RNA2"), back=parse.convert(C("rna2"), "RNA2", "DNA2"), wide=wide, narrow=parse.convert(wide, "DNA4", "DNA2"))


@query("SELECT doc_id, CAST(i AS INT) AS site, dna4[i] AS sym, CAST(instr('ACMGRSVTWYHKDBN', dna4[i]) AS INT) AS code, dna4[i] AS back FROM (SELECT doc_id, dna4, unnest(range(1, length(dna4) + 1)) AS i FROM s)")
def encode_decode(s):
    sites = aggregates.sites(s, "dna4", "doc_id")
    code = A.encode(C("sym"), "DNA4")
    return sites.select("doc_id", "site", "sym", code.alias("code"), A.decode(code, "DNA4").alias("back"))


# indexing and edits; sequences too short for a place give nulls


def long_enough(sql: str) -> str:
    """The twin's columns where the sequence has 20 symbols; null elsewhere."""
    return f"SELECT s.doc_id, q.* EXCLUDE (doc_id) FROM s LEFT JOIN ({sql} FROM s WHERE length(dna2) >= 20) q ON q.doc_id = s.doc_id"


def where_long(s, **columns):
    return picked(s, **{n: F.when(F.length("dna2") >= 20, c) for n, c in columns.items()})


@query(long_enough("SELECT doc_id, dna2[3] AS third, dna2[2:9] AS part, dna2[9] || dna2[1] || dna2[5] AS gathered, left(dna2, 4) || right(dna2, 2) AS ends"))
def indexing(s):
    d = C("dna2")
    return where_long(s, third=edit.at(d, 3), part=edit.part(d, 2, 9), gathered=edit.gather(d, F.array(F.lit(9), F.lit(1), F.lit(5))), ends=F.concat(edit.part(d, 1, 4), edit.part(d, F.length(d) - 1, F.length(d))))


@query(long_enough("""SELECT doc_id, left(dna2, 4) || 'TTT' || substr(dna2, 5) AS inserted, left(dna2, 4) || 'G' || substr(dna2, 8) AS spliced, left(dna2, 1) || substr(dna2, 6) AS deleted,
  left(dna2, 2) || 'A' || substr(dna2, 4) AS put, left(dna2, 2) || 'CC' || substr(dna2, 5) AS put_range, left(dna2, 2) || dna2[10:12] || substr(dna2, 6) AS copied, left(dna2, 7) AS resized,
  right(dna2, 1) AS popped, 'A' || dna2 || 'C' AS pushed"""))
def edits(s):
    d = C("dna2")
    return where_long(s, inserted=edit.insert(d, 5, "TTT"), spliced=edit.splice(d, 5, 7, "G"), deleted=edit.delete(d, 2, 5), put=edit.put(d, 3, "A"), put_range=edit.put_range(d, 3, 4, "CC"), copied=edit.copy_into(d, 3, d, 10, 3), resized=edit.resize(d, 7), popped=edit.pop(d)["sym"], pushed=edit.push(edit.push_first(d, "A"), "C"))


@query(long_enough("SELECT doc_id, dna2[7:14] AS inner_text, CAST(8 AS INT) AS inner_size, CAST(9 AS INT) AS of_parent, dna2[9] AS third, left(dna2, 6) || 'ACGTACGT' || substr(dna2, 15) AS put"))
def views(s):
    inner = edit.View.of(C("dna2"), 5, 18).part(3, 12).part(1, 8)
    return where_long(s, inner_text=inner.text(), inner_size=inner.size, of_parent=inner.in_parent(3), third=inner.at(3), put=inner.put("ACGTACGT"))


@query(long_enough("SELECT doc_id, 'AC' || 'GTT' || substr(dna2, 6) AS from_text, left(dna2, 2) || dna2[4:6] || substr(dna2, 6) AS from_part, substr(dna2, 2) AS popped_first, '' AS emptied, left(dna2, 1) || 'TT' || dna2[4:5] || 'A' || substr(dna2, 7) AS placed"))
def copies(s):
    d = C("dna2")
    return where_long(s, from_text=edit.copy_text(d, 1, F.lit("acgtt"), "DNA2"), from_part=edit.copy_text(d, 3, F.lower(d), "DNA2", 4, 3), popped_first=edit.pop_first(d)["rest"], emptied=edit.resize(d, 0), placed=edit.put_at(d, F.array(F.lit(2), F.lit(6), F.lit(3)), "TAT"))


@query("SELECT doc_id, regexp_replace(dna2, '[^AC]', '', 'g') AS masked, translate(dna2, 'AC', 'GG') AS replaced FROM s")
def masks(s):
    d = C("dna2")
    mask = F.transform(A.symbols_of(d), lambda c: c.isin("A", "C"))
    return picked(s, masked=edit.masked(d, mask), replaced=edit.put_masked(d, mask, F.repeat(F.lit("G"), counting.count_symbols(d, "AC"))))


@query("SELECT doc_id, CAST(length(dna4) AS INT) AS size, length(dna4) = 0 AS nothing, CAST(length(dna4) AS INT) AS n_places, CAST(nullif(length(dna4), 0) AS INT) AS last_place, left(dna4, 1) AS first_symbol FROM s")
def lengths(s):
    d = C("dna4")
    places = A.sequence(F.length(d))
    return picked(s, size=F.length(d), nothing=F.length(d) == 0, n_places=F.when(d.isNotNull(), F.size(places)), last_place=F.element_at(F.when(F.size(places) > 0, places), -1), first_symbol=F.when(d.isNotNull(), F.coalesce(F.get(A.symbols_of(d), F.lit(0)), F.lit(""))))


@query("SELECT doc_id, array_to_string(list_sort(list_filter(string_split(dna2, ''), lambda c: c <> '')), '') AS in_order, CAST(length(dna2) AS INT) AS size FROM s")
def shuffled(s):
    mixed = transform.shuffle(C("dna2"), 7)
    return picked(s, in_order=F.array_join(F.sort_array(A.symbols_of(mixed)), ""), size=F.length(mixed))


# translation

# NCBI number, name, and the amino acids in NCBI's order of codons (TTT, TTC, TTA, TTG, TCT, ...), as published.
NCBI = (
    (1, "standard", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    (2, "vertebrate mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG"),
    (3, "yeast mitochondrial", "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    (4, "mold mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    (5, "invertebrate mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG"),
    (6, "ciliate nuclear", "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    (9, "echinoderm mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG"),
    (10, "euplotid nuclear", "FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    (11, "bacterial and plastid", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    (12, "alternative yeast nuclear", "FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    (13, "ascidian mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG"),
    (14, "alternative flatworm mitochondrial", "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG"),
    (15, "blepharisma macronuclear", "FFLLSSSSYY*QCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    (16, "chlorophycean mitochondrial", "FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    (21, "trematode mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG"),
    (22, "scenedesmus obliquus mitochondrial", "FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    (23, "thraustochytrium mitochondrial", "FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    (24, "pterobranchia mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG"),
    (25, "candidate division SR1", "FFLLSSSSYY**CCGWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
)


def _protein_sql(seq: str, code: int, bases: str = "TCAG") -> str:
    table = next(aas for k, _, aas in NCBI if k == code)
    return f"CASE WHEN {seq} IS NOT NULL THEN coalesce(array_to_string(list_transform(range(0, length({seq}) // 3), lambda i: substr('{table}', CAST(16 * (instr('{bases}', {seq}[3 * i + 1]) - 1) + 4 * (instr('{bases}', {seq}[3 * i + 2]) - 1) + instr('{bases}', {seq}[3 * i + 3]) AS INT), 1)), ''), '') END"


@query(f"SELECT doc_id, {_protein_sql('cds', 1)} AS protein FROM s")
def translate_standard(s):
    return picked(s, protein=translation.translate(C("cds")))


@query(f"SELECT doc_id, CASE WHEN length(cds) = 0 THEN '' ELSE 'M' || substr({_protein_sql('cds', 2)}, 2) END AS protein, {_protein_sql('cds', 25)} AS other FROM s")
def translate_other_codes(s):
    return picked(s, protein=translation.translate(C("cds"), 2, alternative_start=True), other=translation.translate(C("cds"), 25))


#: All codons of ambiguous symbols, by what their symbols stand for, and one string of their amino acids.
AMBIGUOUS = """, base AS (
  SELECT sym, ord, b FROM (SELECT substr('ACMGRSVTWYHKDBN', CAST(i AS INT), 1) AS sym, i AS ord FROM range(1, 16) r(i)), (VALUES ('A', 1), ('C', 2), ('G', 4), ('T', 8)) v(b, bit) WHERE ord & bit > 0
), codon AS (
  SELECT x.ord AS i, y.ord AS j, z.ord AS k, list_sort(list_distinct(list(substr('%s', CAST(16 * (instr('TCAG', x.b) - 1) + 4 * (instr('TCAG', y.b) - 1) + instr('TCAG', z.b) AS INT), 1)))) AS aas FROM base x, base y, base z GROUP BY ALL
), coded AS (
  SELECT string_agg(CASE WHEN len(aas) = 1 THEN aas[1] WHEN aas = ['D', 'N'] THEN 'B' WHEN aas = ['I', 'L'] THEN 'J' WHEN aas = ['E', 'Q'] THEN 'Z' ELSE 'X' END, '' ORDER BY i, j, k) AS tab FROM codon
)
""" % NCBI[0][2]
ORACLES["translate_ambiguous"] = DERIVED.rstrip() + AMBIGUOUS + """SELECT doc_id, CASE WHEN x IS NOT NULL THEN coalesce(array_to_string(list_transform(range(0, length(x) // 3), lambda i: substr(tab, CAST(225 * (instr('ACMGRSVTWYHKDBN', x[3 * i + 1]) - 1) + 15 * (instr('ACMGRSVTWYHKDBN', x[3 * i + 2]) - 1) + instr('ACMGRSVTWYHKDBN', x[3 * i + 3]) AS INT), 1)), ''), '') END AS protein
  FROM (SELECT doc_id, left(u, 3 * (length(u) // 3)) AS x FROM (SELECT doc_id, replace(dna4, '-', '') AS u FROM s)), coded"""


@query()
def translate_ambiguous(s):
    u = transform.ungap(C("dna4"))
    return picked(s, protein=translation.translate(F.left(u, (3 * F.floor(F.length(u) / 3)).cast("int"))))


ORACLES["genetic_codes"] = "SELECT CAST(c AS INT) AS code_id, n AS name, b[i // 16 + 1] || b[i // 4 % 4 + 1] || b[i % 4 + 1] AS codon, t[i + 1] AS aa FROM (VALUES " + ", ".join(f"({k}, '{name}', 'TCAG', '{aas}')" for k, name, aas in NCBI) + ") v(c, n, b, t), range(0, 64) r(i)"
QUERIES["genetic_codes"] = lambda spark, sf_dir: translation.codes_table(spark)


# search

@query("SELECT doc_id, CAST(i AS INT) AS start, CAST(i + 2 AS INT) AS stop FROM (SELECT doc_id, unnest(list_filter(range(1, length(dna2) - 1), lambda i: dna2[i : i + 2] = 'ATA')) AS i FROM s)")
def find_all_exact(s):
    return hits.hits_table(s, ExactQuery("ATA").find_all(C("dna2")), "doc_id")


@query("SELECT doc_id, CAST(i AS INT) AS start, CAST(i + 2 AS INT) AS stop FROM (SELECT doc_id, unnest(list_filter(range(1, length(dna4) - 1), lambda i: regexp_matches(dna4[i : i + 2], '^[AMRVWHDN][ACMGRSVTWYHKDBN][GRSVKDBN]$'))) AS i FROM s)")
def find_all_compatible(s):
    return hits.hits_table(s, ExactQuery("ANG", "iscompatible").find_all(C("dna4")), "doc_id")


@query("SELECT doc_id, regexp_extract_all(dna2, 'AA') AS found FROM s")
def find_all_apart(s):
    found = ExactQuery("AA").find_all(C("dna2"), overlap=False)
    return picked(s, found=F.transform(found, lambda h: F.substring(C("dna2"), h["start"], h["stop"] - h["start"] + 1)))


@query("""SELECT doc_id, CAST(nullif(instr(dna2, 'GAT'), 0) AS INT) AS first_start, CAST(nullif(instr(dna2, 'GAT'), 0) + 2 AS INT) AS first_stop,
  CAST(CASE WHEN instr(reverse(dna2), 'TAG') > 0 THEN length(dna2) - instr(reverse(dna2), 'TAG') - 1 END AS INT) AS last_start,
  CAST(CASE WHEN instr(reverse(dna2), 'TAG') > 0 THEN length(dna2) - instr(reverse(dna2), 'TAG') + 1 END AS INT) AS last_stop,
  CAST(CASE WHEN instr(substr(dna2, 10), 'GAT') > 0 THEN instr(substr(dna2, 10), 'GAT') + 9 END AS INT) AS next_start,
  CAST(CASE WHEN instr(substr(dna2, 10), 'GAT') > 0 THEN instr(substr(dna2, 10), 'GAT') + 11 END AS INT) AS next_stop, contains(dna2, 'GAT') AS occurs FROM s""")
def find_exact(s):
    q, d = ExactQuery("GAT"), C("dna2")
    return picked(s, **parts(q.find_first(d), "first"), **parts(q.find_last(d), "last"), **parts(q.find_next(d, 10), "next"), occurs=q.occurs_in(d))


@query("""SELECT doc_id, CAST(nullif(instr(regexp_replace(dna4, '[MRWSYKVHDBN]', '!', 'g'), '!'), 0) AS INT) AS ambiguous, CAST(nullif(instr(dna4, '-'), 0) AS INT) AS gap,
  CAST(nullif(instr(dna4, 'N'), 0) AS INT) AS n, CAST(CASE WHEN instr(reverse(dna4), 'A') > 0 THEN length(dna4) - instr(reverse(dna4), 'A') + 1 END AS INT) AS last_a,
  CAST(nullif(instr(regexp_replace(dna4, '[ACGT]', '!', 'g'), '!'), 0) AS INT) AS certain FROM s""")
def find_symbols(s):
    d = C("dna4")
    return picked(s, ambiguous=symbols.find_first(d, "ambiguous"), gap=symbols.find_first(d, "gap"), n=symbols.find_first(d, "N"), last_a=symbols.find_last(d, "A"), certain=symbols.find_first(d, "certain"))


@query("SELECT doc_id, list_transform(list_filter(range(1, length(dna4) + 1), lambda i: dna4[i] = 'N'), lambda i: CAST(i AS INT)) AS at FROM s")
def find_all_symbols(s):
    return picked(s, at=symbols.find_all(C("dna4"), "N"))


def _approximate_sql(x: str, pattern: str, k: int) -> str:
    """List of {j, w: {d, start}}: each end of ``x`` within k edits with its best window."""
    m = len(pattern)
    return f"list_filter(list_transform(range(1, length({x}) + 1), lambda j: {{'j': j, 'w': list_min(list_transform(range(greatest(1, j - {m + k - 1}), greatest(1, j - {m - k - 1}) + 1), lambda i: {{'d': levenshtein({x}[i:j], '{pattern}'), 'start': i}}))}}), lambda r: r.w.d <= {k})"


@query(f"SELECT doc_id, CAST(r.w.start AS INT) AS hit_start, CAST(r.j AS INT) AS hit_stop FROM (SELECT doc_id, {_approximate_sql('dna2', 'GATTAC', 2)}[1] AS r FROM s)")
def find_approximate(s):
    return picked(s, **parts(ApproximateQuery("GATTAC").find_first(C("dna2"), 2), "hit"))


@query(f"SELECT doc_id, CAST(r.w.start AS INT) AS start, CAST(r.j AS INT) AS stop FROM (SELECT doc_id, unnest({_approximate_sql('dna2', 'GATTACA', 1)}) AS r FROM s)")
def find_all_approximate(s):
    return hits.hits_table(s, ApproximateQuery("GATTACA").find_all(C("dna2"), 1), "doc_id")


@query(f"""SELECT doc_id, CAST(n - l.j + 1 AS INT) AS last_start, CAST(n - l.w.start + 1 AS INT) AS last_stop, CAST(least(n, 40) - p.j + 1 AS INT) AS prev_start, CAST(least(n, 40) - p.w.start + 1 AS INT) AS prev_stop,
  CAST(CASE WHEN n >= 10 THEN x.w.start + 9 END AS INT) AS next_start, CAST(CASE WHEN n >= 10 THEN x.j + 9 END AS INT) AS next_stop, CASE WHEN n IS NOT NULL THEN l IS NOT NULL END AS occurs,
  CAST(CASE WHEN n IS NOT NULL THEN 5 END AS INT) AS loose_start, CAST(CASE WHEN n IS NOT NULL THEN 4 END AS INT) AS loose_stop
  FROM (SELECT doc_id, length(dna2) AS n, {_approximate_sql('rev', 'TTAG', 1)}[1] AS l, {_approximate_sql('head', 'TTAG', 1)}[1] AS p, {_approximate_sql('tail', 'GATT', 1)}[1] AS x
  FROM (SELECT *, reverse(dna2) AS rev, reverse(left(dna2, 40)) AS head, substr(dna2, 10) AS tail FROM s))""")
def approximate_edges(s):
    q, d = ApproximateQuery("GATT"), C("dna2")
    return picked(s, **parts(q.find_last(d, 1), "last"), **parts(q.find_prev(d, 1, 40), "prev"), **parts(q.find_next(d, 1, 10), "next"), occurs=q.occurs_in(d, 1), **parts(q.find_next(d, 4, 5), "loose"))


def _one_edit_sql(classes: list[str]) -> dict[str, str]:
    """Expressions of what is one edit away from a run of classes: a symbol less, another, or more."""
    n = len(classes)
    less = ["".join(classes[:i] + classes[i + 1 :]) for i in range(n)]
    other = ["".join([*classes[:i], ".", *classes[i + 1 :]]) for i in range(n)]
    more = ["".join([*classes[:i], ".", *classes[i:]]) for i in range(n + 1)]
    return {k: "^(" + "|".join(dict.fromkeys(v)) + ")$" for k, v in {"less": less, "other": other, "more": more}.items()}


_GANTAC = ["[GRSVKDBN]", "[AMRVWHDN]", "[ACMGRSVTWYHKDBN]", "[TWYHKDBN]", "[AMRVWHDN]", "[CMSVYHBN]"]
_NEAR = _one_edit_sql(_GANTAC)


@query(f"""SELECT doc_id, CAST(r.start AS INT) AS hit_start, CAST(r.j AS INT) AS hit_stop FROM (SELECT doc_id, list_filter(list_transform(range(1, length(dna4) + 1), lambda j: {{'j': j, 'start': CASE
  WHEN j >= 6 AND regexp_matches(dna4[j - 5 : j], '^{"".join(_GANTAC)}$') THEN j - 5 WHEN j >= 7 AND regexp_matches(dna4[j - 6 : j], '{_NEAR["more"]}') THEN j - 6
  WHEN j >= 6 AND regexp_matches(dna4[j - 5 : j], '{_NEAR["other"]}') THEN j - 5 WHEN j >= 5 AND regexp_matches(dna4[j - 4 : j], '{_NEAR["less"]}') THEN j - 4 END}}), lambda r: r.start IS NOT NULL)[1] AS r FROM s)""")
def find_approximate_compatible(s):
    return picked(s, **parts(ApproximateQuery("GANTAC", "iscompatible").find_first(C("dna4"), 1), "hit"))


@query("""SELECT doc_id, CAST(h[1] AS INT) AS first_at, CAST(h[-1] AS INT) AS last_at, CAST(CASE WHEN length(dna4) >= 10 THEN list_filter(h, lambda i: i >= 10)[1] END AS INT) AS next_at,
  CAST(list_filter(h, lambda i: i <= 3)[-1] AS INT) AS prev_at, CAST(len(h) AS INT) AS n FROM (SELECT doc_id, dna4, list_filter(range(1, length(dna4) + 1), lambda i: contains('GWK', dna4[i])) AS h FROM s)""")
def find_by_test(s):
    d, test = C("dna4"), lambda c: c.isin("G", "W", "K")
    return picked(s, first_at=symbols.find_where(d, test), last_at=symbols.find_last_where(d, test), next_at=symbols.find_where(d, test, 10), prev_at=symbols.find_last_where(d, test, F.least(F.lit(3), F.length(d))), n=F.size(symbols.find_all_where(d, test)))


@query("SELECT doc_id, CASE WHEN dna2 IS NOT NULL THEN list_transform(list_filter(range(1, length(x) - 1), lambda i: x[i : i + 2] = 'ATA'), lambda i: CAST(i + 4 AS INT)) END AS inside FROM (SELECT doc_id, dna2, substr(dna2, 5, 60) AS x FROM s)")
def find_in_range(s):
    d = C("dna2")
    return picked(s, inside=F.transform(ExactQuery("ATA").find_all(d, first=5, last=F.least(F.lit(64), F.length(d))), lambda h: h["start"]))


@query("""SELECT doc_id, CAST(CASE WHEN dna2 IS NOT NULL THEN 1 END AS INT) AS first_start, CAST(CASE WHEN dna2 IS NOT NULL THEN 0 END AS INT) AS first_stop, CAST(length(dna2) + 1 AS INT) AS last_start, CAST(length(dna2) AS INT) AS last_stop,
  CASE WHEN dna2 IS NOT NULL THEN true END AS occurs, CAST(length(dna2) + 1 AS INT) AS n FROM s""")
def empty_pattern(s):
    q, d = ExactQuery(""), C("dna2")
    return picked(s, **parts(q.find_first(d), "first"), **parts(q.find_last(d), "last"), occurs=q.occurs_in(d), n=F.size(q.find_all(d)))


@query("SELECT doc_id, regexp_matches(dna4, '[AMRVWHDN](?:[CMSVYHBN][TWYHKDBN])+[GRSVKDBN]') AS occurs, nullif(regexp_extract(dna4, '[AMRVWHDN](?:[CMSVYHBN][TWYHKDBN])+[GRSVKDBN]'), '') AS matched FROM s")
def regex_match(s):
    rx = BioRegex("A(?:CT)+G")
    return picked(s, occurs=rx.occurs_in(C("dna4")), matched=rx.matched(C("dna4")))


@query("SELECT doc_id, regexp_extract_all(dna2, 'A(?:C|G)+T?') AS found FROM s")
def regex_each(s):
    return picked(s, found=BioRegex("A(C|G)+T?", "DNA2").each(C("dna2")))


@query("SELECT doc_id, nullif(regexp_extract(aa, '[ACX][^PX*-].[STX]{1,2}[NBX]'), '') AS matched FROM s".replace("[^PX*-].", "[ARNDCQEGHILKMFSTWYVOUBJZX][ARNDCQEGHILKMFPSTWYVOUBJZX]"))
def prosite_match(s):
    return picked(s, matched=BioRegex("[AC]-{P}-x-[ST](1,2)-N", "AA", "prosite").matched(C("aa")))


@query("""SELECT doc_id, CAST(len(w) AS INT) AS n, w AS shown FROM (SELECT doc_id, flatten(list_transform(list_filter(range(1, length(dna2) + 1), lambda i: dna2[i] = 'A'), lambda i: list_concat(
  CASE WHEN substr(dna2, i + length(regexp_extract(substr(dna2, i), '^A+')), 1) = 'C' THEN [i || ':' || regexp_extract(substr(dna2, i), '^A+') || 'C'] ELSE [] END,
  list_transform(range(length(regexp_extract(substr(dna2, i), '^A+')), 0, -1), lambda k: i || ':' || repeat('A', k))))) AS w FROM s)""")
def regex_every_way(s):
    d = C("dna2")
    ranges = BioRegex("A+C?", "DNA2").each_way_range(d)
    size = F.aggregate(ranges, F.lit(0).cast("long"), lambda n, w: n + w["stop"] - w["start"] + 1)
    error = F.raise_error(F.format_string("the ways to match one text have %d characters, more than a row of Spark's holds", size))
    # symbols are bytes here: a slice of bytes costs its own length, one of characters counts from the text's start
    shown = lambda t: F.transform(t["ranges"], lambda w: F.concat_ws(":", w["start"].cast("string"), F.substring(t["bytes"], w["start"], w["stop"] - w["start"] + 1).cast("string")))
    texts = F.transform(F.array(F.struct(d.cast("binary").alias("bytes"), ranges.alias("ranges"))), shown)
    return picked(s, n=F.size(ranges), shown=F.when(size > ROW, error).otherwise(texts[0]))


@query("""SELECT doc_id, CAST(nullif(instr(dna2, m), 0) AS INT) AS start, CAST(instr(dna2, m) + length(m) - 1 AS INT) AS stop, m AS matched, g1, g2, CAST(nullif(instr(t, nullif(regexp_extract(t, 'A(C+)(G)?T'), '')), 0) + 9 AS INT) AS next_start FROM (
  SELECT doc_id, dna2, substr(dna2, 10) AS t, nullif(regexp_extract(dna2, 'A(C+)(G)?T'), '') AS m, nullif(regexp_extract(dna2, 'A(C+)(G)?T', 1), '') AS g1, nullif(regexp_extract(dna2, 'A(C+)(G)?T', 2), '') AS g2 FROM s)""")
def regex_captures(s):
    rx, d = BioRegex("A(C+)(G)?T", "DNA2"), C("dna2")
    hit, first = rx.match(d), rx.find_first(d)
    return picked(s, start=first["start"], stop=first["stop"], matched=hit["matched"], g1=F.get(hit["captured"], F.lit(0)), g2=F.get(hit["captured"], F.lit(1)), next_start=rx.find_first(d, 10)["start"])


@query("SELECT doc_id, regexp_extract_all(dna2, '(?:AC|G)+T') AS found FROM s")
def regex_long_runs(s):
    return picked(s, found=BioRegex("(AC|G)+T", "DNA2").each(C("dna2")))


@query("""SELECT doc_id, CAST(i AS INT) AS start, CAST(i + 3 AS INT) AS stop FROM (SELECT doc_id, unnest(list_filter(range(1, length(dna2) - 2), lambda i: dna2[i : i + 3] = 'TATA')) AS i FROM s)""")
def find_all_in_chunks(s):
    return hits.find_all_long(s, "dna2", ExactQuery("TATA"), "doc_id", chunk=256)


@query("SELECT kmer, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(dna2) - 2), lambda i: dna2[i : i + 3])) AS kmer FROM s) GROUP BY kmer")
def kmer_spectrum(s):
    return hits.spectrum(s, "dna2", 4)


# matrices and consensus

#: Windows of 12 symbols, one after the other, as the sequences of a motif.
MOTIF = "SELECT doc_id, doc_id || ':' || i AS id, substr(dna2, CAST(i AS INT), 12) AS x FROM (SELECT doc_id, dna2, unnest(range(1, length(dna2) - 10, 12)) AS i FROM s)"
COUNTS = f"m AS MATERIALIZED ({MOTIF}), c AS (SELECT CAST(p AS INT) AS pos, sym, coalesce(n, 0) AS value FROM range(1, 13) r(p) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) v(sym) LEFT JOIN (SELECT q, x[q] AS y, count(*) AS n FROM m, range(1, 13) t(q) GROUP BY q, y) z ON q = p AND y = sym)"


def windows(s, name: str, width: int):
    """The sequence in windows of ``width`` symbols one after the other; what is left at the end is none."""
    n = F.length(name)
    starts = F.when(n >= width, F.sequence(F.lit(1), n - width + 1, F.lit(width)))
    return s.select("doc_id", F.col(name).alias("__s"), F.explode(starts).alias("__i")).select("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("__i").cast("string")).alias("id"), F.substring("__s", F.col("__i"), F.lit(width)).alias("x"))


def motifs(s):
    return windows(s, "dna2", 12)


@query()
def pfm(s):
    return aggregates.pfm(motifs(s), "x")


ORACLES["pfm"] = DERIVED.rstrip() + f", {COUNTS} SELECT * FROM c"


@query()
def pwm(s):
    m = aggregates.pwm(aggregates.add_pseudo(aggregates.pfm(motifs(s), "x"), 0.01))
    return m.withColumn("value", F.round("value", 9))


ORACLES["pwm"] = DERIVED.rstrip() + f", {COUNTS} SELECT pos, sym, round(log2((value + 0.01) / (sum(value + 0.01) OVER (PARTITION BY pos)) / 0.25), 9) AS value FROM c"

SCORES = [[1.0, 0.0, 0.1, 0.9], [0.1, 0.2, 0.2, 0.5], [0.2, 0.3, 0.0, 0.2]]


@query("""SELECT doc_id, CAST(len(h) AS INT) AS n, CAST(h[1] AS INT) AS first_hit, CAST(h[-1] AS INT) AS last_hit FROM (SELECT doc_id, list_filter(range(1, length(dna4) - 1), lambda i:
  (CASE dna4[i] WHEN 'A' THEN 10 WHEN 'G' THEN 1 WHEN 'T' THEN 9 ELSE 0 END) + (CASE dna4[i + 1] WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 2 WHEN 'T' THEN 5 ELSE 0 END) + (CASE dna4[i + 2] WHEN 'A' THEN 2 WHEN 'C' THEN 3 WHEN 'T' THEN 2 ELSE 0 END) >= 15.5) AS h FROM s)""")
def pwm_search(s):
    found = PWM(SCORES).find_all(C("dna4"), 1.55)
    return picked(s.withColumn("h", found), n=F.size("h"), first_hit=F.get("h", F.lit(0)), last_hit=F.array_max("h"))


@query()
def consensus(s):
    return aggregates.majority_vote(windows(s, "dna4", 15), "x")


ORACLES["consensus"] = DERIVED.rstrip() + """, v AS (
  SELECT p, instr('ACMGRSVTWYHKDBN', x[p]) AS c, x[p] = '-' AS gap FROM (SELECT substr(dna4, CAST(i AS INT), 15) AS x FROM (SELECT dna4, unnest(range(1, length(dna4) - 13, 15)) AS i FROM s)), range(1, 16) r(p)
), n AS (
  SELECT p, sum(c & 1) AS a, sum(c >> 1 & 1) AS c, sum(c >> 2 & 1) AS g, sum(c >> 3 & 1) AS t, sum(gap::INT) AS gaps FROM v GROUP BY p
), w AS (
  SELECT p, CASE WHEN gaps > greatest(a, c, g, t) THEN '-' ELSE 'ACMGRSVTWYHKDBN'[CAST((a = greatest(a, c, g, t))::INT + 2 * (c = greatest(a, c, g, t))::INT + 4 * (g = greatest(a, c, g, t))::INT + 8 * (t = greatest(a, c, g, t))::INT AS INT)] END AS sym FROM n
) SELECT string_agg(sym, '' ORDER BY p) AS consensus FROM w"""


@query(f"SELECT id, CAST(p AS INT) AS site, x[p] AS sym, CAST(instr('ACGT', x[p]) - 1 AS INT) AS code FROM ({MOTIF}), range(1, 13) r(p)")
def seqmatrix(s):
    return aggregates.seqmatrix(motifs(s), "x", "id", "DNA2")


@query(f"SELECT id, flatten(list_transform(range(1, 13), lambda p: list_transform(range(0, 4), lambda k: x[p] = 'ACGT'[k + 1]))) AS hot FROM ({MOTIF})")
def one_hot(s):
    return motifs(s).select("id", F.flatten(aggregates.one_hot(C("x"))).alias("hot"))


@query_docs(f"SELECT doc_id, coalesce(string_agg(upper(regexp_replace(w, '[^ACGTacgt]', '', 'g')), '' ORDER BY k), '') AS joined FROM ({WORDS}) GROUP BY doc_id".join(["SELECT * FROM (", ")"]))
def join_words(docs):
    s = words(docs).select("doc_id", "k", parse.keep_symbols(C("w"), "DNA2").alias("x"))
    return aggregates.join_ordered(s, "x", "k", ("doc_id",))


@query()
def matrix_access(s):
    m = aggregates.with_value(aggregates.pfm(motifs(s), "x"), 2, "C", 7)
    return aggregates.column_of(m, "C")


ORACLES["matrix_access"] = DERIVED.rstrip() + f", {COUNTS} SELECT pos, CASE WHEN pos = 2 THEN 7 ELSE value END AS value FROM c WHERE sym = 'C'"

ORACLES["pwm_of_zeros"] = "SELECT CAST(p AS INT) AS pos, sym, round(log2(nullif(n, 0) / (sum(n) OVER (PARTITION BY p)) / pr), 9) AS value, n = 0 AS never FROM (VALUES (1, 'A', 0, 0.4), (1, 'C', 2, 0.1), (1, 'G', 2, 0.1), (1, 'T', 4, 0.4), (2, 'A', 8, 0.4), (2, 'C', 0, 0.1), (2, 'G', 0, 0.1), (2, 'T', 0, 0.4)) v(p, sym, n, pr)"


def pwm_of_zeros(spark, sf_dir):
    """A base that is never seen scores minus infinity, shown here as ``never``."""
    m = aggregates.pwm(aggregates.matrix(spark, [[0, 2, 2, 4], [8, 0, 0, 0]]), {"A": 0.4, "C": 0.1, "G": 0.1, "T": 0.4})
    never = C("value") == float("-inf")
    return m.select("pos", "sym", F.when(~never, F.round("value", 9)).alias("value"), never.alias("never"))


QUERIES["pwm_of_zeros"] = pwm_of_zeros


@query()
def pwm_max_score(s):
    m = aggregates.pwm(aggregates.add_pseudo(aggregates.pfm(motifs(s), "x"), 0.01))
    return aggregates.max_score(m).withColumn("score", F.round("score", 9))


PWM_SQL = "w AS (SELECT pos, sym, log2((value + 0.01) / (sum(value + 0.01) OVER (PARTITION BY pos)) / 0.25) AS value FROM c)"
ORACLES["pwm_max_score"] = DERIVED.rstrip() + f", {COUNTS}, {PWM_SQL} SELECT round(sum(m), 9) AS score FROM (SELECT max(value) AS m FROM w GROUP BY pos)"


@query()
def pwm_query(s):
    """A matrix made from the sequences themselves, and what of them scores above it."""
    q = query_of(motifs(s), "x")
    return motifs(s).select("id", F.round(q.score_at(C("x"), 1), 6).alias("score"), F.size(q.find_all(C("x"), 0.0)).alias("n"))


ORACLES["pwm_query"] = DERIVED.rstrip() + f", {COUNTS}, {PWM_SQL} SELECT id, round(sum(value), 6) AS score, CAST(sum(value) >= 0 AS INT) AS n FROM (SELECT id, q, x[q] AS y FROM m, range(1, 13) t(q)) JOIN w ON q = pos AND y = sym GROUP BY id"

_SCORED = "(CASE dna4[{0}] WHEN 'A' THEN 10 WHEN 'G' THEN 1 WHEN 'T' THEN 9 ELSE 0 END) + (CASE dna4[{0} + 1] WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 2 WHEN 'T' THEN 5 ELSE 0 END) + (CASE dna4[{0} + 2] WHEN 'A' THEN 2 WHEN 'C' THEN 3 WHEN 'T' THEN 2 ELSE 0 END)"


@query(f"""SELECT doc_id, CASE WHEN length(dna4) >= 5 THEN round(({_SCORED.format(3)}) / 10, 9) END AS third, CAST(list_filter(h, lambda i: i >= 10)[1] AS INT) AS next_hit, CAST(list_filter(h, lambda i: i <= 20)[-1] AS INT) AS prev_hit, CAST(h[1] AS INT) AS first_hit, CAST(h[-1] AS INT) AS last_hit
  FROM (SELECT doc_id, dna4, list_filter(range(1, length(dna4) - 1), lambda i: {_SCORED.format("i")} >= 15.5) AS h FROM s)""")
def pwm_places(s):
    m, d = PWM(SCORES), C("dna4")
    return picked(s, third=F.when(F.length(d) >= 5, F.round(m.score_at(d, 3), 9)), next_hit=m.find_next(d, 1.55, 10), prev_hit=m.find_prev(d, 1.55, 20), first_hit=m.find_first(d, 1.55), last_hit=m.find_last(d, 1.55))


# text for people and random sequences

@query("""SELECT doc_id, CASE WHEN length(dna2) = 0 THEN '' ELSE array_to_string(list_transform(range(0, (length(dna2) + 59) // 60), lambda i: substr(dna2, CAST(60 * i + 1 AS INT), 60)), chr(10)) END AS wrapped,
  length(dna2) || 'nt DNA Sequence' AS summary, CASE WHEN length(dna2) = 0 THEN '< EMPTY SEQUENCE >' WHEN length(dna2) > 40 THEN left(dna2, 19) || '…' || right(dna2, 19) ELSE dna2 END AS shown FROM s""")
def printing(s):
    d = C("dna2")
    return picked(s, wrapped=display.wrapped(d, 60), summary=display.summary(d, "DNA2"), shown=display.shown(d, 40))


@query()
def random_sequences(s):
    weighted = random.WeightedSampler(tuple("ACGTN"), (0.24, 0.24, 0.24, 0.24))
    return picked(s, dna=random.randdna(20, key=C("doc_id"), seed=1), aa=random.randaa(20, key=C("doc_id"), seed=2), noisy=random.randseq("DNA4", 20, key=C("doc_id"), seed=3, sampler=weighted))


@query("SELECT doc_id, CAST(length(regexp_replace(dna4, '[^AG]', '', 'g')) AS INT) AS purines, CAST(length(regexp_replace(aa, '[^KRH]', '', 'g')) AS INT) AS basic FROM s")
def count_by_test(s):
    return picked(s, purines=counting.count_where(C("dna4"), lambda c: c.isin("A", "G")), basic=counting.count_where(C("aa"), lambda c: c.isin("K", "R", "H")))


@query("SELECT doc_id, CAST(length(dna2) AS INT) AS n_dna, true AS dna_ok, true AS rna_ok, true AS aa_ok, true AS weighted_ok, '' AS none FROM s WHERE dna2 IS NOT NULL UNION ALL SELECT doc_id, NULL, NULL, true, true, true, '' FROM s WHERE dna2 IS NULL")
def random_shapes(s):
    """What any seed gives: lengths, and symbols of the sampler alone."""
    key, skewed = C("doc_id"), random.WeightedSampler(("A", "C", "N"), (0.5, 0.0))
    dna = random.randdna(F.length("dna2"), key=key, seed=4)
    return picked(
        s, n_dna=F.length(dna), dna_ok=dna.rlike("^[ACGT]*$"), rna_ok=random.randrna(30, key=key, seed=5).rlike("^[ACGU]{30}$"), aa_ok=random.randaa(30, key=key, seed=6).rlike("^[ARNDCQEGHILKMFPSTWYV]{30}$"),
        weighted_ok=random.randseq("DNA4", 30, key=key, seed=7, sampler=skewed).rlike("^[AN]{30}$"), none=random.randdna(0, key=key),
    )
