"""Aggregates over many sequences: matrices, consensus, ordered concatenation.

All explode to one row a symbol and sum with partial aggregates, so what is shuffled is a
row for each place, symbol and task, however many sequences there are. Sequences
of one motif or alignment have equal lengths; others stop the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.alphabet import Alphabet, alphabet, one_of, symbols_of, try_encode

GAP_BIT = 16


def same_length(df: DataFrame, seq: str, by: list[str] = ()) -> DataFrame:
    """One row (for each group) with n, the number of sequences, and len, their common length."""
    sizes = df.groupBy(*by).agg(F.count(seq).alias("n"), F.min(F.length(seq)).alias("len"), F.max(F.length(seq)).alias("most"))
    return sizes.select(*by, "n", F.when(F.col("len") == F.col("most"), F.col("len")).otherwise(F.raise_error(F.lit("DimensionMismatch: sequences of different lengths")).cast("int")).alias("len"))


def sites(df: DataFrame, seq: str, *keep: str) -> DataFrame:
    """(site, sym) of each symbol, with the columns ``keep``."""
    return df.select(*keep, F.posexplode(symbols_of(F.col(seq))).alias("site", "sym")).withColumn("site", F.col("site") + 1)


def seqmatrix(df: DataFrame, seq: str, key: str, codes: Alphabet | str | None = None) -> DataFrame:
    """The matrix of an alignment in long form: key, site, sym and, given an alphabet, code."""
    out = sites(df, seq, key)
    checked = same_length(df, seq).filter("len is not null").select(F.lit(1).alias("one"))
    out = out.join(F.broadcast(checked), F.lit(1) == F.col("one")).drop("one")
    return out if codes is None else out.withColumn("code", try_encode(F.col("sym"), codes))


def by_site(df: DataFrame, seq: str, key: str) -> DataFrame:
    """A row for each site: its symbols in the order of ``key``. The rows of a site, one a sequence, come together."""
    return sites(df, seq, key).groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "sym"))), lambda x: x["sym"]).alias("syms"))


def one_hot(s: Column, a: Alphabet | str = "DNA4") -> Column:
    """For each symbol the four bits of its code, A first."""
    a = alphabet(a)
    return F.transform(symbols_of(s), lambda c: F.array(*[try_encode(c, a).bitwiseAND(1 << k) != 0 for k in range(4)]))


def counted(df: DataFrame, seq: str, aggs: list[Column], by: list[str] = ()) -> DataFrame:
    """(by, site, n, aggregates over the symbols ``sym`` of the site); empty sequences count at a null site. One pass."""
    each = df.select(*by, F.posexplode_outer(symbols_of(F.col(seq))).alias("site", "sym"))
    return each.groupBy(*by, (F.col("site") + 1).alias("site")).agg(F.count("*").alias("n"), *aggs)


def one_length() -> Column:
    """Aggregate over the rows of ``counted``: whether all sequences have one length, none of them or all being empty."""
    return (F.min("n") == F.max("n")) & ((F.count_if(F.col("site").isNull()) == 0) | (F.count("*") == 1))


def pfm(df: DataFrame, seq: str, family: str = "DNA") -> DataFrame:
    """(pos, sym, value): how often each base stands at each place; all places and bases, zeros too.

    The sequences are read once: their lengths are told from how many have each place. Both uses of
    the counts share one shuffle, of a row for each place and task.
    """
    symbols = "ACGU" if family == "RNA" else "ACGT"
    df = df.filter(F.col(seq).isNotNull())
    bad = F.col(seq).rlike(f"[^{'-ACMGRSVTUWYHKDBN'}]")
    df = df.select(F.when(bad, F.raise_error(F.lit("ArgumentError: not nucleotides")).cast("string")).otherwise(F.col(seq)).alias(seq))
    sites_of = counted(df, seq, [F.count(F.when(F.col("sym") == c, 1)).alias(c) for c in symbols])
    check = sites_of.groupBy().agg(one_length().alias("ok"), F.count("*").alias("sites"))
    wrong = F.raise_error(F.lit("DimensionMismatch: sequences of different lengths")).cast("int")
    rows = sites_of.filter("site is not null").join(F.broadcast(check)).select(F.when(F.col("ok"), F.col("site")).otherwise(wrong).alias("pos"), *symbols)
    none = check.filter("sites = 0").select(F.raise_error(F.lit("ArgumentError: no sequences")).cast("int").alias("pos"), *[F.lit(0).cast("long").alias(c) for c in symbols])
    wide = rows.unionByName(none)
    return wide.select("pos", F.explode(F.array(*[F.struct(F.lit(c).alias("sym"), F.col(c).alias("value")) for c in symbols])).alias("x")).select("pos", "x.sym", "x.value")


def matrix(spark, columns: list[list[float]], family: str = "DNA") -> DataFrame:
    """A matrix (pos, sym, value) from its columns, four numbers for each place."""
    symbols = "ACGU" if family == "RNA" else "ACGT"
    if any(len(c) != 4 for c in columns):
        raise ValueError("a matrix has four rows")
    return spark.createDataFrame([(p, s, float(x)) for p, c in enumerate(columns, 1) for s, x in zip(symbols, c, strict=True)], "pos int, sym string, value double")


def one_base(sym: str) -> str:
    if sym not in tuple("ACGTU"):
        raise ValueError(f"{sym!r} is not one base")
    return sym


def column_of(matrix: DataFrame, sym: str) -> DataFrame:
    """(pos, value) of one base; an ambiguous symbol has no row of its own."""
    return matrix.filter(F.col("sym") == one_base(sym)).select("pos", "value")


def with_value(matrix: DataFrame, pos: int, sym: str, value: float) -> DataFrame:
    """The matrix with another value at one place."""
    here = (F.col("pos") == pos) & (F.col("sym") == one_base(sym))
    return matrix.withColumn("value", F.when(here, F.lit(value)).otherwise(F.col("value")))


def add_pseudo(matrix: DataFrame, count: float) -> DataFrame:
    return matrix.withColumn("value", F.col("value") + F.lit(count))


def pwm(matrix: DataFrame, prior: dict[str, float] | None = None) -> DataFrame:
    """(pos, sym, value): log2 of each frequency over the prior; minus infinity for a zero count."""
    prior = prior or {}
    if prior and (any(p <= 0 for p in prior.values()) or abs(sum(prior.values()) - 1) > 1e-9):
        raise ValueError("a prior is positive and sums to 1")
    base = F.lit(0.25)
    for sym, p in prior.items():
        base = F.when(F.col("sym") == sym, F.lit(p)).otherwise(base)
    share = F.col("value") / F.sum("value").over(Window.partitionBy("pos"))
    return matrix.withColumn("value", F.when(F.col("value") == 0, F.lit(float("-inf"))).otherwise(F.log2(share / base)))


def max_score(matrix: DataFrame) -> DataFrame:
    """One row, score: the sum of the places' maxima; 0 without places."""
    return matrix.groupBy("pos").agg(F.max("value").alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("score"))


def majority_vote(df: DataFrame, seq: str, family: str = "DNA", by: tuple[str, ...] = ()) -> DataFrame:
    """consensus (for each group): at each site the symbol of the bases with most votes.

    An ambiguous symbol votes for each base it may be. Bases with equally many
    votes give the symbol of them all; a gap wins only ahead of every base.
    """
    a = alphabet(f"{family}4")
    code = try_encode(F.col("sym"), a)
    votes = [F.sum(F.when(code.bitwiseAND(1 << k) != 0, 1).otherwise(0)).alias(f"v{k}") for k in range(4)]
    rows = counted(df.filter(F.col(seq).isNotNull()), seq, [*votes, F.sum(F.when(F.col("sym") == "-", 1).otherwise(0)).alias("gaps")], list(by))
    top = F.greatest(*[F.col(f"v{k}") for k in range(4)])
    winner = sum((F.when(F.col(f"v{k}") == top, 1 << k).otherwise(0) for k in range(4)), F.lit(0))
    sym = F.when(F.col("gaps") > top, F.lit("-")).otherwise(F.get(F.split(F.lit(a.symbols), ""), winner))
    place = F.when(F.col("site").isNotNull(), F.struct("site", sym.alias("sym")))
    # a consensus is one string, so its sites, as many as it has symbols, meet in one row
    out = rows.groupBy(*by).agg(one_length().alias("ok"), F.count("*").alias("sites"), F.array_sort(F.collect_list(place)).alias("places"))
    wrong = F.raise_error(F.lit("DimensionMismatch: sequences of different lengths")).cast("string")
    text = F.array_join(F.transform("places", lambda x: x["sym"]), "")
    return out.filter("sites > 0").select(*by, F.when(F.col("ok"), text).otherwise(wrong).alias("consensus"))


def join_ordered(df: DataFrame, seq: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """joined (for each group): the sequences one after the other in the order of a column.

    The result is one string, so a group's sequences meet in one row by their nature.
    """
    return df.filter(F.col(seq).isNotNull()).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(seq).alias("s")))), lambda x: x["s"]), "").alias("joined"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "one_of")]
