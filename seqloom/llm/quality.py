"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at a document's statistics and votes good (1), bad (-1) or abstains
(0). Nobody knows the rules' accuracies: how often each says what of a good document,
and what of a bad one. Expectation maximisation estimates them
and the share of good documents from how the rules agree over all documents.
It needs only how often each pattern of votes occurs, at most 3 ** 8 rows, so all
its rounds are one expression over one row. A document is kept by its posterior
probability of being good, not by passing all rules.

The statistics are computed inside each row; only they, not texts, are written
once to the shared folder and read for the two passes. Vote patterns are counted
with partial sums, and posteriors come back by a broadcast of that bounded table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, table

ROUNDS, KEEP = 30, 0.5
#: Where estimation starts, and its weight in documents: the share of good ones, and
#: how a rule votes (bad, none, good) on a good and on a bad one.
PRIOR, ON_GOOD, ON_BAD, WEIGHT = 0.85, (0.02, 0.18, 0.80), (0.45, 0.25, 0.30), 20.0
# Frequent function words of the corpus' languages.
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "is", "that", "de", "la", "el", "que", "los", "en", "y", "le", "les", "des", "et", "un", "der", "die", "das", "und", "von", "zu", "den", "mit", "ist", "nicht")
RULES = 8


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Counts of each text; windows are of three words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    at = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    rows = rows.select("doc_id", "text", "w", "lines", F.when(F.size("w") >= 3, at).otherwise(F.expr("cast(array() as array<bigint>)")).alias("h"))
    rows = rows.select(
        "doc_id", "h", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?…:;»”\"')\]][\x20\x09-\x0D]*\z"))).cast("long").alias("n_ended"),
        F.size(F.array_intersect("w", F.array(*[F.lit(x) for x in FUNCTION_WORDS]))).cast("long").alias("n_function"),
        F.length(F.regexp_replace("text", r"[^0-9@/\\_=]+", "")).cast("long").alias("n_odd"),
        (F.size("h") > F.size(F.array_distinct("h"))).alias("again"),
    )
    # windows in order of hash, then place: those that occur again stand side by side
    rows = rows.withColumn("h", F.when(F.col("again"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))

    def twin(k: Column, step: int) -> Column:
        return F.coalesce(F.get("h", k + step)["x"] == F.get("h", k)["x"], F.lit(False))

    places = F.transform(F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda k: twin(k, -1) | twin(k, 1)), lambda k: F.get("h", k)["i"])
    covered = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2))))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(F.col("again"), F.size(covered)).otherwise(0).cast("long").alias("n_repeat_words"), "n_ended", "n_function", "n_odd")


def votes() -> list[Column]:
    """The rules, over the columns of ``statistics``."""

    def vote(good: str, bad: str) -> Column:
        return F.expr(f"case when n_words = 0 then -1 when {bad} then -1 when {good} then 1 else 0 end")

    return [
        vote("n_words between 70 and 100000", "n_words < 30"),
        vote("word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
        vote("100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
        vote("20 * n_dup_lines <= n_lines and n_lines > 1", "10 * n_dup_lines > 3 * n_lines"),
        vote("10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
        vote("5 * n_ended >= 3 * n_lines", "5 * n_ended < n_lines"),
        vote("n_function >= 3", "n_function = 0"),
        vote("50 * n_odd <= word_chars", "5 * n_odd > word_chars"),
    ]


def posterior(state: Column, votes: Column) -> Column:
    """Probability of good, given the votes and how the rules vote on good and bad."""

    def ratio(j: Column) -> Column:
        said = F.get(votes, j) + 1
        return F.ln(F.get(F.get(state["good"], j), said) / F.get(F.get(state["bad"], j), said))

    odds = F.aggregate(F.sequence(F.lit(0), F.lit(RULES - 1)), F.ln(state["prior"] / (1 - state["prior"])), lambda x, j: x + ratio(j))
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """From rows (votes, n) one row: state (prior, good, bad: a row of three shares for each rule) and patterns.

    Each round gives every pattern its posterior, then recounts the votes of each
    rule by it; the start counts as ``WEIGHT`` documents of either kind.
    """
    one = patterns.groupBy().agg(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))).alias("patterns"))

    def total(col: Column, f) -> Column:
        return F.aggregate(col, F.lit(0.0), lambda a, x: a + f(x))

    def table_of(scored: Column, mass, start: tuple) -> Column:
        """For each rule the share of each vote among the documents of one kind."""
        return F.transform(F.sequence(F.lit(0), F.lit(RULES - 1)), lambda j: F.array(*[
            (total(scored, lambda x, v=v: F.when(F.get(x["votes"], j) == v, mass(x)).otherwise(F.lit(0.0))) + WEIGHT * share) / (total(scored, mass) + WEIGHT)
            for v, share in zip((-1, 0, 1), start, strict=True)
        ]))

    def step(state: Column, _: Column) -> Column:
        scored = F.transform("patterns", lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), posterior(state, x["votes"]).alias("p")))
        # the one-element array holds the scores, so that they are computed once a round
        return F.get(F.transform(F.array(scored), lambda s: F.struct(
            ((total(s, lambda x: x["n"] * x["p"]) + WEIGHT * PRIOR) / (total(s, lambda x: x["n"]) + WEIGHT)).alias("prior"),
            table_of(s, lambda x: x["n"] * x["p"], ON_GOOD).alias("good"),
            table_of(s, lambda x: x["n"] * (1 - x["p"]), ON_BAD).alias("bad"),
        )), F.lit(0))

    def start(shares: tuple) -> Column:
        return F.array_repeat(F.array(*[F.lit(x) for x in shares]), RULES)

    first = F.struct(F.lit(PRIOR).alias("prior"), start(ON_GOOD).alias("good"), start(ON_BAD).alias("bad"))
    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step).alias("state"), "patterns")


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Statistics, votes and p_good of each row of ``docs``.

    Null text counts as empty: no words, all rules vote bad. Null ids
    and repeated rows are rows like any other. An empty table gives no rows.
    Names of other columns don't matter.
    """
    rows = cut(statistics(docs, id_col, text_col).withColumn("votes", F.array(*votes())))
    patterns = rows.groupBy("votes").agg(F.count("*").alias("n"))
    model = estimate(patterns, rounds)
    # at most 3 ** RULES rows, whatever the number of documents
    scores = model.select("state", F.explode("patterns").alias("x")).select(F.col("x.votes").alias("votes"), posterior(F.col("state"), F.col("x.votes")).alias("p_good"))
    return rows.join(F.broadcast(scores), "votes")


def op8(spark, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select(*names, failed.alias("base_failed"), (~failed & (F.col("p_good") >= KEEP)).alias("kept"), F.round("p_good", 6).alias("p_good"))
