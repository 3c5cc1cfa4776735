"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features of a text are its words and their first 4 to 8 bytes. The model has one
weight vector (none is negative) for all grades and ordered thresholds:
P(grade > k) = sigmoid(w x - t_k). Its output is the expected severity, the sum of
these probabilities. x holds 1 + log(count) of the telling features: those that stand in
toxic documents more often than chance allows.

The model is fitted on at most ``SAMPLE`` labelled documents of each class, the
least by a hash of their id, one text of each: a documented bound that keeps what comes to
the driver small, features too, as each stands in several of these texts. A class beyond the
bound weighs in the fit what all its documents would, so verdicts don't depend on the bound. Labels that only say toxic or not become grades: toxic documents are graded 1 to
``GRADES`` by how much of the telling features they hold. All documents are scored,
whole texts, in one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_bytes

SAMPLE, GRADES, SEED = 8000, 3, 5
#: Least evidence of a feature (minus the log of its chance), the ridge penalty, and steps of the fit.
EVIDENCE, RIDGE, STEPS = 10.0, 0.5, 400
PREFIXES = (4, 5, 6, 7, 8)
MEMO = 200_000
#: A-Z in lower case, a-z and all of U+0080 and above; the rest separates words.
LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def features_of(word: bytes) -> list[int]:
    """Hashes (signed) of a word and its prefixes."""
    parts = [b"w" + word, *(b"p" + word[:n] for n in PREFIXES if len(word) >= n)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in map(xxhash.xxh64_intdigest, parts)]


class Known(dict):
    """Word to the numbers of its features that the model has; remembers a bounded number of words."""

    def __init__(self, number: dict[int, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = tuple(self.number[f] for f in features_of(word) if f in self.number)
        return found


def counts_of(words: list[bytes], known: Known) -> Counter:
    return Counter(k for found in map(known.__getitem__, words) if found for k in found)


def fit(rows: list[tuple[list[int], list[float]]], grades: np.ndarray, n_features: int, n_grades: int, ridge: float = RIDGE, steps: int = STEPS, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the cumulative-link model.

    Maximum likelihood with a ridge penalty on the weights, by Adam over all rows, each counting
    ``weights`` times (once).
    Thresholds are the first one and positive steps, so they stay in order.
    """
    n = len(rows)
    mass = np.ones(n) if weights is None else weights
    total = mass.sum()
    row = np.repeat(np.arange(n), [len(f) for f, _ in rows])
    col = np.array([k for f, _ in rows for k in f], np.int64)
    val = np.array([x for _, v in rows for x in v], float)
    share = [(mass[grades > k].sum() + 0.5) / (total + 1) for k in range(n_grades)]
    start = np.array([np.log((1 - p) / p) for p in share])
    theta = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m = v = np.zeros_like(theta)

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

    def unpack(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps_up = np.exp(theta[n_features + 1 :])
        return theta[:n_features], theta[n_features] + np.append(0, np.cumsum(steps_up))

    for step in range(1, steps + 1):
        w, t = unpack(theta)
        score = np.bincount(row, val * w[col], n)
        # bounds of each row's grade: P = F(hi) - F(lo) with F(k) = P(grade <= k)
        at_most = sigmoid(t[None, :] - score[:, None])
        f = np.concatenate([np.zeros((n, 1)), at_most, np.ones((n, 1))], 1)
        d = np.concatenate([np.zeros((n, 1)), at_most * (1 - at_most), np.zeros((n, 1))], 1)
        i = np.arange(n)
        p = np.maximum(f[i, grades + 1] - f[i, grades], 1e-12)
        hi, lo = mass * d[i, grades + 1] / p / total, mass * d[i, grades] / p / total
        g_score = hi - lo
        g_t = np.array([(np.where(grades == k, -hi, 0) + np.where(grades == k + 1, lo, 0)).sum() for k in range(n_grades)])
        up = np.exp(theta[n_features + 1 :])
        tail = np.cumsum(g_t[::-1])[::-1]
        grad = np.concatenate([np.bincount(col, val * g_score[row], n_features) + ridge * w / max(total, 1), tail[:1], tail[1:] * up])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        theta[:n_features] = np.maximum(theta[:n_features], 0)
    return unpack(theta)


class Model:
    """``numbers`` gives a feature hash its place in ``weights``."""

    def __init__(self, numbers: dict[int, int], weights: np.ndarray, thresholds: np.ndarray):
        self.numbers, self.weights, self.thresholds = numbers, weights, thresholds

    def above(self, counts: Counter) -> np.ndarray:
        """P(grade > k) for each threshold."""
        score = sum((1 + np.log(c)) * self.weights[k] for k, c in counts.items())
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -35, 35)))


def select(docs: DataFrame, labelled: DataFrame) -> list[int]:
    """The features that tell toxic from other labelled documents, the least likely by chance first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # toxic documents count in the high half; a full table is passed on, to be summed later
        seen: dict[int, int] = {}
        sizes = 0

        def flush(last: bool) -> pa.RecordBatch:
            keys, counts = [*seen, *[None] * last], np.array([*seen.values(), *[sizes] * last], np.int64)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts & 0xFFFFFFFF), pa.array(counts >> 32)], names=["f", "no", "yes"])

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                one = 1 << (32 * y)
                sizes += one
                for f in {f for w in set(words_of(t)) for f in features_of(w)}:
                    seen[f] = seen.get(f, 0) + one
                if len(seen) > 300_000:
                    yield flush(False)
        yield flush(True)

    found = labelled.select("y", "text").mapInArrow(run, "f long, no long, yes long").groupBy("f").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    found = cut(found)
    sizes = found.filter("f is null").first()
    if sizes is None or not sizes["yes"]:
        return []
    base = sizes["yes"] / (sizes["yes"] + sizes["no"])
    share = F.col("yes") / (F.col("yes") + F.col("no"))
    # Chernoff bound on so many toxic documents among those with the feature
    evidence = F.col("yes") * F.log(share / base) + F.when(F.col("no") > 0, F.col("no") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    best = found.filter("f is not null and yes >= 2").filter(share > base).select("f", evidence.alias("e")).filter(F.col("e") >= EVIDENCE)
    return [r["f"] for r in best.orderBy(F.desc("e"), "f").collect()]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, grades: int = GRADES) -> Model:
    """Fits the model. A document labelled more than once counts as toxic if any label says so.

    Of rows with the same labelled id the one whose text has the least hash counts.
    """
    y = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    order = F.xxhash64(F.lit(SEED), F.col("id"))
    y = cut(y)
    sizes = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = y.filter("y = 0").orderBy(order, "id").limit(sample).unionByName(y.filter("y = 1").orderBy(order, "id").limit(sample))
    # at most 2 * sample ids, and after the partial minima as many texts a task
    texts = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = cut(texts.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("id", "y", F.col("t.text").alias("text")))
    numbers = {f: k for k, f in enumerate(select(docs, texts))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(numbers)
        for b in batches:
            out = []
            for i, y, t in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                counts = counts_of(words_of(t), known)
                out.append((i, y, list(counts), list(counts.values())))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["id", "y", "f", "c"])

    rows = texts.select(F.col("id").cast("long").alias("id"), "y", "text").mapInArrow(run, "id long, y int, f array<int>, c array<int>").collect()
    values = [[1 + float(np.log(c)) for c in r["c"]] for r in rows]
    toxic = np.array([r["y"] for r in rows], np.int64)
    if not numbers:  # nothing tells the classes apart: all documents get the base rate, but none is called toxic for it
        p = min((toxic.sum() + 0.5) / (len(toxic) + 1), 0.49)
        return Model({}, np.zeros(0), np.full(grades, np.log((1 - p) / p) if len(toxic) else 35.0))
    amount = np.array([sum(v) for v in values])
    edges = np.quantile(amount[toxic == 1], np.arange(1, grades) / grades)
    grade = np.where(toxic == 1, 1 + np.searchsorted(edges, amount, side="right"), 0)
    # each class counts by all its labels, however few of its documents were sampled
    mass = np.where(toxic == 1, max(1.0, sizes.get(1, 0) / sample), max(1.0, sizes.get(0, 0) / sample))
    weights, thresholds = fit([(r["f"], v) for r, v in zip(rows, values, strict=True)], grade, len(numbers), grades, weights=mass)
    return Model(numbers, weights, thresholds)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of each row of ``docs``, severity (expected grade), grade (the most probable) and p_toxic.

    Null and empty texts have no features: the grade of an unremarkable text. Repeated rows stay;
    an empty table gives no rows; names of other columns don't matter.
    """
    # a weight for each feature of the bounded sample that tells the classes apart
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, grade int, p_toxic double")
    def graded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        known = Known(own.numbers)
        for texts in batches:
            above = np.array([own.above(counts_of(words_of(t), known)) for t in texts]).reshape(len(texts), len(own.thresholds))
            exact = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1), axis=1)
            yield pd.DataFrame({"severity": above.sum(1), "grade": exact.argmax(1).astype(np.int32), "p_toxic": above[:, 0]})

    # only texts go to Python; a plan that calls it non-deterministic is not made to run it twice
    found = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), graded.asNondeterministic()(text_bytes(text_col)).alias("s"))
    return found.select(*[F.col("kept")[c].alias(c) for c in keep], "s.severity", "s.grade", "s.p_toxic")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.round("severity", 6).alias("severity"), "grade", F.round("p_toxic", 6).alias("p_toxic"), (F.col("p_toxic") >= 0.5).alias("toxic"))
