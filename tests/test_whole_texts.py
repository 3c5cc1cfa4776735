"""A query without a SQL twin, by brute force behind the first symbols of long texts."""

import random

import pytest

from seqloom.functions.alphabet import DNA4
from seqloom.plans.queries import QUERIES

BITS = dict(zip(DNA4.symbols, DNA4.bits, strict=True))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, out = random.Random(8), str(tmp_path_factory.mktemp("whole"))
    texts = ["C" * 200 + "GATTAC" + "C" * 50, "C" * 120 + "GAACC" + "C" * 100, "C" * 90 + "".join(rng.choices("ACGT", k=150)), "T" * 150 + "AAC", "C" * 300]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{out}/documents.parquet")
    return out, texts


def distance(x, pattern):
    row = list(range(len(pattern) + 1))
    for i, c in enumerate(x, 1):
        new = [i]
        for j, p in enumerate(pattern, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (BITS[c] & BITS[p] == 0)))
        row = new
    return row[-1]


def test_approximate_search_sees_the_whole_text(spark, folder):
    out, texts = folder
    found = {r["doc_id"]: (r["hit_start"], r["hit_stop"]) for r in QUERIES["find_approximate_compatible"](spark, out).collect()}
    for k, x in enumerate(texts):
        ends = ((j, min((distance(x[i - 1 : j], "GANTAC"), i) for i in range(max(1, j - 7), j + 1))) for j in range(1, len(x) + 1))
        assert found[k] == next(((i, j) for j, (d, i) in ends if d <= 1), (None, None))
