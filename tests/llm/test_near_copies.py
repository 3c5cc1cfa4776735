"""The pipeline's near copies against brute force over exact similarities."""

import random

import numpy as np
import pytest

import corpus_pipeline
from seqloom.llm import near_copies
from seqloom.llm.simhash import links, roots_of

DOCS = "doc_id long, text string"


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def corpus():
    rng = random.Random(6)
    fresh = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for _ in range(40):  # copies with a few words changed: similarities on both sides of 0.8
        base = [fresh() for _ in range(rng.randrange(100, 200))]
        rows.append(" ".join(base))
        for edits in (1, 2, 3, 4, 5):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = fresh()
            rows.append(" ".join(copy))
    base = [fresh() for _ in range(150)]
    for _ in range(60):  # a large group
        copy = list(base)
        copy[rng.randrange(150)] = fresh()
        rows.append(" ".join(copy))
    rows += [None, "", " \n", "one two", "One  two", "one two three"]
    return list(enumerate(rows))


def wanted(docs):
    sets = [shingle_set(t) for _, t in docs]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if alike(sets[i], sets[j])]
    return {k: int(r) for k, r in enumerate(roots_of(len(sets), *np.array(pairs).T))}


@pytest.mark.parametrize(("block", "most"), [(500, 1 << 25), (3, 1 << 25), (500, 4000)])
def test_components_are_those_of_exact_similarity(spark, block, most):
    docs = corpus()
    got = near_copies.near_copy_components(spark.createDataFrame(docs, DOCS).repartition(3), block=block, most_bytes=most).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == wanted(docs)


def test_stage_keeps_one_of_each_component(spark):
    docs = corpus()
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, DOCS).repartition(3), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(wanted(docs).values()))


def pigeons(docs):
    """Sets, fingerprints by counting bits, and the pairs that differ in at most 8 of them."""
    sets = [near_copies.shingles((t or "").encode()) for _, t in docs]
    prints = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s)) for s in sets]
    return sets, prints, [(i, j) for j in range(len(docs)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 8]


def test_links_of_a_wide_distance(spark):
    docs = corpus()
    _, prints, near = pigeons(docs)
    rows = sorted({p - (1 << 64) * (p >> 63) for p in prints})
    found = links(spark.createDataFrame([(p,) for p in rows], "fp long"), distance=8).collect()
    at = {p: k for k, p in enumerate(rows)}
    got = roots_of(len(rows), *np.array([(at[r["u"]], at[r["v"]]) for r in found]).T)
    own = [at[p - (1 << 64) * (p >> 63)] for p in prints]
    assert list(got) == list(roots_of(len(rows), *np.array([(own[i], own[j]) for i, j in near]).T))


def test_families_of_fingerprints_are_decided_by_exact_similarity(spark):
    docs = corpus()
    _, _, near = pigeons(docs)
    family = roots_of(len(docs), *np.array(near).T)
    exact = [shingle_set(t) for _, t in docs]
    pairs = [(i, j) for j in range(len(docs)) for i in range(j) if family[i] == family[j] and alike(exact[i], exact[j])]
    unlike = [(i, j) for i, j in near if not alike(exact[i], exact[j])]
    assert len(pairs) > 500 and unlike
    got = near_copies.near_copy_components(spark.createDataFrame(docs, DOCS).repartition(3), minhash=False).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: int(r) for k, r in enumerate(roots_of(len(docs), *np.array(pairs).T))}
