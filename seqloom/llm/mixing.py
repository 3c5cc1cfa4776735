"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash of id and text into ``BLOCKS`` blocks (fewer if
sources are so many that their blocks would exceed ``CELLS``). A source's target, in words, fixes which of its blocks the mix takes and how often: whole
passes first, then blocks in a seeded permutation as long as they fit what is
left of the target. That gives exact block quotas for each source. A binary tree
over the output shards splits the vector of quotas: each node draws the left
half's share from a multivariate hypergeometric law, so leaves sum to exactly
the quotas and each leaf is a fair sample. Leaves then draw disjoint runs of
each source's permuted blocks, and rows are shuffled inside their output shard: each
copy has its shard and a random place in it, and a large shard is sorted in as many pieces
of its order as keep one task to about ``PIECE_WORDS`` words.

The driver sees one row per source and block: at most ``CELLS`` rows, or one for each
source if there are more sources than that.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, n_words, table

BLOCKS, OUT_SHARDS, SEED, MOST = 512, 64, 11, 3
WEIGHTS = (5, 2, 1)
PIECE_WORDS = 1_000_000
#: Rows of source and block that reach the driver, at most (unless there are more sources).
CELLS = 1 << 18
#: Rows of a source-and-block table up to which it is broadcast (about 100 bytes each).
BROADCAST_ROWS = 100_000


def rng(*parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b("/".join(map(str, parts)).encode(), digest_size=8).digest(), "big"))


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of all sizes by weight, each at most ``most`` times its size.

    What a stopped target leaves is shared by weight among the others, until
    none is above its limit.
    """
    out, total = [0.0] * len(sizes), float(sum(sizes))
    free, left = [i for i in range(len(sizes)) if sizes[i]], total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def quota(words: np.ndarray, target: float, order: np.ndarray) -> np.ndarray:
    """Passes over each block: whole passes, then blocks in ``order`` that still fit; a last one if it comes nearer."""
    size = int(words.sum())
    if not size:
        return np.zeros(len(words), np.int64)
    whole = min(MOST, int(target // size))
    times, left = np.full(len(words), whole, np.int64), target - whole * size
    if whole < MOST:
        for b in order:
            if words[b] <= left:
                times[b] += 1
                left -= words[b]
        rest = [b for b in order if times[b] == whole and words[b] < 2 * left]
        if rest:
            times[min(rest, key=lambda b: abs(words[b] - left))] += 1
    return times


def split_tree(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """``(shards, sources)`` block counts; columns sum to ``quotas``, rows to as equal totals as can be."""
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, np.asarray(quotas, np.int64))]
    while stack:
        lo, hi, have = stack.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid, total = (lo + hi) // 2, int(have.sum())
        n = total * (mid - lo) // (hi - lo)
        left = rng(seed, "tree", lo, hi).multivariate_hypergeometric(have, n, method="marginals") if n else have * 0
        stack += [(lo, mid, left), (mid, hi, have - left)]
    return out


def plan_mix(blocks: list[tuple], out_shards: int = OUT_SHARDS, weights: tuple = WEIGHTS, seed: int = SEED) -> list[tuple]:
    """From rows (source, block, words) rows (source, block, source_size, target, output shard of each copy)."""
    names = sorted({b[0] for b in blocks}, key=lambda s: (s is None, s or ""))  # by code point, null last
    own: dict = {s: [] for s in names}
    for s, b, w in blocks:
        own[s].append((b, w))
    for s in names:
        own[s].sort()
    words = [np.array([w for _, w in own[s]], np.int64) for s in names]
    sizes = [int(w.sum()) for w in words]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))])
    dealt = []
    for s, w, t in zip(names, words, goal, strict=True):
        order = rng(seed, "order", s is None, s).permutation(len(w))
        times = quota(w, t, order)
        # the source's permuted blocks, pass by pass
        dealt.append([b for p in range(MOST) for b in rng(seed, "pass", p, s is None, s).permutation(len(w)) if times[b] > p])
    shares = split_tree(np.array([len(d) for d in dealt], np.int64), out_shards, seed) if names else np.zeros((0, 0), np.int64)
    out = []
    for i, s in enumerate(names):
        homes: dict[int, list[int]] = {}
        ends = np.cumsum(shares[:, i])
        for k, b in enumerate(dealt[i]):
            homes.setdefault(int(b), []).append(int(np.searchsorted(ends, k, side="right")))
        out += [(s, b, sizes[i], goal[i], homes.get(j, [])) for j, (b, _) in enumerate(own[s])]
    return out


def block_words(rows: DataFrame, blocks: int, most: int = CELLS) -> tuple[int, DataFrame]:
    """Blocks of a source, halved until all sources' fit ``most``, and the words of each: __source, b, w."""
    while True:
        found = cut(rows.groupBy("__source", F.pmod("__hash", F.lit(blocks)).cast("int").alias("b")).agg(F.sum("size").alias("w")))
        if blocks == 1 or found.count() <= most:
            return blocks, found
        blocks //= 2


def mix_plan(docs: DataFrame, *, id_col: str, text_col: str, source_col: str, blocks: int, out_shards: int, weights: tuple, seed: int, keep: tuple[str, ...] = (), most_cells: int = CELLS) -> DataFrame:
    """Rows of ``docs`` with doc_id, size, source_size, target, pieces of a shard, and copies: mix_shard and mix_order of each."""
    text = F.xxhash64(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("__source"), n_words(text_col).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), text).alias("__hash"),
        F.struct(*[F.col(c) for c in keep]).alias("__keep") if keep else F.lit(None).cast("int").alias("__keep"),
    )
    if not keep:
        rows = cut(rows)
    blocks, cells = block_words(rows, blocks, most_cells)
    found = cells.collect()
    plan = docs.sparkSession.createDataFrame(
        plan_mix([(r["__source"], r["b"], r["w"]) for r in found], out_shards, weights, seed),
        "__s string, __b int, source_size long, target double, __homes array<int>",
    )
    words = sum(r["w"] for r in found)
    if len(found) <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    joined = rows.join(plan, F.col("__source").eqNullSafe(F.col("__s")) & (F.pmod("__hash", F.lit(blocks)).cast("int") == F.col("__b")))
    # a random place in the shard, by document, pass and shard
    copies = F.transform("__homes", lambda home, k: F.struct(home.alias("mix_shard"), F.xxhash64(F.lit(seed), F.col("__hash"), k, home).alias("mix_order")))
    joined = joined.select("doc_id", "__source", "size", "source_size", "target", copies.alias("copies"), "__keep")
    return joined.withColumn("pieces", F.lit(max(1, -(-words // (out_shards * PIECE_WORDS)))))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = BLOCKS, out_shards: int = OUT_SHARDS, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy taken, with mix_shard and mix_order.

    Rows of an output shard stand in shuffled order, a large shard's in
    several partitions that each hold a range of that order. Null text
    has no words; a null source is a source of its own, the last. Sources
    without words get no target. Documents are dealt by id and text, so rows that
    repeat both are taken together. An empty table gives an empty mix. If ``docs``
    itself has columns called mix_shard or mix_order, the new ones replace them.
    """
    keep = tuple(c for c in docs.columns if c.lower() not in ("mix_shard", "mix_order"))
    plan = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, blocks=blocks, out_shards=out_shards, weights=weights, seed=seed, keep=keep)
    copies = plan.select("__keep", "pieces", F.explode("copies").alias("__copy")).select("__keep", "pieces", "__copy.mix_shard", "__copy.mix_order")
    # the order is a number of 64 bits; a piece holds as many of its upper 31 bits as any other
    piece = F.floor(F.shiftrightunsigned("mix_order", 33) * F.col("pieces") / F.lit(float(1 << 31)))
    return copies.withColumn("__piece", piece).repartition("mix_shard", "__piece").sortWithinPartitions("mix_shard", "__piece", F.shiftrightunsigned("mix_order", 33), "mix_order").select(*[F.col("__keep")[c].alias(c) for c in keep], "mix_shard", "mix_order")


def op9(spark, sf_dir: str) -> DataFrame:
    """Words taken of each document, and for each copy the output shard that the tree gave it and its place there."""
    plan = mix_plan(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text", source_col="source", blocks=BLOCKS, out_shards=OUT_SHARDS, weights=WEIGHTS, seed=SEED)
    taken = (F.col("size") * F.size("copies")).alias("taken")
    return plan.select("doc_id", "size", "source_size", "target", taken, F.col("copies.mix_shard").alias("mix_shards"), F.col("copies.mix_order").alias("mix_orders"))
