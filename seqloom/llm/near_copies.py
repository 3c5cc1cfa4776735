"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from SimHash first: fingerprints of the sets, and op10's generalised pigeonhole
(partitions of correlated bits, thresholds by dynamic programming) for those at most ``DISTANCE`` bits
apart. What these links connect is a family. Pairs of similarity 0.8 are 10 bits apart on average, farther than
any split of 64 bits searches in bounded work (README), so sets also meet by MinHash: 16 keys of 4
minima each, of which a pair of similarity 0.8 shares one with probability 0.9998, a closer one
with more. Families and sets of equal key are buckets; buckets with the same sets count once. Within a
bucket each pair is decided by its exact similarity, so neither bits nor a shared key alone link anything.

A bucket of more than ``BLOCK`` sets or ``BYTES`` is dealt into stripes, and each two stripes are a
cell, so all pairs are compared, however large the bucket, and no task holds more than two
stripes. A cell yields links that span what its pairs connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, text_bytes
from .components import components
from .simhash import SEED, bits_set, keep_least, links, majority

SHINGLE, BANDS, ROWS, BLOCK, BYTES = 5, 16, 4, 200, 32 << 20
#: Differing bits up to which fingerprints link.
DISTANCE = 8
#: Odd factors of the hash functions, and one that joins the minima of a key.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
JOIN = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted XXH64 of the distinct word shingles; A-Z are lower-cased; fewer words are one shingle."""
    words, digest = text.lower().split(), xxhash.xxh64_intdigest
    n = max(len(words) - shingle + 1, 1)
    return np.unique(np.array([digest(b" ".join(words[k : k + shingle]), SEED) for k in range(n)], np.uint64))


def keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band from the minima of its hash functions."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[k : k + 4096, None] * FACTORS).min(axis=0))
    out = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * JOIN
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def similar(sets: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """For each set the least one that it reaches over pairs of a similarity of 0.8 or more.

    If ``left`` tells two sides apart, only pairs across are compared. An index of the sets by
    shingle gives what each shares with the others; once all are connected, nothing more is asked.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    across = left.any() and not left.all()
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    doc = np.repeat(np.arange(n), sizes)
    order = np.argsort(token, kind="stable")
    if across:
        order = order[~left[doc[order]]]
    holders, df = doc[order], np.bincount(token[order], minlength=int(token.max()) + 1)
    first, ends, root = np.cumsum(df) - df, np.cumsum(sizes), np.arange(n)
    for i in np.flatnonzero(left) if across else range(1, n):
        own = token[ends[i] - sizes[i] : ends[i]]
        own = own[df[own] > 0]
        width = df[own]
        at = np.repeat(first[own] - np.cumsum(width) + width, width) + np.arange(width.sum())
        shared = np.bincount(holders[at], minlength=n)
        near = np.flatnonzero((shared > 0) & (9 * shared >= 4 * (sizes + sizes[i])))  # shared / (a + b - shared) >= 0.8
        roots = root[np.append(near, i)]
        if roots.min() != roots.max():
            root[np.isin(root, roots)] = roots.min()
            if not root.any():
                break
    return root


def cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each cell from rows (cell, node, left, set) sorted by cell."""
    held: list[tuple[int, bool, bytes]] = []
    current = None

    def work() -> tuple[np.ndarray, np.ndarray]:
        rows = sorted({h[0]: h for h in held}.values())
        nodes = np.array([h[0] for h in rows], np.int64)
        if len(rows) < 2:
            return nodes[:0], nodes[:0]
        sets = [np.frombuffer(h[2], np.uint64) for h in rows]
        if len(sets) == 2:
            shared = len(np.intersect1d(*sets, assume_unique=True))
            root = np.array([0, 0 if 9 * shared >= 4 * (len(sets[0]) + len(sets[1])) else 1])
        else:
            root = similar(sets, np.array([h[1] for h in rows]))
        linked = np.flatnonzero(root != np.arange(len(root)))
        return nodes[root[linked]], nodes[linked]

    for b in batches:
        us, vs = [], []
        for cell, node, left, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if cell != current and held:
                for out, x in zip((us, vs), work(), strict=True):
                    out.append(x)
                held = []
            current = cell
            held.append((node, left, own))
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (us, vs)], names=["u", "v"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in work()], names=["u", "v"])


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tkey, node, size, fp, keys): tkey is a hash of the text, node one of its set of shingles, fp the set's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(2)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            prints = np.array([majority(bits_set(s), len(s)) for s in sets], np.uint64).view(np.int64)
            found = pa.array([keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), found], names=["doc_id", "tkey", "node", "size", "fp", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tkey"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, tkey long, node long, size long, fp long, keys array<long>")


def cells_of(met: DataFrame, block: int, most: int) -> DataFrame:
    """(cell, left, node) from (bucket, n, bytes, node): a row for each other stripe of its bucket, and its own."""
    stripes = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / most)).cast("long")
    rows = met.select("bucket", "node", stripes.alias("stripes"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), "stripes"))
    rows = rows.select("bucket", "node", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1)).alias("other"))
    return rows.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), (F.col("own") < F.col("other")).alias("left"), "node")


def families(nodes: DataFrame, distance: int) -> DataFrame:
    """(node, size, family) from (node, size, fp): a family is what fingerprints within ``distance`` connect."""
    prints = cut(nodes.select("fp").distinct())
    roots = components(links(prints, distance=distance)).select(F.col("node").alias("fp"), F.col("root").alias("family"))
    return nodes.join(roots, "fp", "left").select("node", "size", F.coalesce("family", "fp").alias("family"))


def near_copy_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, most_bytes: int = BYTES, distance: int = DISTANCE, minhash: bool = True) -> DataFrame:
    """(doc_id, tkey, root, component_id) for each row of ``docs``.

    ``component_id`` is the least doc_id whose text is reachable over links, ``root`` names the
    component. Texts without a word, null or not, are copies of each other. Null ids
    are never a component_id unless a component has no other. Without ``minhash``, only
    pairs of one family are decided.
    """
    scratch = Scratch()
    rows = cut(signatures(docs, id_col, text_col))
    nodes = cut(rows.groupBy("node").agg(F.min("tkey").alias("tkey"), F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    bands = scratch.cut(families(nodes, distance)).select("node", "size", F.lit(-1).alias("band"), F.col("family").alias("key"))
    if minhash:
        bands = bands.unionByName(nodes.select("node", "size", F.posexplode("keys").alias("band", "key")))
    members = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")
    buckets = scratch.cut(bands.groupBy("band", "key").agg(F.count("*").alias("n"), (8 * F.sum("size")).alias("bytes"), members).filter("n > 1"))
    # most pairs meet under many keys: of buckets with the same sets one is enough
    alike = buckets.groupBy("members", "n").agg(F.min(F.struct("band", "key")).alias("b"), F.first("bytes").alias("bytes"))
    alike = scratch.cut(alike.select("b.band", "b.key", "n", "bytes"))
    met = scratch.cut(bands.join(alike, ["band", "key"]).select(F.xxhash64("band", "key").alias("bucket"), "n", "bytes", "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["node", "set"])

    wanted = scratch.cut(met.select("node").distinct().join(nodes.select("node", "tkey"), "node"))
    texts = docs.select(F.xxhash64(F.col(text_col)).alias("tkey"), text_bytes(text_col).alias("text")).join(wanted, "tkey").dropDuplicates(["node"])
    sets = scratch.cut(texts.select("node", "text").mapInArrow(run, "node long, set binary"))
    cells = scratch.cut(cells_of(met, block, most_bytes)).join(sets, "node")
    found = cells.select("cell", "node", "left", "set").repartition("cell").sortWithinPartitions("cell").mapInArrow(cell_links, "u long, v long")
    roots = components(found).withColumnRenamed("root", "top")
    scratch.drop()
    rooted = cut(nodes.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("top", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = rooted.join(least, "root").select("node", "root", "component_id")
    return rows.join(labels, "node").select("doc_id", "tkey", "root", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: a row with the component's least doc_id."""
    return keep_least(docs, near_copy_components(docs, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)
