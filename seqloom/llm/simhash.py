"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints have 64 bits; two texts are linked if theirs differ in at most three.
Bits that agree or disagree together (by their correlation over all distinct
fingerprints) are grouped into m partitions. Any thresholds t_1..t_m that sum
to 3 - m + 1 find every link: in one partition at least the two differ in at
most t_i bits (-1: the partition is not probed). Dynamic programming picks the
thresholds, and the best m, from the estimated cost of probes and candidates.
A probe is a fingerprint's bits in a partition, with each choice of up to t_i of
them turned. Equal probes meet in a bucket, where the full distance decides.

A bucket yields a spanning forest of its links, not all pairs, and is worked
on in a stream of sorted rows. One with more than ``BUCKET`` fingerprints goes
another exact way: fingerprints at most 3 apart are at most 1 and 2 away from
a common point, so each is sent to all points near it and each point links those
that meet there. Copies share a fingerprint and take part once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, partial
from itertools import accumulate, combinations
from math import comb, exp, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_bytes
from .components import components

BITS, DISTANCE, SHINGLE, SEED, BUCKET = 64, 3, 3, 42, 4096
#: Relative costs of a probe's row and of a candidate pair.
PROBE_COST, PAIR_COST = 1.0, 0.02


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash over the XXH64 of all word shingles; A-Z are lower-cased; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    counts, n = np.zeros(BITS, np.int64), len(words) - shingle + 1
    for k in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : min(n, k + (1 << 16))], ends[k + shingle - 1 :], strict=False)], "<u8")
        counts += bits_set(hashes)
    return majority(counts, n)


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits set in over half of ``n`` hashes."""
    return sum(1 << int(j) for j in np.flatnonzero(2 * counts > n))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tkey, fp): tkey is a hash of the text, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.int64())], names=["doc_id", "tkey", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tkey"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, tkey long, fp long")


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each two bits are both set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + (x.T @ x).astype(np.float64), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["i", "c"])

    rows = prints.select("fp").mapInArrow(run, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        flat[r["i"]] = r["c"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of near equal size; each is grown from the most correlated bits left."""
    p = np.diag(both) / max(n, 1)
    var = np.sqrt(p * (1 - p))
    scale = np.outer(var, var)
    corr = np.abs(np.divide(both / max(n, 1) - np.outer(p, p), scale, out=np.zeros_like(scale), where=scale > 1e-12))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        sub = corr[np.ix_(left, left)]
        group = [left[int(np.argmax(sub.max(axis=1)))]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].mean(axis=1)))])
        out.append(sorted(group))
        left = [b for b in left if b not in group]
    return out


def differing(n: int, both: np.ndarray) -> np.ndarray:
    """For each two bits the chance that two fingerprints differ in both, from how often both are set."""
    p11 = both / max(n, 1)
    p = np.diag(p11)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    return 2 * (p11 * (1 - p10 - p01 - p11) + p10 * p01)


def spread(group: list[int], differ: np.ndarray) -> np.ndarray:
    """Chance of each number of differing bits in a group.

    Bits of a group go together, so small and large numbers are likelier than if they were independent:
    the law is beta-binomial, with the group's own mean and variance.
    """
    size, q = len(group), differ[group, group]
    law = np.array([1.0])
    for x in q:
        law = np.convolve(law, [1 - x, x])
    mean = q.sum() / size
    plain = size * mean * (1 - mean)
    if size < 2 or plain <= 0:
        return law
    tie = min(((differ[np.ix_(group, group)].sum() - q.sum() ** 2) / plain - 1) / (size - 1), 0.999)
    if tie <= 1e-3:
        return law
    a, b, k = mean * (1 / tie - 1), (1 - mean) * (1 / tie - 1), range(size + 1)
    return np.array([comb(size, i) * exp(lgamma(i + a) + lgamma(size - i + b) - lgamma(size + a + b) - lgamma(a) - lgamma(b) + lgamma(a + b)) for i in k])


def allocate(n: int, differ: np.ndarray, groups: list[list[int]], distance: int = DISTANCE) -> tuple[float, list[int]]:
    """Least cost and thresholds of the groups, summing to distance - m + 1, by dynamic programming.

    ``differ``: as from ``differing``.
    """
    choice: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in groups:
        pairs = n * n / 2 * np.cumsum(spread(g, differ))
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, picked) in choice.items():
            for t in range(-1, min(distance, len(g)) + 1):
                more = 0.0 if t < 0 else PROBE_COST * n * sum(comb(len(g), k) for k in range(t + 1)) + PAIR_COST * pairs[t]
                if (old := step.get(used + t)) is None or cost + more < old[0]:
                    step[used + t] = (cost + more, [*picked, t])
        choice = step
    return choice.get(distance - len(groups) + 1, (float("inf"), []))


def probe_plan(n: int, both: np.ndarray, most: int = 6, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """The probed partitions and their thresholds."""
    differ = differing(n, both)
    plans = [(g, *allocate(n, differ, g, distance)) for g in (group_bits(n, both, m) for m in range(2, most + 1))]
    groups, _, thresholds = min(plans, key=lambda x: x[1])
    return [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@cache
def turned(bits: tuple[int, ...], most: int) -> list[int]:
    """Masks of 0 to ``most`` of the bits, as signed longs; 0 is first."""
    return [signed(sum(1 << b for b in c)) for k in range(most + 1) for c in combinations(bits, k)]


def roots_of(n: int, u: np.ndarray, v: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Least node that each of ``n`` reaches over links u-v."""
    root = np.arange(n) if root is None else root
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def forest(key: np.ndarray, prints: np.ndarray, home: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what the pairs of equal ``key`` within ``distance`` connect. Rows are sorted by key."""
    nodes, node = np.unique(prints, return_inverse=True)
    unsigned = nodes.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
    root, row, step = np.arange(len(nodes)), np.arange(len(key) - 1), 1
    us, vs, waiting = [], [], 0
    while len(row):
        row = row[row + step < len(key)]
        row = row[key[row] == key[row + step]]
        a, b = node[row], node[row + step]
        ok = (home[row] | home[row + step]) & (root[a] != root[b])
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(unsigned[a] ^ unsigned[b]) <= distance
        us.append(a[ok])
        vs.append(b[ok])
        waiting += int(ok.sum())
        if waiting > 50_000:
            root = roots_of(len(nodes), np.concatenate(us), np.concatenate(vs), root)
            us, vs, waiting = [], [], 0
        step += 1
    if waiting:
        root = roots_of(len(nodes), np.concatenate(us), np.concatenate(vs), root)
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[linked]], nodes[linked]


def bucket_links(batches: Iterable[pa.RecordBatch], rows: int = 200_000, distance: int = DISTANCE) -> Iterator[pa.RecordBatch]:
    """Spanning links of each bucket from rows (part, key, fp, home) sorted by part and key."""
    held: list[list[np.ndarray]] = []

    def work(parts: list[list[np.ndarray]], last: bool) -> Iterator[pa.RecordBatch]:
        part, key, fp, home = (np.concatenate(x) for x in zip(*parts, strict=True))
        bucket = np.cumsum(np.append(0, (np.diff(key) != 0) | (np.diff(part) != 0)))
        cutoff = len(key) if last else int(np.searchsorted(bucket, bucket[-1]))
        parts[:] = [] if last else [[x[cutoff:].copy() for x in (part, key, fp, home)]]
        u, v = forest(bucket[:cutoff], fp[:cutoff], home[:cutoff], distance)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        if b.num_rows:
            held.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "key", "fp", "home")])
            if sum(len(h[0]) for h in held) >= rows:
                yield from work(held, False)
    if held:
        yield from work(held, True)


def hub_links(prints: DataFrame) -> DataFrame:
    """Links of a set of fingerprints by meeting points: linear in their number, whatever their buckets."""
    near = F.transform(F.array(*[F.lit(x) for x in turned(tuple(range(BITS)), 1)]), lambda x: F.col("fp").bitwiseXOR(x))
    wide = F.transform(F.array(*[F.lit(x) for x in turned(tuple(range(BITS)), 2)]), lambda x: F.col("fp").bitwiseXOR(x))
    met = prints.select("fp", F.explode(near).alias("hub"), F.lit(True).alias("near")).unionByName(prints.select("fp", F.explode(wide).alias("hub"), F.lit(False).alias("near")))
    # a point has at most 1 + 64 + 2016 fingerprints near it
    hubs = met.groupBy("hub").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("u"), F.collect_set("fp").alias("all")).filter("u is not null and size(all) > 1")
    return hubs.select("u", F.explode("all").alias("v")).filter("u <> v").distinct()


def links(prints: DataFrame, bucket: int = BUCKET, distance: int = DISTANCE) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that connect what ``distance`` connects.

    Large buckets meet at points up to a distance of 3 only; beyond it they are compared whole.
    """
    n, both = bit_counts(prints)
    probes = []
    for i, (bits, most) in enumerate(probe_plan(n, both, distance=distance)):
        mask = signed(sum(1 << b for b in bits))
        own = F.col("fp").bitwiseAND(F.lit(mask))
        if most:
            turns = F.explode(F.array(*[F.lit(x) for x in turned(tuple(bits), most)])).alias("turn")
            rows = prints.select("fp", own.alias("own"), turns).select(F.lit(i).alias("part"), F.col("own").bitwiseXOR(F.col("turn")).alias("key"), "fp", (F.col("turn") == 0).alias("home"))
        else:
            rows = prints.select(F.lit(i).alias("part"), own.alias("key"), "fp", F.lit(True).alias("home"))
        probes.append(rows)
    rows = probes[0]
    for more in probes[1:]:
        rows = rows.unionByName(more)
    if distance > DISTANCE:
        within = partial(bucket_links, distance=distance)
        return rows.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(within, "u long, v long")
    hot = cut(rows.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("part", "key"))
    found = None
    if not hot.isEmpty():
        found = hub_links(cut(rows.join(hot, ["part", "key"], "left_semi").select("fp").distinct()))
        rows = rows.join(hot, ["part", "key"], "left_anti")
    cold = rows.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(bucket_links, "u long, v long")
    return cold if found is None else cold.unionByName(found)


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, tkey, fp, root, component_id) for each row of ``docs``.

    ``component_id`` is the least doc_id whose text is reachable over links, ``root``
    the component's least fingerprint. Null and empty texts and those without a
    word have fingerprint 0, linked like any other; so do fewer words than a
    shingle, by their whole sequence. Null ids are never a component_id unless a
    component has no other. Repeated rows stay rows of their own. An empty table
    gives no rows; names of other columns don't matter.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(prints, bucket))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "root", "component_id")
    return rows.join(labels, "fp").select("doc_id", "tkey", "fp", "root", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: a row with the component's least doc_id."""
    return keep_least(docs, simhash_components(docs, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)


def keep_least(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each root of ``labelled`` (doc_id, tkey, root, component_id).

    A component of null ids keeps one of its rows; of rows that repeat the least id and its text the
    one with the least hash of all columns stays, so reruns agree.
    """
    found = cut(labelled.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))
    one = found.groupBy("root").agg(F.min(F.struct("doc_id", "tkey")).alias("k"))
    kept = cut(one.select(F.col("k.doc_id").alias("__id"), F.col("k.tkey").alias("__key")))
    doc_key = [F.col(id_col).cast("long").eqNullSafe(F.col("__id")), F.xxhash64(F.col(text_col)) == F.col("__key")]
    out = docs.join(kept, doc_key, "left_semi")
    n, rows = kept.count(), found.count()
    if rows > n:  # some ids or whole rows repeat
        names = docs.columns
        picked = out.groupBy(F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.col(text_col)).alias("__key")).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("__row"))
        out = picked.select(*[F.col("__row")[c].alias(c) for c in names])
    return out


def op10(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
