"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into ``SLOTS`` slots, the same for any number of shards. A document's
slot comes from the hash of its key, which is its id and its text. Documents of one slot and one
size class (power of two of their bytes) form a *cell*, the unit that is placed: it goes
to the shard of the first virtual node clockwise from its slot whose load would stay
within the capacity, ``(1 + epsilon)`` times the mean. Cells that find a shard full
continue clockwise. Larger cells are placed first, so that the small ones even out
what is left. With a further shard the cells are the same, and most meet the same node.

Only repeated rows can make a cell heavy. One above a ``HEAVY``-th of a shard is dealt by row
into parts, which are cells of their own.

The driver sees one row per cell, at most ``SLOTS * 64`` and the parts, as many for any
number of documents. A document's place inside its shard is the cell's first place plus
its rank in the cell by key. Ranks are counted in stretches of the cell's keys, as many as keep
one to about ``STRETCH`` rows, so no task ever holds a whole shard or cell.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

SHARDS, VIRTUAL_NODES, EPSILON, SEED = 40, 512, 0.0005, 7
#: A power of two, some hundred times the shards, or cells are too coarse to balance; it stays as it is when shards are added.
SLOTS = 16_384
#: Bytes that a row counts besides those of its text.
ROW_BYTES = 16
#: A cell of more than this fraction of a shard is split; rows of a cell that are ranked together.
HEAVY, STRETCH = 64, 20_000
CELL = ["__slot", "__class", "__part"]


def ring(shards: int, virtual_nodes: int, seed: int) -> tuple[list[int], list[int]]:
    """Positions of the virtual nodes in [0, 2**32), ascending, and their shards.

    A node's position depends on its own shard and number only, so a further
    shard leaves all others where they are.
    """
    def place(shard: int, node: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{seed}/{shard}/{node}".encode(), digest_size=4).digest(), "big")

    nodes = sorted((place(s, v), s) for s in range(shards) for v in range(virtual_nodes))
    return [p for p, _ in nodes], [s for _, s in nodes]


def place_cells(cells: Iterable[tuple[tuple, int]], shards: int, slots: int = SLOTS, virtual_nodes: int = VIRTUAL_NODES, epsilon: float = EPSILON, seed: int = SEED) -> dict[tuple, int]:
    """Shard of each cell ``((slot, ...), bytes)`` under the capacity.

    A cell larger than the room of every shard goes to the shard with most
    room, the first clockwise among equals.
    """
    at, owner = ring(shards, virtual_nodes, seed)
    cells = sorted(cells, key=lambda c: (-c[1], c[0]))
    capacity = (1 + epsilon) * sum(c[1] for c in cells) / shards
    load = [0] * shards
    out = {}
    for cell, weight in cells:
        first = bisect_left(at, cell[0] * (1 << 32) // slots)
        if min(load) + weight <= capacity:
            while load[s := owner[first % len(at)]] + weight > capacity:
                first += 1
        else:
            low = min(load)
            while load[s := owner[first % len(at)]] > low:
                first += 1
        load[s] += weight
        out[cell] = s
    return out


def sized(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...], seed: int, slots: int) -> DataFrame:
    """doc_id, size, text_crc32, key, slot, size class and what is kept of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + F.lit(ROW_BYTES)
    crc = F.crc32(text.cast("binary"))
    key = F.xxhash64(F.lit(seed), F.col(id_col), crc)
    return docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), key.alias("__key"),
        F.shiftrightunsigned(key, 64 - (slots.bit_length() - 1)).cast("int").alias("__slot"),
        F.floor(F.log2(size)).cast("int").alias("__class"),
        F.struct(*[F.col(c) for c in keep]).alias("__keep") if keep else F.lit(None).cast("int").alias("__keep"),
    )


def split_heavy(rows: DataFrame, shards: int, heavy: int) -> tuple[DataFrame, list]:
    """``rows`` with ``__part``, 0 but in heavy cells, and the cells with their bytes and rows."""
    cells = rows.groupBy("__slot", "__class").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    most = sum(r["b"] for r in cells) / (shards * heavy)
    # parts are of many rows each; a heavy cell of few rows holds large documents, which can't be split
    parts = {(r["__slot"], r["__class"]): int(min(r["b"] // most + 1, r["n"] // 2)) for r in cells if r["b"] > most and r["n"] >= 4}
    if not parts:
        return rows.withColumn("__part", F.lit(0)), [((r["__slot"], r["__class"], 0), r["b"], r["n"]) for r in cells]
    # rows are numbered once they are written, so the numbers hold for all that follows; at most shards * heavy cells are heavy
    rows = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    known = F.broadcast(rows.sparkSession.createDataFrame([(*k, n) for k, n in parts.items()], "__slot int, __class int, __parts int"))
    rows = rows.join(known, ["__slot", "__class"], "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64("__row"), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts", "__row")
    cells = rows.groupBy(*CELL).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return rows, [(tuple(r[c] for c in CELL), r["b"], r["n"]) for r in cells]


def ranked(rows: DataFrame, most: int, slots: int, stretch: int) -> DataFrame:
    """``rows`` with ``__rank``: 0, 1, ... in each cell by key. ``most``: rows of the largest cell."""
    order = Window.partitionBy(*CELL).orderBy("__key", "doc_id", "text_crc32")
    if most <= stretch:
        return rows.withColumn("__rank", F.row_number().over(order) - 1)
    # a stretch is a range of keys: the bits behind the slot's
    bits = min(20, (-(-most // stretch) - 1).bit_length())
    behind = F.shiftleft("__key", slots.bit_length() - 1)
    rows = rows.withColumn("__stretch", F.shiftrightunsigned(behind, 64 - bits).cast("int"))
    counts = rows.groupBy(*CELL, "__stretch").agg(F.count("*").alias("__n"))
    before = counts.select(*CELL, "__stretch", (F.sum("__n").over(Window.partitionBy(*CELL).orderBy("__stretch")) - F.col("__n")).alias("__before"))
    inside = Window.partitionBy(*CELL, "__stretch").orderBy("__key", "doc_id", "text_crc32")
    return rows.join(before, [*CELL, "__stretch"]).withColumn("__rank", F.col("__before") + F.row_number().over(inside) - 1)


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text", virtual_nodes: int = VIRTUAL_NODES, epsilon: float = EPSILON, seed: int = SEED, slots: int = SLOTS,
    keep: tuple[str, ...] = (), heavy: int = HEAVY, stretch: int = STRETCH,
) -> DataFrame:
    """``docs`` dealt to ``shards`` shards of near equal bytes.

    Returns doc_id, size, text_crc32, shard and slot (0, 1, ... without gaps in
    each shard), and the columns named in ``keep``. Size is the text's UTF-8
    bytes plus 16. Null text: no bytes, crc 0, like the empty text. A null id is
    placed by its text alone. Repeated rows are rows of their own, each with its
    own slot, and may go to several shards. An empty table gives no rows. Further columns
    of ``docs`` don't matter, whatever their names.
    """
    rows = sized(docs, id_col, text_col, keep, seed, slots)
    if not keep:  # slim rows are read twice; texts are not worth a copy
        rows = cut(rows)
    rows, cells = split_heavy(rows, shards, heavy)
    placed = place_cells(((c, b) for c, b, _ in cells), shards, slots, virtual_nodes, epsilon, seed)
    base, plan = [0] * shards, []
    for c, _, n in sorted(cells):
        plan.append((*c, placed[c], base[placed[c]]))
        base[placed[c]] += n
    # At most slots * 64 rows of 24 bytes and the parts, whatever the number of documents.
    cells_df = F.broadcast(docs.sparkSession.createDataFrame(plan, "__slot int, __class int, __part int, shard int, __base long"))
    out = ranked(rows, max((n for *_, n in cells), default=0), slots, stretch).join(cells_df, CELL)
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("__base") + F.col("__rank")).cast("long").alias("slot"), *[F.col("__keep")[c].alias(c) for c in keep])


def op1(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
