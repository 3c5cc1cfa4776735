"""Token counts of documents in flat token files that have no index.

A token file is a run of little-endian 16-bit identifiers; an end-of-document
identifier closes each document. Files are scanned in blocks, anywhere a block
happens to begin: a vectorised comparison finds the separators, and gives the counts
between them, the tokens before the first (the head) and those after the last (the tail).
A document that spans blocks is stitched by a prefix scan over the blocks of its file:
its head adds what earlier blocks left open, its number the separators before.

``write_tokens`` makes such files from texts, one for each task, in the shared folder.
A retried task writes a file of another name; only files of tasks that ended well
are in the list, so lost executors and second attempts leave nothing behind in it.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shared_dir, table, text_bytes

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
END, BLOCK = 50_256, 1 << 20
#: How that vocabulary's texts are cut before merging (a fixed value of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def open_dir(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", end: int = END) -> tuple[str, DataFrame]:
    """Writes the texts' tokens to flat files; returns (file, n, doc_id): the n-th document of a file.

    Rows with n = -1 carry the file's number of tokens, separators included, in
    doc_id. Files are names in a new folder, which is returned too. Null and empty texts
    have no tokens but a separator; repeated rows are documents of their own.
    """
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, path = open_dir(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tok"
        encode, n, tokens = tokenizer(vocabulary).encode_ordinary, 0, 0

        def rows(numbers, ids):
            return pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(numbers, pa.int64()), pa.array(ids, pa.int64())], names=["file", "n", "doc_id"])

        with store.open_output_stream(f"{path}/{name}") as out:
            for b in batches:
                for t in b.column(1):
                    ids = np.array([*encode(t.as_py().decode("utf-8", "replace")), end], "<u2")
                    out.write(ids.tobytes())
                    tokens += len(ids)
                yield rows(np.arange(n, n + b.num_rows), b.column(0).to_pylist())
                n += b.num_rows
        yield rows([-1], [tokens])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return folder, cut(rows.mapInArrow(run, "file string, n long, doc_id long"))


def scan_block(tokens: np.ndarray, end: int) -> tuple[int, int, int, np.ndarray]:
    """Separators, head, tail, and counts of the documents that begin and end inside."""
    at = np.flatnonzero(tokens == end)
    if not len(at):
        return 0, len(tokens), len(tokens), at
    return len(at), int(at[0]), len(tokens) - 1 - int(at[-1]), np.diff(at) - 1


def count_tokens(folder: str, files: DataFrame, *, end: int = END, block: int = BLOCK) -> DataFrame:
    """(file, n, n_tokens) of each document in ``files`` (file, tokens: its length) of a folder.

    The separator isn't counted. Tokens after a file's last separator are a
    document of their own. A file without tokens has no documents. Files are
    listed once each; there may be none. All are read before this returns.
    """
    blocks = files.filter("tokens > 0").select("file", "tokens", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / block).cast("long"))).alias("block"))
    blocks = blocks.repartition("file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_dir(folder)
        for b in batches:
            for file, tokens, k in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                with store.open_input_file(f"{path}/{file}") as source:
                    data = np.frombuffer(source.read_at(2 * min(block, tokens - k * block), 2 * k * block), "<u2")
                ends, head, tail, inner = scan_block(data, end)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (file, k, ends, head, tail)] + [pa.array([inner], pa.list_(pa.int64()))], names=["file", "block", "ends", "head", "tail", "inner"])

    found = cut(blocks.mapInArrow(run, "file string, block long, ends long, head long, tail long, inner array<long>"))
    by_file = Window.partitionBy("file").orderBy("block")
    found = found.withColumn("closed", F.sum("ends").over(by_file))
    # tails since the last separator, summed up to and with this block
    opened = F.sum("tail").over(Window.partitionBy("file", "closed").orderBy("block"))
    found = found.withColumn("open", opened).withColumns({"before": F.col("closed") - F.col("ends"), "carry": F.coalesce(F.lag("open").over(by_file), F.lit(0)), "last": F.lead("block").over(by_file).isNull()})
    first = F.when(F.col("ends") > 0, F.array(F.col("carry") + F.col("head"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    # a block without a separator only passes its tokens on; the last one may leave a document open
    rest = F.when(F.col("last") & (F.col("open") > 0), F.array("open")).otherwise(F.expr("cast(array() as array<bigint>)"))
    return found.select("file", "before", F.posexplode(F.concat(first, "inner", rest)).alias("k", "n_tokens")).select("file", (F.col("before") + F.col("k")).alias("n"), "n_tokens")


def drop_tokens(folder: str) -> None:
    """Deletes a folder of token files, whatever attempts left in it too."""
    store, path = open_dir(folder)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_dir(path)


def op7(spark, sf_dir: str) -> DataFrame:
    folder, written = write_tokens(table(spark, sf_dir, "documents"))
    try:
        files = written.filter("n < 0").select("file", F.col("doc_id").alias("tokens"))
        counts = count_tokens(folder, files)  # has read the files when it returns
    finally:
        drop_tokens(folder)
    return written.filter("n >= 0").join(counts, ["file", "n"]).select("doc_id", "n_tokens")
