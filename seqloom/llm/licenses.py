"""License scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Every line of a text, every block of neighbouring lines that share words with the templates
(a header wrapped over comment lines, a whole licence), and the text as a whole is a vector
over the words of the license templates, weighed by inverse document frequency over all
documents; numbers, which tell versions apart, weigh ``VERSION`` times that. A word that no template
has weighs like the rarest one: it only lengthens the vector. The template with the
largest cosine is the unit's, if that reaches ``LEAST``; a text takes the license of its
best unit, of equal ones the longest. If that has several lines and four fifths of the words, the text
stands for a license file.

A text without one of its own inherits from the nearest directory above it that has a
license file: each path joins the directories with license files by each of its
ancestors, a number bounded by its depth, and the longest match counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_bytes
from .license_texts import TEMPLATES

LEAST = 0.6
WORDS = re.compile(rb"[a-z0-9]+(?:\.[0-9]+)*")
VERSION = 3.0
NUMBER = re.compile(rb"v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*")


def words_of(line: bytes) -> list[bytes]:
    """Words in lower case; 2.0 and v2 are 2."""
    return [m[1] if w[-1] < 58 and (m := NUMBER.fullmatch(w)) else w for w in WORDS.findall(line.lower())]


class Templates:
    """Unit vectors of the templates over their own words."""

    def __init__(self, rows: tuple[tuple[str, str], ...] = TEMPLATES, frequency: dict[bytes, int] | None = None, documents: int = 0):
        self.names = [name for name, _ in rows]
        counts = [Counter(words_of(text.encode())) for _, text in rows]
        vocabulary = sorted({w for c in counts for w in c})
        frequency = frequency or {}
        self.weight = {w: float(np.log((1 + documents) / (1 + frequency.get(w, 0))) + 1) * (VERSION if w[0] < 58 else 1) for w in vocabulary}
        self.rare = float(np.log(1 + documents) + 1)
        self.number = {w: k for k, w in enumerate(vocabulary)}
        self.matrix = np.array([[(1 + np.log(c[w])) * self.weight[w] if w in c else 0.0 for w in vocabulary] for c in counts])
        self.matrix /= np.linalg.norm(self.matrix, axis=1, keepdims=True)
        self.known = set(vocabulary)
        self.square = {w: x * x for w, x in self.weight.items()}

    def may_reach(self, words: list[bytes], least: float) -> bool:
        """Whether the cosine can be ``least``, by an upper bound; most lines stop here.

        No word comes more often than ``most`` times, which bounds the known words' part
        of the vector from above; unknown words count once each, which bounds theirs from below.
        """
        distinct = set(words)
        known = distinct & self.known
        if not known:
            return False
        most = 1 + log(len(words) - len(distinct) + 1)
        own = most * most * sum(self.square[w] for w in known)
        return own * (1 - least * least) >= least * least * self.rare * self.rare * (len(distinct) - len(known))

    def best(self, words: list[bytes]) -> tuple[float, int]:
        """Largest cosine and its template; the first among equals."""
        counts = Counter(words)
        known = [(self.number[w], (1 + np.log(n)) * self.weight[w]) for w, n in counts.items() if w in self.number]
        if not known:
            return 0.0, -1
        length = sum(x * x for _, x in known) + sum(((1 + np.log(n)) * self.rare) ** 2 for w, n in counts.items() if w not in self.number)
        cosine = self.matrix[:, [k for k, _ in known]] @ np.array([x for _, x in known]) / np.sqrt(length)
        k = int(cosine.argmax())
        return float(cosine[k]), k

    def units(self, lines: list[list[bytes]]) -> Iterator[tuple[int, int | None, list[bytes]]]:
        """(first line, line of its own or None, words) of all that is compared: lines, blocks, the whole.

        A block is a run of lines half of whose words, at least, are the templates'; lines without
        words don't end it.
        """
        block: list[int] = []
        for i, words in enumerate([*lines, [b""]]):
            if words and 2 * sum(w in self.known for w in words) >= len(words):
                block.append(i)
                yield i, i, words
            elif words:
                if len(block) > 1:
                    yield block[0], None, [w for k in block for w in lines[k]]
                block = []
                if i < len(lines):
                    yield i, i, words
        if len(lines) > 1:
            yield 0, None, [w for words in lines for w in words]

    def of_text(self, text: bytes, least: float = LEAST) -> tuple[str | None, float, int | None, bool]:
        """License, cosine, first line (from 0) of the best unit of a text, and whether it is several lines with four fifths of the words."""
        lines = [words_of(x) for x in text.split(b"\n")]
        total = sum(map(len, lines))
        best: tuple[float, int, int, int, int | None] = (0.0, 0, -1, 0, None)
        for first, line, words in self.units(lines):
            if self.may_reach(words, least):
                c, k = self.best(words)
                c = round(c, 9)  # equal but for the order of a sum
                if (c, len(words)) > best[:2]:
                    best = (c, len(words), k, first, line)
        c, n, k, first, line = best
        if c < least:
            return None, c, None, False
        return self.names[k], c, first, line is None and 5 * n >= 4 * total


def frequencies(docs: DataFrame, text_col: str, rows: tuple = TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """Documents, and how many of them hold each template word: counts over all, one row a word."""
    known = set(Templates(rows).number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for b in batches:
            for t in b.column(0):
                n += 1
                seen.update(known.intersection(words_of(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([*seen, b""], pa.binary()), pa.array([*seen.values(), n], pa.int64())], names=["w", "n"])

    found = docs.select(text_bytes(text_col).alias("text")).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["w"]): r["n"] for r in found}
    return counts.pop(b"", 0), counts


def own_licenses(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = LEAST, rows: tuple = TEMPLATES) -> DataFrame:
    """Columns ``keep`` of each row with license, cosine, line and whole (it is four fifths of the text) of its own text; null and empty texts have none."""
    documents, frequency = frequencies(docs, text_col, rows)
    templates = Templates(rows, frequency, documents)
    picked = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), text_bytes(text_col).alias("text"))
    schema = picked.select("kept").withColumns({"license": F.lit(None).cast("string"), "cosine": F.lit(0.0), "line": F.lit(None).cast("int"), "whole": F.lit(False)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [templates.of_text(t.as_py(), least) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int32(), pa.bool_()))]], names=["kept", "license", "cosine", "line", "whole"])

    return picked.mapInArrow(run, schema).select(*[F.col("kept")[c].alias(c) for c in keep], "license", "cosine", "line", "whole")


def inherit(files: DataFrame, *, path_col: str = "path", license_col: str = "license", is_license_file: str = r"(?i)(^|/)(license|licence|copying|unlicense)[^/]*$") -> DataFrame:
    """``files`` with effective (license) and inherited_from (a directory, null if its own or none).

    A license file speaks for its directory; of several there the least license counts.
    Paths have / between parts; '' is the topmost directory. A null path inherits
    nothing. Repeated rows stay rows of their own. Columns of ``files`` may have any names but
    those of the two results. The directories' table is not broadcast unless Spark measures it small.
    """
    names = files.columns
    files = files.select(F.struct(*[F.col(c) for c in names]).alias("__file"), F.col(path_col).alias("__path"), F.col(license_col).alias("__license"))
    rows = cut(files.withColumn("__row", F.monotonically_increasing_id()))
    path_col, license_col = "__path", "__license"
    parent = F.regexp_replace(F.col(path_col), r"/?[^/]*$", "")
    dirs = rows.filter(F.col(path_col).rlike(is_license_file) & F.col(license_col).isNotNull()).groupBy(parent.alias("__dir")).agg(F.min(license_col).alias("__inherits"))
    need = rows.filter(F.col(license_col).isNull() & F.col(path_col).isNotNull()).select("__row", F.split(F.col(path_col), "/").alias("__parts"))
    above = F.transform(F.sequence(F.lit(0), F.size("__parts") - 1), lambda n: F.array_join(F.slice("__parts", 1, n), "/"))
    found = need.select("__row", F.explode(above).alias("__dir")).join(dirs, "__dir").groupBy("__row").agg(F.max_by(F.struct("__dir", "__inherits"), F.length("__dir")).alias("__best"))
    out = rows.join(found, "__row", "left")
    return out.select(*[F.col("__file")[c].alias(c) for c in names], F.coalesce(F.col(license_col), F.col("__best.__inherits")).alias("effective"), F.col("__best.__dir").alias("inherited_from"))


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str = "path", least: float = LEAST) -> DataFrame:
    """doc_id, path, license, cosine, line, whole, effective, inherited_from of each row of ``docs``.

    ``path`` is an SQL expression. A file is a license file by its name, or if its
    whole text, of several lines, is the best match. ``line`` is the first of the best unit. The cosine of a text without a
    license is that of its best unit of those that could reach ``least``. Repeated rows stay; an empty table gives no rows;
    names of other columns don't matter.
    """
    files = docs.select(F.col(id_col).alias("doc_id"), F.expr(path).alias("path"), F.col(text_col).alias("text"))
    found = own_licenses(files, text_col="text", keep=("doc_id", "path"), least=least)
    # a file that is nothing but a license stands for a license file of its directory
    named = F.when(F.col("whole"), F.concat(F.regexp_replace("path", r"[^/]*$", ""), F.lit("LICENSE"))).otherwise(F.col("path"))
    out = inherit(found.withColumn("__named", named), path_col="__named")
    return out.select("doc_id", "path", "license", "cosine", "line", "whole", "effective", "inherited_from")


def op2(spark, sf_dir: str) -> DataFrame:
    """Documents have no paths: their source is the top directory and their language the one below."""
    path = "concat_ws('/', coalesce(source, ''), coalesce(lang, ''), concat(cast(doc_id as string), '.txt'))"
    found = license_scan(table(spark, sf_dir, "documents"), path=path)
    return found.withColumn("cosine", F.round("cosine", 6))
