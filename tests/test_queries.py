"""Each query against its SQL twin in DuckDB, and tables and streams from end to end."""

import glob
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from seqloom.functions.alphabet import DNA2
from seqloom.functions.parse import alphabet_of
from seqloom.plans.queries import ORACLES, QUERIES
from seqloom.sources import tables
from seqloom.streaming import sequences

SF = "/root/testdata/sf0.001"
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "array<boolean>": "BOOLEAN[]", "array<struct<start:int,stop:int>>": "STRUCT(\"start\" INTEGER, stop INTEGER)[]"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A null, an empty and a very long text, none with a symbol, long runs, line ends, and repeated rows."""
    out = str(tmp_path_factory.mktemp("odd"))
    rng = random.Random(3)
    texts = [None, "", "0123 !", "ACGT", "gattaca GANTAC-acgtn ATAATATA", "A" * 400 + "C" + "ACG" * 900 + "T", "".join(rng.choices("ACGTNRY -", k=5000)), "MKV*\nacgu  \u00e9 X", "T" * 19, "ACCGT" * 4, "ACCGT" * 4]
    rows = [(min(k, 9), t, "en", "s") for k, t in enumerate(texts)]
    spark.createDataFrame(rows[:-1], "doc_id long, text string, lang string, source string").write.parquet(f"{out}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{out}/documents.parquet/*.parquet'")
    return out, con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin_on_odd_texts(spark, odd, name):
    compare(QUERIES[name](spark, odd[0]), odd[1], name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    compare(QUERIES[name](spark, SF), duck, name)


def compare(df, duck, name):
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert rows
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        order = [names.index(c) for c in sorted(df.columns)]
        assert sorted(names) == sorted(df.columns)
        assert rows == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
        types = {r[0]: r[1] for r in duck.execute("DESCRIBE " + ORACLES[name]).fetchall()}
        assert {c: TYPES[t] for c, t in df.dtypes} == types


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tables_keep_alphabets(spark, tmp_path):
    df = spark.createDataFrame([(1, "acgt"), (2, None)], "id int, s string")
    df.write.parquet(str(tmp_path / "in"))
    read = tables.read_sequences(spark, str(tmp_path / "in"), {"s": "DNA2"})
    tables.write_sequences(read, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert alphabet_of(back, "s") == DNA2 and {r["s"] for r in back.collect()} == {"ACGT", None}
    spark.createDataFrame([(1, "ACGN")], "id int, s string").write.parquet(str(tmp_path / "bad"))
    assert tables.read_sequences(spark, str(tmp_path / "bad"), {"s": "DNA2"}, strict=False).first()["s"] is None
    with pytest.raises(Exception, match="EncodeError"):
        tables.read_sequences(spark, str(tmp_path / "bad"), {"s": "DNA2"}).collect()


def test_projection_reaches_the_scan(spark):
    plan = QUERIES["gc_content"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_streams(spark, tmp_path):
    rows = [(k, "ACGT"[k % 4] * 3 + "N", f"2024-01-01 00:{k:02d}:00") for k in range(8)]
    df = spark.createDataFrame(rows, "id int, s string, at string").withColumn("at", F.to_timestamp("at"))
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = sequences.read_stream(spark, str(tmp_path / "in"), df.schema)

    def run(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name).collect()

    assert {(r["id"], r["revcomp"]) for r in run(sequences.annotated(stream, "s"), "annotated", "append")} == {(k, "N" + "TGCA"[k % 4] * 3) for k in range(8)}
    assert {r["pos"]: (r["A"], r["C"], r["G"], r["T"]) for r in run(sequences.running_pfm(stream, "s"), "pfm", "complete")} == {1: (2,) * 4, 2: (2,) * 4, 3: (2,) * 4, 4: (0,) * 4}
    assert sum(r["n"] for r in run(sequences.windowed_gc(stream, "s", "at", "5 minutes", "10 minutes"), "gc", "complete")) == 8
