"""The pipeline's stages on planted cases, and on tables with odd rows and columns."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm.common import shared_dir
from seqloom.llm.simhash import fingerprint

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("w" + "".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


@pytest.fixture(scope="module")
def world(tmp_path_factory, spark):
    """A folder with documents, labels and benchmark; the planted ids by kind."""
    rng, folder = random.Random(1), str(tmp_path_factory.mktemp("world"))
    docs, labels, kinds = [], [], {"toxic": set(), "copy": set(), "leak": set(), "clean": set(), "odd": set()}
    passage = words(rng, 30)
    for k in range(240):
        text = words(rng, 90).split()
        if k % 4 == 0:
            for _ in range(10):
                text[rng.randrange(90)] = rng.choice(["Vilest", "nastily", "horrid"])
            kinds["toxic"].add(k)
        else:
            kinds["clean"].add(k)
        docs.append((k, " ".join(text), "en", f"s{k % 3}", 0))
        if k < 160:
            labels.append((k, 1, int(k % 4 == 0)))
    for k in range(300, 310):
        docs.append((k, docs[k - 299][1] + (" " if k % 2 else ""), "en", "s0", 0))
        if (k - 299) % 4:
            kinds["copy"].add(k)
    for k in range(400, 406):
        docs.append((k, f"{words(rng, 60)} {passage} {words(rng, 60)}", "en", "s1", 0))
        kinds["leak"].add(k)
    docs += [(500, None, None, None, None), (501, "", "en", "s2", 0), (None, words(rng, 40), "en", "s2", 0), (502, passage, "en", "s2", 0)]
    frame = spark.createDataFrame(docs, DOCS).withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(9) for c in ("row", "size", "shard", "mix_shard", "fp", "none")})
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, kinds, passage


@pytest.fixture(scope="module")
def stages(world, spark, tmp_path_factory):
    """The rows after each stage, written and read again."""
    folder, out = world[0], str(tmp_path_factory.mktemp("out"))
    docs, after = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        assert made.columns == columns or name == "sharding"
        made.write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        after.append([r.asDict() for r in docs.collect()])
    return after


def ids(rows):
    return {r["doc_id"] for r in rows}


def test_toxic_documents_go_and_clean_ones_stay(world, stages):
    _, kinds, _ = world
    kept = ids(stages[0])
    assert len(kinds["toxic"] & kept) <= 0.05 * len(kinds["toxic"]) and len(kinds["clean"] - kept) <= 0.02 * len(kinds["clean"])
    assert kinds["leak"] | {500, 501, 502, None} <= kept


def test_one_of_each_group_stays(world, stages):
    _, kinds, _ = world
    before, after = stages[0], stages[1]
    assert not kinds["copy"] & ids(after) and kinds["clean"] & ids(before) <= ids(after)
    prints = [fingerprint((r["text"] or "").encode()) for r in after]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])


def test_passages_are_cut(world, stages):
    _, kinds, passage = world
    got = {r["doc_id"]: r for r in stages[2]}
    assert 502 not in got and ids(stages[1]) - {502} == ids(stages[2])
    for r in stages[1]:
        if r["doc_id"] in kinds["leak"]:
            text = got[r["doc_id"]]["text"]
            assert text == r["text"].replace(passage, "") and got[r["doc_id"]]["n_chars"] == len(text)
        elif r["doc_id"] != 502:
            assert got[r["doc_id"]] == r


def test_mix_and_shards(stages):
    assert ids(stages[3]) <= ids(stages[2]) and all(r["mix_shard"] == 9 for r in stages[3])
    assert sorted(map(repr, (r["doc_id"] for r in stages[4]))) == sorted(map(repr, (r["doc_id"] for r in stages[3])))
    for s in {r["shard"] for r in stages[4]}:
        slots = sorted(r["slot"] for r in stages[4] if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_run_is_the_stages_one_after_the_other(world, stages, spark):
    got = corpus_pipeline.run(spark, world[0])
    key = lambda rows: sorted(repr((r["doc_id"], r["text"], r["shard"], r["slot"])) for r in rows)
    assert key(r.asDict() for r in got.collect()) == key(stages[4])


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_text_that_a_second_removal_empties_goes(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "A a b c b c.", "en", "s", 12), (2, "x a b c", "en", "s", 7), (3, "...", "en", "s", 3), (4, None, "en", "s", None)], DOCS)
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.cut_benchmark(spark, docs, str(tmp_path)).collect()}
    assert kept == {2: ("x ", 2), 3: ("...", 3), 4: (None, None)}


def test_only_the_last_stage_read_is_left(world, spark):
    made = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/pipeline-*"))
    before = made()
    corpus_pipeline.run(spark, world[0])
    (folder,) = made() - before
    assert os.listdir(folder) == ["3"]
