"""The pipeline: its stages against plain versions, whole runs, and odd cases."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as pipeline

from . import brute
from .test_operators import DOCS, corpus, frame, rows, words

STAGES = dict(pipeline.STAGES)


@pytest.fixture
def folder(spark, tmp_path):
    docs = [*corpus(8, 80), *[(200 + i, f"you idiot {words(random.Random(i), 30)}") for i in range(40)]]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 200)) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, words(random.Random(8), 70)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs, str(tmp_path)


def test_stages_take_and_give_documents(spark, folder):
    given, path = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        assert out.dtypes == docs.dtypes
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        after = [tuple(r) for r in out.select("doc_id", "text").collect()]
        if name == "toxicity":
            assert {i for i, _ in before} - {i for i, _ in after} == {i for i, t in before if t and "idiot" in t}
        elif name == "near_duplicates":
            assert sorted(i for i, _ in after) == sorted(r[0] for r in brute.near(before) if r[3])
        elif name == "suffix_dedup":
            want = {r[0]: r for r in brute.repeats(before, 50)}
            assert {i for i, _ in before} - {i for i, _ in after} == {i for i, r in want.items() if r[2] and r[2] == r[1]}
            assert all(len(brute.spaced(t)) == want[i][1] - want[i][2] for i, t in after)
            assert all(t == dict(before)[i] for i, t in after if not want[i][2])
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
            assert sorted(i for i, _ in after) == sorted(r[0] for r in brute.contamination(before, items) if not r[5])
        docs = spark.createDataFrame(out.collect(), docs.schema)
    pieces = STAGES["packing"](spark, docs, path)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    whole = pipeline.run(spark, path)
    # Where documents are cut depends on their order.
    assert {tuple(r) for r in whole.select("doc_id", "doc_tokens").collect()} == {tuple(r) for r in pieces.select("doc_id", "doc_tokens").collect()}


def test_odd_tables(spark, folder):
    _, path = folder
    text = words(random.Random(1), 60)
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", None, None, None), (None, None, "x", "s", 1), (2, text, "x", "s", 1), (2, text, "x", "s", 1)], DOCS)
    odd = odd.withColumn("removal", F.lit("clash")).withColumn("_doc_id", F.lit(1)).withColumn("toxic", F.lit(2))
    for docs in (odd, odd.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, path)
            assert out.count() >= (0 if docs is not odd else 1)
            if name != "packing":
                assert out.columns == docs.columns
                assert out.filter("removal <> 'clash'").count() == 0


def test_tables_of_stages_are_removed(spark, folder, tmp_path):
    import os

    from batchlog.llm.shared import cleared, written

    _, path = folder
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    out = pipeline.run(spark, path)
    assert {n.split("-")[1] for n in set(os.listdir(shared)) - before} == {name.split("-")[0] for name, _ in pipeline.STAGES}
    assert out.count() > 0
    with cleared(spark):
        assert written(spark.range(3), "x").count() == 3
    assert len(set(os.listdir(shared)) - before) == len(pipeline.STAGES)


def test_registered():
    assert __spark_entry__.queries()["pipeline"] is pipeline.run
    assert "pipeline" not in __spark_entry__.oracle_sql()
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in __spark_entry__.queries() if q.startswith("op") and q[2].isdigit()}
