"""The pipeline's stages against plain versions of the same decisions."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfx.llm import simhash
from panelfx.llm.common import save


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = save(stage(spark, before, data), f"test-{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        if name == "language_id":
            gone = {r["doc_id"] for r in before.select("doc_id").collect()} - {r["doc_id"] for r in out.select("doc_id").collect()}
            assert len(gone) <= 0.02 * before.count()
        if name == "simhash_dedup":
            rows = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in before.select("doc_id", "text").collect()]
            fps = np.array([f for _, f in rows], dtype=np.uint64)
            kept = {r["doc_id"] for r in out.select("doc_id").collect()}
            seen = np.array([i in kept for i, _ in rows])
            apart = np.array([[bin(int(a) ^ int(b)).count("1") for b in fps[seen]] for a in fps[seen]])
            assert (apart + 64 * np.eye(len(apart), dtype=int) > 3).all()  # no two kept are linked
        if name == "secret_scan":
            assert out.count() == before.count()
            assert not out.where(r"text rlike 'password=[0-9a-f]{18}|AKIA[A-Z2-7]{16}'").count()
        before = out
    total = before.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert sum(r[1] != 2048 for r in total) <= 1


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "the house and the dog", "en", "a", 21)]])
def test_odd_tables(spark, tmp_path, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) <= 2


def test_clashing_names(spark, data):
    """Columns called as those that the stages make for themselves come through untouched."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    clash = ["rep", "rep_fp", "_sim_id", "fp", "_fp", "_row", "row", "kept", "secret_text", "secret_found", "_tokens", "_votes", "_c0", "score", "lang_pred", "taken", "copies", "rate", "target", "size", "sequence_id", "start", "ids", "offset"]
    wide = docs.select("*", *[F.concat(F.lit(f"{c} of "), "doc_id").alias(c) for c in clash])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = save(stage(spark, wide, data), f"clash-{name}")
        assert out.columns == wide.columns and out.count() > 0, name
        for c in clash:
            assert not out.where(F.col(f"`{c}`") != F.concat(F.lit(f"{c} of "), "doc_id")).count(), (name, c)
        wide = out
    assert corpus_pipeline.STAGES[-1][1](spark, wide, data).count() > 0


def test_one_of_each_group_stays(spark):
    """Null and repeated ids, texts that share id and fingerprint, and which of them stays in any order of rows."""
    near = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, near), (7, near), (7, near), (3, "x"), (3, "x "), (3, " x"), (None, "alone"), (None, None), (None, ""), (5, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, simhash.keep_one(docs).collect()), key=repr)
    assert got == sorted(map(tuple, simhash.keep_one(docs.orderBy(F.desc("text")).repartition(3)).collect()), key=repr)
    assert [i for i, _ in got].count(7) == 1 and [i for i, _ in got].count(3) == 1 and (None, "alone") in got and (5, "  ") in got and len(got) == 4
