import os
import sys

import pytest
from pyspark.sql import functions as F

from .corpus import documents, empty
from .test_duplicates import classes, removed
from .test_text import labelled

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def mixed(spark):
    """Documents of two languages with toxic ones, copies, near copies, a shared passage, nulls, blanks, repeated rows and clashing columns."""
    base = labelled(spark, 200)
    texts = {r["doc_id"]: r["text"] for r in base.where("doc_id < 40").collect()}
    passage = " ".join(f"{a}{b}" for a in "bab cab dab fab gab".split() for b in "bab cab dab fab gab".split()) * 3
    odd = {1000: None, 1001: "", 1002: "12 !!", 1003: texts[1], 1004: texts[1] + " babcab", 1005: texts[3] + " " + passage, 1006: texts[7] + " " + passage, 1007: "bab " * 4000}
    return base.unionByName(documents(spark, odd).withColumn("lang", F.lit(None).cast("string"))).unionByName(base.where("doc_id in (11, 13)"))


def labels_of(docs):
    return docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("toxic")).where("doc_id < 200").distinct()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = mixed(spark)
    docs.write.parquet(f"{path}/documents.parquet")
    labels_of(docs).write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage_against_its_brute_force(spark, folder):
    import corpus_pipeline as p

    names = [n for n, _ in p.STAGES]
    assert names == ["language_id", "toxicity", "near_duplicates", "repeated_passages", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = p.materialise(p.language_id(spark, docs, folder), "a")
    assert known.columns == docs.columns
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in known.collect()}
    assert gone == {1000, 1001, 1002}  # those without a letter
    civil = p.materialise(p.toxicity(spark, known, folder), "b")
    kept = {r["doc_id"] for r in civil.collect()}
    assert civil.columns == docs.columns and sum(i % 5 == 0 for i in kept if i < 200) <= 4 and sum(i % 5 > 0 for i in kept if i < 200) >= 155
    one = p.materialise(p.near_duplicates(spark, civil, folder), "c")
    rows = {r["doc_id"]: r["text"] for r in civil.collect()}
    left = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert one.columns == docs.columns and sorted(i for i, _ in left) == sorted({c for _, c in classes(rows).values()})
    whole = p.materialise(p.repeated_passages(spark, one, folder), "d")
    want = {i: (n, r) for i, n, r, _, _ in removed(left)}
    assert whole.columns == docs.columns and {r["doc_id"]: len(r["text"].encode()) for r in whole.collect()} == {i: n - r for i, (n, r) in want.items()}
    assert any(r for _, r in want.values())
    packed = p.packing(spark, whole, folder).toPandas()
    assert set(packed["doc_id"]) == set(want) and (packed.groupby("sequence_id")["length"].sum() <= 2048).all()
    assert (packed.groupby("doc_id")["length"].sum() == packed.groupby("doc_id")["doc_tokens"].first()).all()


def test_the_run_is_its_stages(spark, folder):
    import corpus_pipeline as p

    got = sorted(tuple(r) for r in p.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        docs = p.materialise(stage(spark, docs, folder), name)
    assert got == sorted(tuple(r) for r in p.STAGES[-1][1](spark, docs, folder).select("doc_id", "start", "length", "ids_crc32").collect())


def test_empty_documents(spark, tmp_path):
    import corpus_pipeline as p

    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(mixed(spark)).limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_clean_documents_of_the_smallest_tables_stay(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    civil = p.toxicity(spark, p.materialise(p.language_id(spark, docs, sf), "x"), sf)
    assert civil.count() >= 0.9 * docs.count()
