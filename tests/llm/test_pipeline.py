"""The pipeline's stages on the small corpus, each against its definition."""

import pytest
from pyspark.sql import functions as F
from test_contracts import brute_components

import corpus_pipeline
from tessera.llm.common import cut


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf), name)
        out.append((name, before, docs))
    return out


def test_stages_keep_the_columns_and_only_drop_rows(steps):
    for name, before, after in steps[:-1]:
        assert after.columns == before.columns
        assert after.select("doc_id").distinct().join(before, "doc_id", "left_anti").isEmpty()
        assert name == "mixing" or after.count() == after.select("doc_id").distinct().count()


def test_near_copies_leave_one_of_each_group(steps):
    _, before, after = steps[1]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    want = {k for k, _, c in brute_components(rows, 5, 80) if k == c}
    assert {r[0] for r in after.select("doc_id").collect()} == want


def test_mix_and_shards(steps):
    _, before, mixed = steps[3]
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    _, _, last = steps[4]
    assert last.count() == mixed.count()
    for r in last.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.count_distinct("slot").alias("k")).collect():
        assert r["n"] == r["k"] == r["m"] + 1
