"""Corpus pipeline: five stages from raw documents to shards of a training mix.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; between stages the documents are written and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from tessera.llm.common import cut, cut_parts, discard, row_hash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is under 0.5; the model learns from the labelled ones among them."""
    model = toxicity.train_on_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, name="__toxicity").filter(F.col("__toxicity") < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that hang together by a Jaccard similarity of 0.8 on five-word shingles, one: that of the smallest id.

    Of rows with that id, and of rows without an id that are like no row with
    one, the smallest 64-bit hash of the whole row decides; of equal rows one
    stays. Rows without words are like nothing else and all stay.
    """
    mark = row_hash(docs, 11)
    row = F.struct(F.col("doc_id").isNull().cast("int").alias("none"), F.col("doc_id").alias("id"), mark.alias("hash"))
    classes = ngram_join.jaccard_components(docs.select(row.alias("row"), "text"), n=5, num=80, den=100, key="row")
    kept = classes.filter(F.col("row") == F.col("component_id")).groupBy("row").agg(F.when((F.count("*") > 1) & (F.max("n_shingles") > 0), "equal").otherwise("single").alias("__rows"))
    kept = cut_parts(kept.select(F.col("row.hash").alias("__kept"), "__rows"), "__rows", ("single", "equal"), "kept")
    of = lambda k: docs.withColumn("__hash", mark).join(kept[k], F.col("__hash") == F.col("__kept"), "left_semi")
    return of("single").unionByName(of("equal").dropDuplicates(["doc_id", "__hash"])).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = decontaminate.decontaminate(docs.withColumnRenamed("matches", "__matches"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("matches") == 0).drop("matches").withColumnRenamed("__matches", "matches")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's copies of each document: none, one or up to three equal rows, in files that hold the mix's shards in their shuffled order."""
    drawn = mixing.draw(mixing.mix(docs.withColumn("__row", F.struct(*docs.columns))))
    part = F.pmod(F.col("mix_order"), F.lit(64))
    return drawn.repartition("mix_shard", part).sortWithinPartitions("mix_shard", "mix_order").select("__row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it."""
    return sharding.shard(docs, 16)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: No SQL expresses the learned stages; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
