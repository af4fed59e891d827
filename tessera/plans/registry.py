"""The registry of queries and the tables they work on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bank(spark: SparkSession, d: str) -> DataFrame:
    """The patch bank: every embedding is an 8x8 patch, its label a source group."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("px"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Images of 16x16 pixels: four consecutive patches each, as pixels around 128."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "e"))
    return e.select(
        F.floor(F.col("vec_id") / 4).alias("source_id"),
        (F.floor(F.col("vec_id") % 4 / 2) * 8 + F.floor(F.col("pos") / 8)).cast("int").alias("r"),
        (F.col("vec_id") % 2 * 8 + F.col("pos") % 8).cast("int").alias("c"),
        (F.col("e") * 256 + 128).alias("v"),
    )


def perturbed(spark: SparkSession, d: str) -> DataFrame:
    """A synthetic patch for every bank patch: the patch, shaken by a fixed pattern."""
    return bank(spark, d).select("id", "label", F.transform("px", lambda x, i: x + F.lit(0.001) * ((F.col("id") * 7 + i * 13) % 11 - 5)).alias("px"))


BANK = "bank AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS px FROM embeddings)"
CELLS = f"{BANK}, cells AS (SELECT id, label, unnest(px) AS x, generate_subscripts(px, 1) - 1 AS pos FROM bank)"
PIXELS = """px AS (SELECT vec_id // 4 AS source_id, CAST((vec_id % 4) // 2 * 8 + pos // 8 AS INTEGER) AS r,
    CAST(vec_id % 2 * 8 + pos % 8 AS INTEGER) AS c, e * 256 + 128 AS v
    FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)),
  shp AS (SELECT source_id, max(r) + 1 AS h, max(c) + 1 AS w FROM px GROUP BY 1)"""
SHAKEN = f"""{BANK}, syn AS (SELECT id, label, list_transform(px, lambda x, i: x + 0.001::DOUBLE * ((id * 7 + (i - 1) * 13) % 11 - 5)) AS px FROM bank)"""
