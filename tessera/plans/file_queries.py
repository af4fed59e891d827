"""Queries that write test tables in the formats of the sinks and read them with the sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..sources import datasets, images
from .registry import PIXELS, pixels, query, table
from .table_queries import SPLIT, U, split

STORED = "CAST(trunc(greatest(0, least(255, v))) AS DOUBLE)"


def shared_path(spark, label: str) -> str:
    """A new path in the folder that driver and executors share; a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the cluster shares")
        root = tempfile.mkdtemp(prefix="tessera-files-")
    return f"{root.rstrip('/')}/tessera/{label}-{uuid.uuid4().hex}"


@query("metadata_scan", "SELECT doc_id::VARCHAR AS source_id, source AS group_id, (doc_id % 4)::INTEGER AS instance_count FROM documents")
def metadata_scan(spark, d):
    path, none = shared_path(spark, "metadata"), F.array().cast("array<bigint>")
    items = F.transform(F.when(F.col("doc_id") % 4 > 0, F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 4)).otherwise(none), lambda i: F.concat(F.lit("'"), i.cast("string"), F.lit("'")))
    rows = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("filename"), F.col("source").alias("doi"), F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")).alias("regions"))
    datasets.write_csv(rows, path)
    return datasets.read_metadata(spark, path)


@query("headerless_ids", "SELECT 'id ' || doc_id AS id FROM documents")
def headerless_ids(spark, d):
    path = shared_path(spark, "ids")
    table(spark, d, "documents").select(F.concat(F.lit("id "), F.col("doc_id").cast("string"))).write.csv(path)
    return datasets.read_ids(spark, path)


@query("split_file", f"WITH {SPLIT} SELECT source_id::VARCHAR AS source_id, group_id, split FROM sp")
def split_file(spark, d):
    path = shared_path(spark, "split")
    datasets.write_split(split(spark, d), path, 0, 0.15)
    return datasets.read_split(spark, path)


@query("sweep_file", "SELECT o_orderkey AS run, CAST(o_custkey % 6 AS BIGINT) AS topk, (o_orderkey % 100) / 8.0::DOUBLE AS diversity FROM orders")
def sweep_file(spark, d):
    path = shared_path(spark, "sweep")
    datasets.write_json(table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_custkey") % 6).alias("topk"), (F.col("o_orderkey") % 100 / 8.0).alias("diversity")), path)
    return spark.read.schema("run long, topk long, diversity double").json(path)


@query("manifest_file", "SELECT p_partkey::VARCHAR AS source_id, 'EMPS' AS dataset, p_brand AS group_id, 'unassigned' AS split, 'electron microscopy' AS modality_claim, CAST(p_size AS INTEGER) AS instance_count FROM part")
def manifest_file(spark, d):
    path = shared_path(spark, "manifest")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_brand").alias("group_id"), F.col("p_size").alias("instance_count"))
    datasets.write_csv(datasets.as_manifest(rows, "EMPS"), path)
    return spark.read.schema(datasets.MANIFEST).csv(path, header=True).select("source_id", "dataset", "group_id", "split", "modality_claim", "instance_count")


_SETS = "f AS (SELECT p_partkey, 'set' || p_partkey % 7 AS s, CASE p_partkey % 2 WHEN 0 THEN '000' ELSE '010' END AS noise FROM part)"


@query("intensity_manifest", f"WITH {_SETS} SELECT '/sets/' || p_partkey || '/' || s || '/a_cex_noise_' || noise || '_contrast_100.tiff' AS image_path, s AS source_id, s AS group_id, CASE s WHEN 'set6' THEN 'test' ELSE 'train' END AS split, 'NIST' AS dataset FROM f WHERE noise = '000' AND s IN ('set1', 'set2', 'set3', 'set5', 'set6')")
def intensity_manifest(spark, d):
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    path = F.concat(F.lit("/sets/"), text(k), F.lit("/set"), text(k % 7), F.lit("/a_cex_noise_"), F.when(k % 2 == 0, "000").otherwise("010"), F.lit("_contrast_100.tiff"))
    return datasets.intensity_rows(table(spark, d, "part").select(path.alias("path"))).select("image_path", "source_id", "group_id", "split", "dataset")


@query("field_manifest", "SELECT 'a' || p_partkey AS source_id, 'field' || p_partkey % 10 AS group_id, 'test' AS split, 'SEM' AS modality_claim, '/fields/A' || p_partkey || '.TIF' AS image_path FROM part WHERE p_partkey % 3 = 0")
def field_manifest(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    files = p.select(F.concat(F.lit("/fields/A"), k.cast("string"), F.lit(".TIF")).alias("path"))
    fields = p.filter(k % 3 == 0).select(F.concat(F.lit("A"), k.cast("string")).alias("source_id"), F.concat(F.lit("field"), (k % 10).cast("string")).alias("field_id"))
    return datasets.field_rows(files, fields).select("source_id", "group_id", "split", "modality_claim", "image_path")


@query("field_lookup", "SELECT p_partkey AS source_id, 'field' || p_partkey % 10 AS field_id FROM part")
def field_lookup(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("source_id"))
    return datasets.field_of(p, p.withColumn("field_id", F.concat(F.lit("field"), (F.col("source_id") % 10).cast("string"))))


@query("sampled_files", f"SELECT p_partkey AS source_id FROM part ORDER BY {U.format("'3:' || p_partkey")}, p_partkey LIMIT 25")
def sampled_files(spark, d):
    return images.sample_files(table(spark, d, "part").select(F.col("p_partkey").alias("source_id")), 25, 3)


def _written(spark, d):
    folder = shared_path(spark, "images")
    images.write_png(pixels(spark, d), folder.removeprefix("file:")).agg(F.count("*")).collect()
    return images.scan(spark, folder)


@query("image_files", f"WITH {PIXELS} SELECT source_id, r, c, {STORED} AS v FROM px")
def image_files(spark, d):
    return images.read_pixels(_written(spark, d)).withColumn("source_id", F.col("source_id").cast("long"))


@query("guarded_load", f"WITH {PIXELS} SELECT source_id, count(*) AS n, round(avg({STORED}), 6) AS mean_v FROM px WHERE source_id % 5 > 0 GROUP BY 1")
def guarded_load(spark, d):
    """Images whose ids and groups aren't hidden; hidden are those of every fifth id."""
    files = _written(spark, d)
    ids = files.select(F.col("source_id").alias("id"))
    rest = F.col("id").try_cast("long") % 5
    group_of = ids.select(F.col("id"), F.concat(F.lit("g"), rest.cast("string")).alias("group_id"))
    hidden = spark.createDataFrame([("g0",)], "id string")
    px = datasets.load_sources(files.filter(F.col("source_id").try_cast("long") % 5 > 0), ids, ids.filter(rest == 0), hidden, group_of)
    return px.groupBy(F.col("source_id").cast("long").alias("source_id")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean_v"))


@query("instance_counts", f"WITH {PIXELS} SELECT source_id, CAST(count(DISTINCT nullif(floor(greatest(v, 0) / 32), 0)) AS INTEGER) AS instance_count FROM px GROUP BY 1")
def instance_counts(spark, d):
    return datasets.instance_counts(pixels(spark, d).withColumn("v", F.floor(F.greatest("v", F.lit(0.0)) / 32)))
