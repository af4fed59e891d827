"""The three datasets as manifest rows, the split's files, and result writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import grids
from . import images

MANIFEST = T.StructType([
    T.StructField("source_id", T.StringType()), T.StructField("dataset", T.StringType()), T.StructField("group_id", T.StringType()), T.StructField("split", T.StringType()),
    T.StructField("image_path", T.StringType()), T.StructField("label_path", T.StringType()), T.StructField("modality_claim", T.StringType()),
    T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("instance_count", T.IntegerType()), T.StructField("furniture_fraction", T.DoubleType()),
])

# Fixed values of the intensity sets: usable ones, the invalid one and the hidden one.
USABLE_SETS, INVALID_SETS, HIDDEN_SETS = ("set1", "set2", "set3", "set5"), ("set4",), ("set6",)
CLEAN_NAME = "{set}_cex_noise_000_contrast_100.tiff"


def literal_size(text: Column) -> Column:
    """Number of elements of a list literal with quotes of either kind; 0 for an empty or null one."""
    items = F.from_json(F.regexp_replace(text, "'", '"'), "array<string>")
    return F.coalesce(F.size(items), F.lit(0)).cast("int")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, group_id, instance_count) from a CSV of filename, doi and regions; the DOI is the group."""
    raw = spark.read.schema("filename string, doi string, regions string").csv(path, header=True, escape='"')
    return raw.select(F.regexp_replace("filename", r"\.png$", "").alias("source_id"), F.col("doi").alias("group_id"), literal_size(F.col("regions")).alias("instance_count"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One column of ids without a header."""
    return spark.read.schema("id string").csv(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, group_id, split) from a split's JSON of id lists and a map from id to group."""
    lists = {"train": "train_ids", "validation": "validation_ids", "test": "test_ids"}
    schema = ", ".join(f"{v} array<string>" for v in lists.values()) + ", group_of map<string,string>, seed int, val_fraction double"
    j = spark.read.schema(schema).json(path, multiLine=True)
    parts = [j.select(F.explode(v).alias("source_id"), F.lit(k).alias("split")) for k, v in lists.items()]
    ids = parts[0].unionByName(parts[1]).unionByName(parts[2])
    groups = j.select(F.explode("group_of").alias("source_id", "group_id"))
    return ids.join(groups, "source_id", "left").select("source_id", "group_id", "split")


def write_split(split: DataFrame, path: str, seed: int, val_fraction: float) -> None:
    """The split as one JSON object, ids sorted."""
    ids = lambda k: F.array_sort(F.collect_list(F.when(F.col("split") == k, F.col("source_id").cast("string"))))
    one = split.agg(*[ids(k).alias(f"{k}_ids") for k in ("train", "validation", "test")], F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("source_id").cast("string"), "group_id")))).alias("group_of"))
    one.select(F.lit(seed).alias("seed"), F.lit(val_fraction).alias("val_fraction"), "*").write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A nested JSON document as one row; its schema is the document's."""
    return spark.read.json(path, multiLine=True)


def measured(px: DataFrame, **limits: float) -> DataFrame:
    """(source_id, height, width, furniture_fraction) of images."""
    m = grids.exclusion_mask(px, 2, **limits)
    return m.groupBy("source_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"), F.avg(F.col("excluded").cast("int")).alias("furniture_fraction"))


def as_manifest(rows: DataFrame, dataset: str, claim: str = "electron microscopy") -> DataFrame:
    """``rows`` with all manifest columns; what they lack is null or 0."""
    have = set(rows.columns)
    fixed = {"dataset": F.lit(dataset), "modality_claim": F.lit(claim), "height": F.lit(0), "width": F.lit(0), "instance_count": F.lit(0), "furniture_fraction": F.lit(0.0), "split": F.lit("unassigned")}
    return rows.select(*[(F.col(f.name) if f.name in have else fixed.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in MANIFEST.fields])


def intensity_rows(files: DataFrame) -> DataFrame:
    """Manifest rows of the clean reference images among ``files`` (path); a set is a group, hidden sets are test."""
    s = files.withColumn("source_id", F.regexp_extract("path", r"/(set[0-9]+)/[^/]*_cex_noise_000_contrast_100\.tiff?$", 1)).filter(F.col("source_id").isin(*USABLE_SETS, *HIDDEN_SETS))
    split = F.when(F.col("source_id").isin(*HIDDEN_SETS), "test").otherwise("train")
    return as_manifest(s.select("source_id", F.col("source_id").alias("group_id"), split.alias("split"), F.col("path").alias("image_path")), "NIST")


def check_set(name: str, hidden: bool = False) -> str:
    if name in INVALID_SETS or name not in (*USABLE_SETS, *HIDDEN_SETS):
        raise ValueError(f"{name} can't be used")
    if name in HIDDEN_SETS and not hidden:
        from ..operators.lineage import LeakageError

        raise LeakageError(f"{name} is hidden test data")
    return name


def variants(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All intensity variants of a usable set."""
    return images.scan(spark, f"{root}/intensity_sets/{check_set(name)}").orderBy("path")


def field_rows(files: DataFrame, fields: DataFrame) -> DataFrame:
    """Manifest rows of ``files`` (path) on the allow-list ``fields`` (source_id, field_id); the field is the group, all are test, and the claim is SEM.

    Files that the list doesn't name, quarantined folders among them, are left out.
    """
    named = files.withColumn("source_id", images.stem(F.col("path")))
    kept = named.join(fields.select(F.lower("source_id").alias("source_id"), F.col("field_id").alias("group_id")), "source_id")
    return as_manifest(kept.select("source_id", "group_id", F.lit("test").alias("split"), F.col("path").alias("image_path")), "RODARE", "SEM")


def field_of(ids: DataFrame, fields: DataFrame) -> DataFrame:
    """(source_id, field_id); an id that isn't on the list raises when the row is computed."""
    j = ids.join(fields, "source_id", "left")
    return j.withColumn("field_id", F.when(F.col("field_id").isNotNull(), F.col("field_id")).otherwise(F.raise_error(F.concat(F.lit("unknown source "), F.col("source_id").cast("string")))))


def instance_counts(labels: DataFrame, connected: bool = False) -> DataFrame:
    """(source_id, instance_count): distinct labels but 0, or with ``connected`` areas of four neighbours."""
    if connected:
        parts = grids.connected_components(labels.withColumn("on", F.col("v") != 0))
        return parts.groupBy("source_id").agg(F.max("component").alias("instance_count"))
    return labels.groupBy("source_id").agg(F.count_distinct(F.when(F.col("v") != 0, F.col("v"))).cast("int").alias("instance_count"))


def guarded(files: DataFrame, known: DataFrame, hidden_ids: DataFrame, hidden_groups: DataFrame, group_of: DataFrame) -> DataFrame:
    """``files`` of :func:`.images.scan`, once none of them is hidden and all are among ``known`` (id); nothing is decoded before."""
    from ..operators import lineage

    ids = files.select(F.col("source_id").alias("id"))
    lineage.check(ids, hidden_ids, hidden_groups, group_of)
    unknown = [r[0] for r in ids.distinct().join(known.select("id"), "id", "left_anti").orderBy("id").limit(20).collect()]
    if unknown:
        raise ValueError("unknown sources: " + ", ".join(map(str, unknown)))
    return files


def load_sources(files: DataFrame, known: DataFrame, hidden_ids: DataFrame, hidden_groups: DataFrame, group_of: DataFrame) -> DataFrame:
    """(source_id, r, c, v) of images that a generator may see."""
    return images.read_pixels(guarded(files, known, hidden_ids, hidden_groups, group_of))


def load_segmaps(files: DataFrame, known: DataFrame, hidden_ids: DataFrame, hidden_groups: DataFrame, group_of: DataFrame) -> DataFrame:
    """(source_id, r, c, v) of label images that a generator may see, their 16-bit numbers as stored."""
    return images.read_pixels(guarded(files, known, hidden_ids, hidden_groups, group_of), "labels")


def with_measures(rows: DataFrame, px: DataFrame | None = None, labels: DataFrame | None = None, connected: bool = False) -> DataFrame:
    """Manifest rows with height, width and furniture fraction of the images ``px`` and the number of instances of ``labels``.

    Both have the manifest's source_id. Rows without an image or labels keep
    their values; ``connected`` counts areas of four neighbours, as fields
    need, else distinct labels.
    """
    found = [t for t in (measured(px) if px is not None else None, instance_counts(labels, connected) if labels is not None else None) if t is not None]
    for t in found:
        new = [c for c in t.columns if c != "source_id"]
        kept = rows.join(t.select(F.col("source_id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in new]), F.col("source_id") == F.col("__id"), "left")
        rows = kept.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).cast(rows.schema[c].dataType).alias(c) if c in new else F.col(c) for c in rows.columns])
    return rows


def build_manifest(spark: SparkSession, metadata: DataFrame, image_files: DataFrame, split: DataFrame, others: list[DataFrame]) -> DataFrame:
    """The checked union of all datasets: metadata rows with measured images, and the other datasets' rows.

    Claims of the first dataset mustn't name SEM, and no group may be in two
    splits; both are checked before anything is returned.
    """
    from ..operators import lineage

    px = measured(images.read_pixels(image_files))
    files = image_files.select("source_id", F.col("path").alias("image_path"))
    rows = lineage.with_split(metadata.join(files, "source_id").join(px, "source_id"), split)
    first = as_manifest(rows, "EMPS")
    lineage.check_claims(first, "modality_claim")
    return lineage.manifest(first, *others)
