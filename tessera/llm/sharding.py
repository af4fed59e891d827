"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly, by seeded hashes, into buckets of
bounded memory. Pass two takes one bucket at a time, permutes it by a
Fisher-Yates shuffle and writes it. A record's shard depends on its key and the
number of shards alone (highest random weight), so that one more shard takes
records only into itself; within a shard the buckets stand in a row, which makes
the slots gapless.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, give_back, row_hash


def shard_of(key: Column, n_shards: int, seed: int) -> Column:
    """The shard whose seeded hash with ``key`` is the largest (ties: the later shard)."""
    weights = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("w"), s.alias("s")))
    return F.array_max(weights)["s"]


def shard(df: DataFrame, n_shards: int = 16, *, key: str = "doc_id", text: str = "text", seed: int = 20, bucket_bytes: int = 24 << 20) -> DataFrame:
    """All rows of ``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Every row stays, repeated rows included. Null keys share one shard, spread
    over its buckets by what else their rows hold; null and empty texts count
    as rows of no bytes. An empty table gives an empty result. Input columns
    called ``shard`` or ``slot`` are replaced. Rows that are equal in every
    column may change places among themselves; many of them are counted and
    dealt to several buckets (not where a column is a map or a variant, which
    have no equality). Apart from that reruns agree, whatever the partitioning
    of the input. ``bucket_bytes`` bounds the text of a bucket on average; the
    number of buckets follows the bytes of each shard.
    """
    if n_shards < 1 or bucket_bytes < 1:
        raise ValueError("n_shards and bucket_bytes must be positive")
    rows = fresh(df, "shard", "slot", "__bucket", "__tie", "__pos", "__bytes", "__salt")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(64)).cast("long")
    tied = rows.withColumns({"shard": shard_of(F.col(key), n_shards, seed), "__tie": F.struct(row_hash(rows, seed).alias("a"), row_hash(rows, seed + 2).alias("b"))})
    ties = cut(tied.groupBy("shard", "__tie").agg(F.sum(size).alias("__bytes"), F.count("*").alias("__rows")), "ties")
    by_shard = dict(ties.groupBy("shard").agg(F.sum("__bytes")).collect())
    buckets = F.array(*[F.lit(max(1, math.ceil(by_shard.get(i, 0) / bucket_bytes))) for i in range(n_shards)])
    hot = ties.filter((F.col("__bytes") > bucket_bytes // 4) & (F.col("__rows") > 1)).select("__tie", "__bytes", "__rows")
    scattered = tied.withColumn("__salt", F.lit(0).cast("long"))
    if not any(t in f.dataType.simpleString() for f in rows.schema.fields for t in ("map<", "variant")) and not hot.isEmpty():
        # Many equal rows: one of them and its number, dealt again in parts of a quarter of a bucket.
        one = tied.join(hot, "__tie").groupBy("__tie", "__bytes", "__rows").agg(F.first(F.struct(*rows.columns, "shard")).alias("r"))
        parts = F.least(F.col("__rows"), F.ceil(F.col("__bytes") * 4 / F.lit(bucket_bytes)))
        one = one.withColumn("parts", parts).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        share = F.floor((F.col("__salt") + 1) * F.col("__rows") / F.col("parts")) - F.floor(F.col("__salt") * F.col("__rows") / F.col("parts"))
        again = one.withColumn("copy", F.explode(F.array_repeat(F.lit(0), share.cast("int")))).select("r.*", "__tie", "__salt")
        scattered = tied.join(hot, "__tie", "left_anti").withColumn("__salt", F.lit(0).cast("long")).unionByName(again)
    scattered = scattered.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "__tie", "__salt"), F.element_at(buckets, F.col("shard") + 1)).cast("int"))
    scattered = scattered.withColumn("__tie", F.col("__tie.a")).drop("__salt")

    def fisher_yates(where: tuple, bucket: pa.Table) -> pa.Table:
        at = [int(x.as_py()) for x in where]
        bucket = bucket.take(pc.sort_indices(bucket, [(key, "ascending"), ("__tie", "ascending")]))
        order = np.random.Generator(np.random.PCG64([seed, *at])).permutation(bucket.num_rows)
        give_back()
        return bucket.take(pa.array(order)).append_column("__pos", pa.array(np.arange(bucket.num_rows, dtype=np.int64)))

    out = T.StructType([*scattered.schema.fields, T.StructField("__pos", T.LongType())])
    written = cut(scattered.groupBy("shard", "__bucket").applyInArrow(fisher_yates, out), "shards")
    ahead = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written.groupBy("shard", "__bucket").count()
    offsets = cut(sizes.select("shard", "__bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__ahead")), "offsets")
    placed = written.join(offsets, ["shard", "__bucket"]).withColumn("slot", F.col("__ahead") + F.col("__pos"))
    return placed.select(*rows.columns, "shard", "slot")


def sharding_digest(df: DataFrame, n_shards: int = 16) -> DataFrame:
    """The law that holds for :func:`shard` is ``key``; the crc32 of a null text is that of no bytes, 0."""
    seed = 20
    placed = shard(df, n_shards, seed=seed)
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        shard_of(F.col("doc_id"), n_shards + 1, seed).cast("int").alias("grown_shard"),
    )
