"""Copying: near-duplicate patches by hash, confirmed by correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr


def hashes(patches: DataFrame) -> DataFrame:
    """(id, px, h) with the average hash of 8x8 patches."""
    return patches.withColumn("h", expr.average_hash(F.col("px")))


def candidates(synthetic: DataFrame, reference: DataFrame, max_hamming: int = 5) -> DataFrame:
    """(syn, ref, hamming) with at most ``max_hamming`` different bits.

    64 bits in max_hamming + 1 bands: a pair within the distance has an equal
    band, so an equi-join on (band, bits) loses none. Equal hashes are joined
    once and expanded to their patches at the end.
    """
    bands = max_hamming + 1
    width = -(-64 // bands)
    cut = lambda i: F.shiftrightunsigned("h", i * width).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
    banded = lambda d: d.select("h").distinct().select("h", F.posexplode(F.array(*[cut(i) for i in range(bands)])).alias("band", "bits"))
    s, r = hashes(synthetic), hashes(reference)
    a, b = banded(s), banded(r)
    pairs = a.withColumnRenamed("h", "hs").join(b.withColumnRenamed("h", "hr"), ["band", "bits"]).select("hs", "hr").distinct()
    pairs = pairs.withColumn("hamming", expr.hamming(F.col("hs"), F.col("hr"))).filter(F.col("hamming") <= max_hamming)
    return pairs.join(s.select(F.col("h").alias("hs"), F.col("id").alias("syn")), "hs").join(r.select(F.col("h").alias("hr"), F.col("id").alias("ref")), "hr").select("syn", "ref", "hamming")


def confirmed(synthetic: DataFrame, reference: DataFrame, max_hamming: int = 5, threshold: float = 0.95) -> DataFrame:
    """Candidates whose correlation is at least ``threshold``, with it."""
    c = candidates(synthetic, reference, max_hamming)
    both = c.join(synthetic.select(F.col("id").alias("syn"), F.col("px").alias("sp")), "syn").join(reference.select(F.col("id").alias("ref"), F.col("px").alias("rp")), "ref")
    return both.withColumn("ncc", expr.ncc(F.col("sp"), F.col("rp"))).filter(F.col("ncc") >= threshold).select("syn", "ref", "hamming", "ncc")


def copying_rate(synthetic: DataFrame, reference: DataFrame, **limits: float) -> DataFrame:
    """Share of synthetic patches with a confirmed copy; null without any."""
    n = confirmed(synthetic, reference, **limits).agg(F.count_distinct("syn").alias("copied"))
    return n.join(synthetic.agg(F.count("*").alias("total"))).select("copied", "total", F.try_divide("copied", "total").alias("rate"))


def rate_by_relation(synthetic: DataFrame, reference: DataFrame, *by: str, **limits: float) -> DataFrame:
    """The rate against each relation (own, other, test) of reference patches, or each combination of the columns ``by``, never pooled."""
    by = by or ("relation",)
    found = confirmed(synthetic, reference, **limits).join(reference.select(F.col("id").alias("ref"), *by), "ref").groupBy(*by).agg(F.count_distinct("syn").alias("copied"))
    kinds = reference.select(*by).distinct().join(synthetic.agg(F.count("*").alias("total")))
    return kinds.join(found, list(by), "left").select(*by, F.coalesce("copied", F.lit(0).cast("long")).alias("copied"), "total", F.try_divide(F.coalesce("copied", F.lit(0)), "total").alias("rate"))


def copy_fraction(synthetic: DataFrame, bank: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Share of synthetic patches nearer than ``threshold`` to a bank patch."""
    from . import denoise

    near = denoise.nearest(synthetic, bank, 1, skip_same=False)
    return near.agg(F.avg((F.sqrt("d2") < threshold).cast("double")).alias("copy_fraction"), F.count("*").alias("n"))
