"""Classical augmentation of square patches by seeded draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr


def _indexed(px: Column, p: int, source) -> Column:  # noqa: ANN001
    """px with each position taken from source(position)."""
    return F.transform(F.sequence(F.lit(0), F.lit(p * p - 1)), lambda i: F.element_at(px, (source(i) + 1).cast("int")))


def flipped_columns(i: Column, p: int) -> Column:
    return F.floor(i / p) * p + (p - 1 - i % p)


def flipped_rows(i: Column, p: int) -> Column:
    return (p - 1 - F.floor(i / p)) * p + i % p


def turned(i: Column, p: int, k: Column) -> Column:
    """Where a pixel comes from after k quarter turns against the clock."""
    r, c = F.floor(i / p), i % p
    return F.when(k == 1, c * p + (p - 1 - r)).when(k == 2, (p - 1 - r) * p + (p - 1 - c)).when(k == 3, (p - 1 - c) * p + r).otherwise(i)


def augment(patches: DataFrame, p: int, seed: int = 0, *, p_flip: float = 0.5, p_rotate: float = 0.5, p_noise: float = 0.3, noise_sigma: float = 5.0, p_bright: float = 0.3, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Each patch after a mirror along each axis, a turn, noise and brightness, each by its own draw and in this order."""
    u = lambda name: expr.uniform(f"{seed}:{name}", F.col("id"))
    # One gather by the three steps' composed positions.
    out = patches.withColumns({"__h": u("h") < p_flip, "__v": u("v") < p_flip, "__k": F.when(u("rot") < p_rotate, F.floor(u("k") * 3) + 1).otherwise(0)})

    def source(i: Column) -> Column:
        t = turned(i, p, F.col("__k"))
        t = F.when(F.col("__v"), flipped_rows(t, p)).otherwise(t)
        return F.when(F.col("__h"), flipped_columns(t, p)).otherwise(t)

    out = out.withColumn("px", _indexed(F.col("px"), p, source)).drop("__h", "__v", "__k")
    noisy = F.transform("px", lambda x, i: x + noise_sigma * expr.normal(f"{seed}:n", F.col("id"), i))
    out = out.withColumn("px", F.when(u("noise") < p_noise, noisy).otherwise(F.col("px")))
    factor = low + u("f") * (high - low)
    return out.withColumn("px", F.when(u("bright") < p_bright, F.transform("px", lambda x: x * factor)).otherwise(F.col("px")))
