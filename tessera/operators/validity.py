"""Label validity: centroids of instances, bounded template search, pseudo-labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grids, whole

ID = grids.ID


def centroids(labels: DataFrame, patch_size: int = 16) -> DataFrame:
    """(source_id, instance, cy, cx) of each nonzero label, rounded half to even; those too near the border are left out.

    ``labels`` is (source_id, r, c, instance).
    """
    half = patch_size // 2
    s = labels.groupBy(ID).agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    mid = labels.filter("instance <> 0").groupBy(ID, "instance").agg(F.bround(F.avg("r"), 0).cast("int").alias("cy"), F.bround(F.avg("c"), 0).cast("int").alias("cx"))
    return mid.join(s, ID).filter((F.col("cy") >= half) & (F.col("cy") < F.col("h") - half) & (F.col("cx") >= half) & (F.col("cx") < F.col("w") - half)).select(ID, "instance", "cy", "cx")


def displacement(real: DataFrame, labels: DataFrame, synthetic: DataFrame, patch_size: int = 16, radius: int = 40) -> DataFrame:
    """(source_id, instance, cy, cx, sy, sx, displacement, score): where each instance's patch fits the synthetic image best.

    Places up to ``radius`` away, both ends included, that keep the patch
    inside; the first best in row-major order. Both images and their instances
    meet in one task, an instance's places are compared there.
    """
    half, n = patch_size // 2, patch_size * patch_size
    pos = np.arange(n)
    kind = labels.schema["instance"].dataType.simpleString()
    pixel = lambda px, which: px.select(ID, F.lit(which).alias("which"), "r", "c", "v", F.lit(None).cast(kind).alias("instance"))
    inst = centroids(labels, patch_size).select(ID, F.lit(2).alias("which"), F.col("cy").alias("r"), F.col("cx").alias("c"), F.lit(None).cast("double").alias("v"), "instance")

    def cut(im: whole.Image, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, found = im.at((y - half)[:, None] + pos // patch_size, (x - half)[:, None] + pos % patch_size)
        whole_ones = (found & im.single[row]).all(axis=1)
        return im.values()[0][row[whole_ones]], whole_ones

    def run(t: pa.Table) -> dict:
        which = t.column("which")
        real, moved, at = (t.filter(pc.equal(which, k)) for k in range(3))
        out: list[tuple] = []
        if len(real) and len(moved):
            real, moved = whole.Image(real), whole.Image(moved)
            for name, cy, cx in zip(at.column("instance").to_pylist(), at.column("r").to_pylist(), at.column("c").to_pylist(), strict=True):
                template, there = cut(real, np.array([cy]), np.array([cx]))
                sy, sx = np.arange(max(cy - radius, half), min(cy + radius, real.h - half) + 1), np.arange(max(cx - radius, half), min(cx + radius, real.w - half) + 1)
                sy, sx = np.repeat(sy, len(sx)), np.tile(sx, len(sy))
                cand, kept = cut(moved, sy, sx)
                if not (there.all() and kept.any()):
                    continue
                a, b = template[0] - template[0].mean(), cand - cand.mean(axis=1, keepdims=True)
                down = np.sqrt((a * a).sum() * (b * b).sum(axis=1))
                score = np.round(np.where(down < 1e-12, 0.0, b @ a / np.where(down < 1e-12, 1.0, down)), 10)
                best = int(np.argmax(np.where(np.isnan(score), -np.inf, score)))
                y, x = int(sy[kept][best]), int(sx[kept][best])
                out.append((name, cy, cx, y, x, float(np.sqrt(float((y - cy) ** 2 + (x - cx) ** 2))), None if np.isnan(score[best]) else float(score[best])))
        names = ["instance", "cy", "cx", "sy", "sx", "displacement", "score"]
        types = [at.schema.field("instance").type, *[pa.int32()] * 4, pa.float64(), pa.float64()]
        return {c: pa.array([row[k] for row in out], kd) for k, (c, kd) in enumerate(zip(names, types, strict=True))}

    every = pixel(real, 0).unionByName(pixel(synthetic, 1)).unionByName(inst)
    return whole.groups(every, run, f"instance {kind}, cy int, cx int, sy int, sx int, displacement double, score double")


def displacement_summary(found: DataFrame) -> DataFrame:
    """(n, avg, min and max of displacement and of score) over all instances."""
    return found.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("displacement", "score") for f in (F.avg, F.min, F.max)])
