"""Texture statistics of images and patches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from . import grids

ID = grids.ID


def bin_of(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Index of v's bin, the last one closed; a range without width is one bin around it."""
    spread = F.when(high > low, high - low).otherwise(F.lit(1.0))
    from_ = F.when(high > low, low).otherwise(low - 0.5)
    return F.least(F.floor((v - from_) / spread * bins), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, key: str, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(key, bin, n, share) with all bins of every key; values outside a given range are left out."""
    v = df.select(key, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    if low is None:
        ends = v.groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        v = v.join(ends, key)
    else:
        v = v.filter(F.col("v").between(low, high)).withColumns({"lo": F.lit(float(low)), "hi": F.lit(float(high))})
    n = v.groupBy(key, bin_of(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"))
    every = df.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = every.join(n, [key, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return full.withColumn("share", F.try_divide("n", F.sum("n").over(Window.partitionBy(key))))


def gradient_histogram(px: DataFrame, bins: int = 256) -> DataFrame:
    """Gradient magnitudes in bins from 0 to the image's largest; a flat image is all in bin 0."""
    g = grids.gradient(px).select(ID, F.sqrt(F.col("gr") * F.col("gr") + F.col("gc") * F.col("gc")).alias("m"))
    g = g.withColumn("hi", F.max("m").over(Window.partitionBy(ID)))
    b = F.when(F.col("hi") <= 1e-12, 0).otherwise(F.least(F.floor(F.try_divide("m", "hi") * bins), F.lit(bins - 1))).cast("int")
    n = g.groupBy(ID, b.alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(ID)))


def power_spectrum(px: DataFrame) -> DataFrame:
    """(source_id, radius, power): mean squared spectrum of the centred image by whole radius from the middle."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.pivot(index="r", columns="c", values="v").to_numpy()
        f = np.abs(np.fft.fftshift(np.fft.fft2(a - a.mean()))) ** 2
        y, x = np.indices(a.shape)
        radius = np.sqrt((y - a.shape[0] // 2) ** 2 + (x - a.shape[1] // 2) ** 2).astype(int).ravel()
        n = np.bincount(radius)
        power = np.bincount(radius, f.ravel()) / np.maximum(n, 1)
        return pd.DataFrame({"source_id": pdf["source_id"].iloc[0], "radius": np.arange(len(n), dtype=np.int32), "power": power})

    return px.groupBy(ID).applyInPandas(of, f"source_id {px.schema[ID].dataType.simpleString()}, radius int, power double")


def patch_spectrum(patches: DataFrame, p: int = 8) -> DataFrame:
    """(id, radius, power) of p x p patches by the discrete transform written out, which stays in the JVM."""
    m = patches.withColumn("m", expr.mean(F.col("px"))).select("id", F.posexplode(F.transform("px", lambda x: x - F.col("m"))).alias("pos", "v"))
    cell = F.sequence(F.lit(0), F.lit(p - 1))
    angle = F.lit(2 * math.pi / p) * (F.col("u") * F.floor(F.col("pos") / p) + F.col("w") * (F.col("pos") % p))
    f = m.select("*", F.explode(cell).alias("u")).select("*", F.explode(cell).alias("w")).groupBy("id", "u", "w").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))
    # After the shift, frequency 0 stands at p // 2.
    at = lambda c: F.pmod(F.col(c) + p // 2, F.lit(p)) - p // 2
    radius = F.floor(F.sqrt((at("u") * at("u") + at("w") * at("w")).cast("double"))).cast("int")
    return f.groupBy("id", radius.alias("radius")).agg(F.avg(F.col("re") ** 2 + F.col("im") ** 2).alias("power"))


def autocorrelation(patches: DataFrame, p: int = 8) -> DataFrame:
    """(id, dr, dc, acf): circular autocorrelation of the centred patch over its largest value; 0 for flat patches."""
    m = patches.withColumn("m", expr.mean(F.col("px"))).select("id", F.transform("px", lambda x: x - F.col("m")).alias("x"))
    each = m.select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(p * p - 1))).alias("shift"))
    dr, dc = F.floor(F.col("shift") / p), F.col("shift") % p
    other = lambda i: F.pmod(F.floor(i / p) + dr, F.lit(p)) * p + F.pmod(i % p + dc, F.lit(p))
    corr = F.aggregate(F.transform("x", lambda v, i: v * F.element_at("x", (other(i) + 1).cast("int"))), F.lit(0.0), lambda s, v: s + v)
    each = each.select("id", dr.cast("int").alias("dr"), dc.cast("int").alias("dc"), corr.alias("a"))
    top = F.max("a").over(Window.partitionBy("id"))
    return each.withColumn("top", top).select("id", "dr", "dc", F.when(F.col("top") > 1e-12, F.col("a") / F.col("top")).otherwise(0.0).alias("acf"))


def log_spectrum(px: DataFrame) -> DataFrame:
    """(source_id, r, c, v): log(1 + |shifted spectrum|)."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.pivot(index="r", columns="c", values="v").to_numpy()
        f = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(a))))
        y, x = np.indices(a.shape)
        return pd.DataFrame({"source_id": pdf["source_id"].iloc[0], "r": y.ravel().astype(np.int32), "c": x.ravel().astype(np.int32), "v": f.ravel()})

    return px.groupBy(ID).applyInPandas(of, f"source_id {px.schema[ID].dataType.simpleString()}, r int, c int, v double")


def diversity(images: DataFrame, kind: str = "l1", block: int = 1024) -> DataFrame:
    """(grp, pairs, diversity): mean over a group's pairs of members of their difference, absolute or root mean square.

    ``images`` is (grp, member, pos, v). Absolute differences need no pairs: the
    sorted values of a pixel are weighted by rank. For the root mean square a
    group's members are dealt to blocks of about ``block``, and pairs of blocks
    are compared as matrices, over the pixels that both members have.
    """
    if kind == "l1":
        w = Window.partitionBy("grp", "pos").orderBy("v", "member")
        n = F.count("*").over(Window.partitionBy("grp", "pos"))
        ranked = images.withColumns({"k": F.row_number().over(w), "n": n})
        per = ranked.groupBy("grp", "pos").agg(F.sum(F.col("v") * (2 * F.col("k") - F.col("n") - 1)).alias("s"), F.first("n").alias("n"))
        per = per.filter("n > 1").withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
        return per.groupBy("grp").agg(F.max("pairs").alias("pairs"), F.avg(F.col("s") / F.col("pairs")).alias("diversity"))

    def compare(x: np.ndarray, y: np.ndarray, same: bool, full: bool) -> tuple[int, float]:
        n, total = 0, 0.0
        if full and x.shape[1]:
            # By the expansion about the middle; what it can't tell from 0 is computed directly.
            x, y = x - x.mean(axis=0), y - x.mean(axis=0)
            nx, ny = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
            squares = nx[:, None] + ny[None] - 2 * (x @ y.T)
            r, c = np.nonzero(~(squares > 1e-6 * (nx[:, None] + ny[None])))
            for i in range(0, len(r), 65536):
                d = x[r[i : i + 65536]] - y[c[i : i + 65536]]
                squares[r[i : i + 65536], c[i : i + 65536]] = np.einsum("ij,ij->i", d, d)
            root = np.sqrt(squares / x.shape[1])
            return (len(x) * (len(x) - 1) // 2, float(np.triu(root, 1).sum())) if same else (root.size, float(root.sum()))
        for k, row in enumerate(x):
            squares = (row - (y[k + 1 :] if same else y)) ** 2
            both = ~np.isnan(squares)
            shared = both.sum(axis=1)
            total += float(np.sqrt(np.where(both, squares, 0.0).sum(axis=1)[shared > 0] / shared[shared > 0]).sum())
            n += int((shared > 0).sum())
        return n, total

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        n, total = compare(*_matrices(a, b), key[1] == key[2], _complete(a, b)) if len(a) and len(b) else (0, 0.0)
        return pd.DataFrame({"grp": [key[0]], "n": [n], "total": [total]})

    grp = images.schema["grp"].dataType.simpleString()
    found = _block_pairs(images, block).applyInPandas(run, f"grp {grp}, n long, total double")
    return found.groupBy("grp").agg(F.sum("n").alias("pairs"), F.sum("total").alias("total")).filter("pairs > 0").select("grp", "pairs", (F.col("total") / F.col("pairs")).alias("diversity"))


def _block_pairs(images: DataFrame, block: int):  # noqa: ANN202
    """Every two blocks of a group's members, cogrouped by (grp, i, j), i <= j: rows (pos, v, member)."""
    whole = images.groupBy("grp", "member").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("px"))
    sizes = whole.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    dealt = whole.join(sizes, "grp").select("grp", "blocks", F.pmod(F.xxhash64("member"), "blocks").cast("int").alias("b"), F.col("px.pos").alias("pos"), F.col("px.v").alias("v"), "member")
    left = dealt.select("grp", F.col("b").alias("i"), F.explode(F.sequence("b", F.col("blocks") - 1)).alias("j"), "pos", "v", "member")
    right = dealt.select(F.col("grp").alias("g"), F.explode(F.sequence(F.lit(0), "b")).alias("i"), F.col("b").alias("j"), F.col("pos").alias("p"), F.col("v").alias("w"), F.col("member").alias("m")).toDF("grp", "i", "j", "pos", "v", "member")
    return left.groupBy("grp", "i", "j").cogroup(right.groupBy("grp", "i", "j"))


def _complete(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    """Whether all members of both have the same positions, and a finite value at each."""
    first = np.asarray(a["pos"].iloc[0])
    return all(np.array_equal(p, first) for p in [*a["pos"], *b["pos"]]) and all(np.isfinite(np.asarray(v, dtype=np.float64)).all() for v in [*a["v"], *b["v"]])


def _matrices(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Members by positions, in the order of members; nan where a member has no value."""
    at = np.unique(np.concatenate([np.asarray(p) for p in [*a["pos"], *b["pos"]]]))

    def matrix(rows: pd.DataFrame) -> np.ndarray:
        m = np.full((len(rows), len(at)), np.nan)
        for k, (p, v) in enumerate(zip(rows["pos"], rows["v"], strict=True)):
            m[k, np.searchsorted(at, p)] = v
        return m

    return matrix(a.sort_values("member")), matrix(b.sort_values("member"))


def image_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(source_id, mean_abs, max_abs) of two aligned pixel tables."""
    both = a.join(b.select(ID, "r", "c", F.col("v").alias("v2")), [ID, "r", "c"])
    return both.groupBy(ID).agg(F.avg(F.abs(F.col("v") - F.col("v2"))).alias("mean_abs"), F.max(F.abs(F.col("v") - F.col("v2"))).alias("max_abs"))


def image_statistics(px: DataFrame) -> DataFrame:
    return px.groupBy(ID).agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.avg("v").alias("mean_v"), F.stddev_pop("v").alias("std_v"))


def pairwise_correlation(images: DataFrame, block: int = 1024) -> DataFrame:
    """(grp, a, b, corr): Pearson correlation of the pixels of every two members of a group.

    Blocks of members are multiplied as matrices, over the pixels that both
    members have; only the input and its copies for other blocks are shuffled,
    the pairs go out as they are made.
    """
    kind = {f.name: f.dataType.simpleString() for f in images.schema.fields}

    def centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = np.where(np.ptp(m, axis=1, keepdims=True) > 0, m - m.mean(axis=1, keepdims=True), 0.0)
        return m, np.einsum("ij,ij->i", m, m)

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["grp", "a", "b", "corr"]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        x, y = _matrices(a, b)
        if _complete(a, b):
            (x, sx), (y, sy) = centred(x), centred(y)
            r, shared = x @ y.T, np.ones((len(x), len(y)), bool)
            with np.errstate(invalid="ignore", divide="ignore"):
                r /= np.sqrt(sx[:, None] * sy[None])
        else:
            r, shared = np.full((len(x), len(y)), np.nan), np.zeros((len(x), len(y)), bool)
            for k, row in enumerate(x):
                both = ~np.isnan(row) & ~np.isnan(y)
                n = np.maximum(1, both.sum(axis=1))
                u, w = np.where(both, row, 0.0), np.where(both, y, 0.0)
                u, w = np.where(both, u - (u.sum(axis=1) / n)[:, None], 0.0), np.where(both, w - (w.sum(axis=1) / n)[:, None], 0.0)
                with np.errstate(invalid="ignore", divide="ignore"):
                    r[k] = (u * w).sum(axis=1) / np.sqrt((u * u).sum(axis=1) * (w * w).sum(axis=1))
                shared[k] = both.any(axis=1)
        left, right = (np.sort(d["member"].to_numpy()) for d in (a, b))
        i, j = np.nonzero(np.triu(shared, 1) if key[1] == key[2] else shared)
        turned = left[i] > right[j]
        return pd.DataFrame({"grp": key[0], "a": np.where(turned, right[j], left[i]), "b": np.where(turned, left[i], right[j]), "corr": r[i, j]})[names]

    return _block_pairs(images, block).applyInPandas(run, f"grp {kind['grp']}, a {kind['member']}, b {kind['member']}, corr double")


def detail_budgets(levels: DataFrame, sigma_max: float | None = None) -> DataFrame:
    """(source_id, level, budget): std of a level less its enlarged next one; for the coarsest its own std, or ``sigma_max``."""
    top = levels.agg(F.max("level")).first()[0]
    out = None
    for k in range(int(top) + 1 if top is not None else 0):
        own = levels.filter(F.col("level") == k).drop("level")
        if k < top:
            up = grids.upsample_to(levels.filter(F.col("level") == k + 1).drop("level"), own)
            one = own.join(up.withColumnRenamed("v", "u"), [ID, "r", "c"]).groupBy(ID).agg(F.stddev_pop(F.col("v") - F.col("u")).alias("budget"))
        else:
            one = own.groupBy(ID).agg((F.lit(float(sigma_max)) if sigma_max is not None else F.stddev_pop("v")).alias("budget"))
        one = one.select(ID, F.lit(k).alias("level"), "budget")
        out = one if out is None else out.unionByName(one)
    return out


def pyramid(px: DataFrame, n: int, factor: float = 0.5) -> DataFrame:
    """(source_id, level, r, c, v), level 0 the image itself: each next one blurred with sigma 1/(2 factor) and resized."""
    if not 0 < factor < 1 or n < 1:
        raise ValueError("the factor must be between 0 and 1 and there must be a level")
    level, out = px.select(ID, "r", "c", "v"), None
    for k in range(n):
        if k:
            level = grids.resize_bilinear(grids.gaussian_blur(level, 1 / factor / 2), factor)
        one = level.withColumn("level", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.select(ID, "level", "r", "c", "v")


def describe(df: DataFrame, key: str | None, value: str, accuracy: int = 10_000) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max, with exact percentiles."""
    v = F.col(value)
    rest = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min")]
    if key:
        return df.groupBy(key).agg(*rest, *[F.percentile(v, F.lit(p / 100)).alias(f"p{p}") for p in (25, 50, 75)], F.max(v).alias("max"))
    return df.agg(*rest, F.max(v).alias("max")).join(F.broadcast(exact_percentiles(df, value, (25, 50, 75), accuracy))).select("n", "mean", "std", "min", "p25", "p50", "p75", "max")


def exact_percentiles(df: DataFrame, value: str, wanted: tuple[int, ...], accuracy: int = 10_000) -> DataFrame:
    """One row (p25, ...) of interpolated percentiles of all rows, as ``percentile`` gives them.

    A sketch brackets each percentile; only the distinct values in the brackets
    are counted one by one, the rows below them as a whole. So a task reads a
    share of the rows that the accuracy bounds, not all of their values.
    """
    v = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    slack = 4 / accuracy
    sides = [min(1.0, max(0.0, p / 100 + s)) for p in wanted for s in (-slack, slack)]
    ends = v.agg(F.count("*").alias("n"), F.percentile_approx("v", sides, accuracy).alias("ends")).first()
    names = [f"p{p}" for p in wanted]
    if not ends["n"]:
        return df.sparkSession.createDataFrame([(None,) * len(names)], ", ".join(f"{n} double" for n in names))
    low, high = ends["ends"][::2], ends["ends"][1::2]
    below = v.agg(*[F.count_if(F.col("v") < F.lit(x)).alias(f"b{k}") for k, x in enumerate(low)]).first()
    inside = v.select(F.explode(F.array(*[F.when(F.col("v").between(F.lit(x), F.lit(y)), k) for k, (x, y) in enumerate(zip(low, high, strict=True))])).alias("k"), "v").filter("k is not null")
    upto = F.sum("m").over(Window.partitionBy("k").orderBy("v"))
    ranked = inside.groupBy("k", "v").agg(F.count("*").alias("m")).withColumn("upto", upto)
    picks = []
    for k, (name, p) in enumerate(zip(names, wanted, strict=True)):
        at = (ends["n"] - 1) * (p / 100)
        first, second = math.floor(at), math.ceil(at)
        value_at = lambda i: F.min(F.when((F.col("k") == k) & (F.col("upto") + below[k] > i), F.col("v")))  # noqa: B023, E731
        picks.append((value_at(first) if first == second else (second - at) * value_at(first) + (at - first) * value_at(second)).alias(name))
    return ranked.agg(*picks)
