"""Column expressions over patches (arrays of doubles, row-major) and seeded draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    """Sum of an array, first element first."""
    return _sum(a)


def mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def std(a: Column) -> Column:
    """Population standard deviation."""
    m = F.array(mean(a))
    return F.sqrt(F.transform(m, lambda mu: _sum(F.transform(a, lambda x: (x - mu) * (x - mu))) / F.size(a))[0])


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def ncc(a: Column, b: Column) -> Column:
    """Normalised cross-correlation; 0 if either patch is flat."""
    stats = F.array(F.struct(mean(a).alias("ma"), mean(b).alias("mb")))

    def of(s: Column) -> Column:
        up = _sum(F.zip_with(a, b, lambda x, y: (x - s["ma"]) * (y - s["mb"])))
        aa = _sum(F.transform(a, lambda x: (x - s["ma"]) * (x - s["ma"])))
        bb = _sum(F.transform(b, lambda y: (y - s["mb"]) * (y - s["mb"])))
        down = F.sqrt(aa * bb)
        return F.when(down < 1e-12, F.lit(0.0)).otherwise(F.try_divide(up, down))

    return F.transform(stats, of)[0]


def average_hash(px: Column) -> Column:
    """64 bits of an 8x8 patch, the first pixel the lowest: 1 where it is above the mean."""
    with_mean = F.array(mean(px))
    bits = F.transform(with_mean, lambda m: F.aggregate(F.transform(px, lambda x, i: F.when(x > m, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)))
    return bits[0]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def gaussian_window(p: int, relative_sigma: float = 0.25) -> list[float]:
    """Weights of a p x p patch, row-major, 1 at the peak."""
    s = relative_sigma * p
    one = [math.exp(-((i - (p - 1) / 2) ** 2) / (2 * s * s)) for i in range(p)]
    peak = max(a * b for a in one for b in one)
    return [a * b / peak for a in one for b in one]


def geometric_schedule(high: float, low: float, n: int) -> list[float]:
    """n values from high to low in equal ratios, both ends included; a zero end is taken as 1e-6."""
    high, low = max(high, 1e-6), max(low, 1e-6)
    return [high] if n == 1 else [math.exp(math.log(high) + i * (math.log(low) - math.log(high)) / (n - 1)) for i in range(n)]


def uniform(seed: object, *keys: Column) -> Column:
    """A draw from [0, 1) that any engine with md5 repeats: the first 32 bits of md5(seed:key:...)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def normal(seed: object, *keys: Column) -> Column:
    """A standard normal draw by the Box-Muller transform of two uniform ones, rounded to 8 places."""
    u = (uniform(f"{seed}:a", *keys) * 4294967296.0 + 1) / 4294967297.0
    return F.round(F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * uniform(f"{seed}:b", *keys)), 8)


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def gaussian_kernel_weights(sigma: float) -> list[float]:
    """Weights of a blur of radius int(4 sigma + 0.5), which add up to 1."""
    radius = int(4 * sigma + 0.5)
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]
