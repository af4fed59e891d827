"""Queries on images as pixel tables."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import grids, patches, texture, validity
from .registry import PIXELS, SQL, pixels, query

ID = grids.ID
OUT = "SELECT source_id, r, c, round(v, 6) AS v"


def _pixels(df):
    return df.select(ID, "r", "c", F.round("v", 6).alias("v"))


_PAD = "CASE WHEN {i} % (2 * {n} - 2) < {n} THEN {i} % (2 * {n} - 2) ELSE 2 * {n} - 2 - {i} % (2 * {n} - 2) END"
_EDGE = "CASE WHEN ({i} + 2 * {n}) % (2 * {n}) < {n} THEN ({i} + 2 * {n}) % (2 * {n}) ELSE 2 * {n} - 1 - ({i} + 2 * {n}) % (2 * {n}) END"


def _pad(i: str, n: str) -> str:
    return _PAD.format(i=f"({i} + 2 * {n} - 2)", n=n)


@query("pad_reflect", f"""WITH {PIXELS}, g AS (SELECT source_id, h, w, r, unnest(range(w + 6)) AS c FROM (SELECT source_id, h, w, unnest(range(h + 6)) AS r FROM shp))
  SELECT g.source_id, CAST(g.r AS INTEGER) AS r, CAST(g.c AS INTEGER) AS c, round(v, 6) AS v FROM g JOIN px ON px.source_id = g.source_id AND px.r = {_pad('(g.r - 3)', 'h')} AND px.c = {_pad('(g.c - 3)', 'w')}""")
def pad_reflect(spark, d):
    return _pixels(grids.pad_reflect(pixels(spark, d), 3))


@query("crop", f"WITH {PIXELS} SELECT source_id, CAST(r - 3 AS INTEGER) AS r, CAST(c - 5 AS INTEGER) AS c, round(v, 6) AS v FROM px WHERE r BETWEEN 3 AND 10 AND c BETWEEN 5 AND 12")
def crop(spark, d):
    return _pixels(grids.crop(pixels(spark, d), 3, 5, 8, 8))


def _grid(factor: float) -> str:
    return f"""sz AS (SELECT source_id, h, w, CAST(greatest(1, round_even(h * {factor}::DOUBLE, 0)) AS INTEGER) AS oh, CAST(greatest(1, round_even(w * {factor}::DOUBLE, 0)) AS INTEGER) AS ow FROM shp),
  gg AS (SELECT *, unnest(range(ow)) AS c FROM (SELECT *, unnest(range(oh)) AS r FROM sz)),
  g AS (SELECT source_id, h, w, r, c, CASE WHEN oh > 1 THEN r * (h - 1) / (oh - 1) ELSE 0 END::DOUBLE AS y, CASE WHEN ow > 1 THEN c * (w - 1) / (ow - 1) ELSE 0 END::DOUBLE AS x FROM gg)"""


@query("resize_nearest", f"""WITH {PIXELS}, {_grid(0.6)} SELECT g.source_id, CAST(g.r AS INTEGER) AS r, CAST(g.c AS INTEGER) AS c, round(v, 6) AS v
  FROM g JOIN px ON px.source_id = g.source_id AND px.r = least(floor(y + 0.5), h - 1) AND px.c = least(floor(x + 0.5), w - 1)""")
def resize_nearest(spark, d):
    return _pixels(grids.resize_nearest(pixels(spark, d), 0.6))


def _bilinear(src: str, grid: str) -> str:
    return f"""SELECT g.source_id, CAST(g.r AS INTEGER) AS r, CAST(g.c AS INTEGER) AS c, sum((1 - abs(y - floor(y) - dy)) * (1 - abs(x - floor(x) - dx)) * v) AS v
    FROM {grid} g, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx), {src} s
    WHERE s.source_id = g.source_id AND s.r = least(floor(y) + dy, h - 1) AND s.c = least(floor(x) + dx, w - 1) GROUP BY 1, 2, 3"""


@query("resize_bilinear", f"WITH {PIXELS}, {_grid(0.6)}, o AS ({_bilinear('px', 'g')}) {OUT} FROM o")
def resize_bilinear(spark, d):
    return _pixels(grids.resize_bilinear(pixels(spark, d), 0.6))


def _blur(sigma: float, src: str = "px") -> str:
    kernel = expr.gaussian_kernel_weights(sigma)
    n = len(kernel) // 2
    k = "(SELECT unnest(range(%d)) - %d AS d, unnest([%s]::DOUBLE[]) AS k)" % (len(kernel), n, ", ".join(map(repr, kernel)))
    one = f"SELECT t.source_id, t.r, t.c, sum(k * s.v) AS v FROM {src} t JOIN shp USING (source_id), {k} kk, {src} s WHERE s.source_id = t.source_id AND s.c = t.c AND s.r = {_EDGE.format(i='(t.r + d)', n='h')} GROUP BY 1, 2, 3"
    two = f"SELECT t.source_id, t.r, t.c, sum(k * s.v) AS v FROM b1 t JOIN shp USING (source_id), {k} kk, b1 s WHERE s.source_id = t.source_id AND s.r = t.r AND s.c = {_EDGE.format(i='(t.c + d)', n='w')} GROUP BY 1, 2, 3"
    return f"b1 AS ({one}), b2 AS ({two})"


@query("gaussian_blur", f"WITH {PIXELS}, {_blur(1.0)} {OUT} FROM b2")
def gaussian_blur(spark, d):
    return _pixels(grids.gaussian_blur(pixels(spark, d), 1.0))


@query("pyramid_detail_budgets", f"""WITH {PIXELS}, {_blur(1.0)}, {_grid(0.5)}, lo AS ({_bilinear('b2', 'g').replace('h - 1', '15').replace('w - 1', '15')}),
  l2 AS (SELECT source_id, max(r) + 1 AS lh, max(c) + 1 AS lw FROM lo GROUP BY 1),
  g2 AS (SELECT px.source_id, r, c, lh AS h, lw AS w, r * (lh - 1) / (shp.h - 1)::DOUBLE AS y, c * (lw - 1) / (shp.w - 1)::DOUBLE AS x FROM px JOIN shp USING (source_id) JOIN l2 USING (source_id)),
  up AS ({_bilinear('lo', 'g2')}),
  fine AS (SELECT source_id, 0 AS level, stddev_pop(px.v - up.v) AS b FROM px JOIN up USING (source_id, r, c) GROUP BY 1),
  coarse AS (SELECT source_id, 1 AS level, stddev_pop(v) AS b FROM lo GROUP BY 1)
  SELECT source_id, level, round(b, 6) AS budget FROM (SELECT * FROM fine UNION ALL SELECT * FROM coarse)""")
def detail_budgets(spark, d):
    return texture.detail_budgets(texture.pyramid(pixels(spark, d), 2)).select(ID, "level", F.round("budget", 6).alias("budget"))


_GRAD = """gr AS (SELECT source_id, r, c, v,
    CASE WHEN lag(v) OVER y IS NULL THEN lead(v) OVER y - v WHEN lead(v) OVER y IS NULL THEN v - lag(v) OVER y ELSE (lead(v) OVER y - lag(v) OVER y) / 2 END AS gy,
    CASE WHEN lag(v) OVER x IS NULL THEN lead(v) OVER x - v WHEN lead(v) OVER x IS NULL THEN v - lag(v) OVER x ELSE (lead(v) OVER x - lag(v) OVER x) / 2 END AS gx
    FROM px WINDOW y AS (PARTITION BY source_id, c ORDER BY r), x AS (PARTITION BY source_id, r ORDER BY c))"""


@query("gradient", f"WITH {PIXELS}, {_GRAD} SELECT source_id, r, c, round(gy, 6) AS gr, round(gx, 6) AS gc FROM gr")
def gradient(spark, d):
    return grids.gradient(pixels(spark, d)).select(ID, "r", "c", F.round("gr", 6).alias("gr"), F.round("gc", 6).alias("gc"))


@query("gradient_histogram", f"""WITH {PIXELS}, {_GRAD}, m AS (SELECT source_id, sqrt(gy * gy + gx * gx) AS m FROM gr), t AS (SELECT source_id, m, max(m) OVER (PARTITION BY source_id) AS hi FROM m),
  b AS (SELECT source_id, CAST(CASE WHEN hi <= 1e-12 THEN 0 ELSE least(floor(m / hi * 16), 15) END AS INTEGER) AS bin, count(*) AS n FROM t GROUP BY 1, 2)
  SELECT source_id, bin, n, round(n / sum(n) OVER (PARTITION BY source_id), 6) AS share FROM b""")
def gradient_histogram(spark, d):
    return texture.gradient_histogram(pixels(spark, d), 16).withColumn("share", F.round("share", 6))


@query("intensity_histogram", f"""WITH {PIXELS}, e AS (SELECT source_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1), b AS (SELECT source_id, CAST(least(floor((v - lo) / (hi - lo) * 32), 31) AS INTEGER) AS bin, count(*) AS n FROM px JOIN e USING (source_id) GROUP BY 1, 2),
  f AS (SELECT source_id, CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM (SELECT source_id, unnest(range(32)) AS i FROM e) g LEFT JOIN b ON b.source_id = g.source_id AND b.bin = g.i)
  SELECT source_id, bin, n, round(n / sum(n) OVER (PARTITION BY source_id), 6) AS share FROM (SELECT g.* FROM f g)""".replace("SELECT source_id, CAST(i", "SELECT g.source_id, CAST(i"))
def intensity_histogram(spark, d):
    return texture.histogram(pixels(spark, d), ID, "v", 32).withColumn("share", F.round("share", 6))


@query("local_variance", f"""WITH {PIXELS}, k AS (SELECT unnest(range(-4, 5)) AS d),
  a AS (SELECT t.source_id, t.r, t.c, avg(s.v) AS a, avg(s.v * s.v) AS b FROM px t JOIN shp USING (source_id), k, px s WHERE s.source_id = t.source_id AND s.c = t.c AND s.r = {_EDGE.format(i='(t.r + d)', n='h')} GROUP BY 1, 2, 3),
  o AS (SELECT t.source_id, t.r, t.c, avg(s.a) AS a, avg(s.b) AS b FROM a t JOIN shp USING (source_id), k, a s WHERE s.source_id = t.source_id AND s.r = t.r AND s.c = {_EDGE.format(i='(t.c + d)', n='w')} GROUP BY 1, 2, 3)
  SELECT source_id, r, c, round(a, 5) AS mean, round(b - a * a, 5) AS var FROM o""")
def local_variance(spark, d):
    return grids.local_variance(pixels(spark, d)).select(ID, "r", "c", F.round("mean", 5).alias("mean"), F.round("var", 5).alias("var"))


@query("sobel", f"""WITH {PIXELS}, k AS (SELECT dr, dc, CASE WHEN dc = 0 THEN 2 ELSE 1 END * dr AS wy, CASE WHEN dr = 0 THEN 2 ELSE 1 END * dc AS wx FROM (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)),
  g AS (SELECT t.source_id, t.r, t.c, sum(wy * s.v) AS gy, sum(wx * s.v) AS gx FROM px t JOIN shp USING (source_id), k, px s
    WHERE s.source_id = t.source_id AND s.r = {_EDGE.format(i='(t.r + dr)', n='h')} AND s.c = {_EDGE.format(i='(t.c + dc)', n='w')} GROUP BY 1, 2, 3)
  SELECT source_id, r, c, round(sqrt(gy * gy + gx * gx), 6) AS magnitude FROM g""")
def sobel(spark, d):
    return grids.sobel(pixels(spark, d)).withColumn("magnitude", F.round("magnitude", 6))


@query("line_shift", f"WITH {PIXELS} SELECT source_id, r, CAST(CASE WHEN r = 5 THEN (c + 3) % w ELSE c END AS INTEGER) AS c, round(v, 6) AS v FROM px JOIN shp USING (source_id)")
def line_shift(spark, d):
    return _pixels(grids.line_shift(pixels(spark, d), 5, 3))


@query("drift", f"WITH {PIXELS} SELECT source_id, r, CAST((c + 6 * r // h) % w AS INTEGER) AS c, round(v, 6) AS v FROM px JOIN shp USING (source_id)")
def drift(spark, d):
    return _pixels(grids.drift(pixels(spark, d), 6))


@query("renormalise", f"""WITH {PIXELS}, s AS (SELECT source_id, avg(v) AS m, stddev_pop(v) AS s FROM px GROUP BY 1)
  SELECT source_id, r, c, round(CASE WHEN s > 1e-6 THEN m + (v - m) * 20 / s ELSE v END, 6) AS v FROM px JOIN s USING (source_id)""")
def renormalise(spark, d):
    return _pixels(grids.renormalise(pixels(spark, d), 20.0))


@query("laplacian_blend", f"""WITH {PIXELS}, {_blur(1.0)}, u AS (SELECT px.source_id, px.r, px.c, b2.v + px.v - b2.v * 0.5 - b2.v * 0.5 AS v FROM px JOIN b2 USING (source_id, r, c)),
  t AS (SELECT source_id, avg(v) AS m, stddev_pop(v) AS s FROM u GROUP BY 1), x AS (SELECT source_id, stddev_pop(v) AS sd FROM px GROUP BY 1)
  SELECT source_id, r, c, round(m + (v - m) * sd / s, 5) AS v FROM u JOIN t USING (source_id) JOIN x USING (source_id)""")
def laplacian_blend(spark, d):
    px = pixels(spark, d)
    return grids.laplacian_blend(grids.gaussian_blur(px, 1.0), px, 1.0).select(ID, "r", "c", F.round("v", 5).alias("v"))


@query("match_histogram", f"""WITH {PIXELS}, a AS (SELECT source_id, r, c, row_number() OVER (PARTITION BY source_id ORDER BY v, r, c) - 1 AS k, count(*) OVER (PARTITION BY source_id) AS n FROM px),
  b AS (SELECT source_id, v * v / 100 AS v, row_number() OVER (PARTITION BY source_id ORDER BY v * v / 100, r, c) - 1 AS k FROM px WHERE r < 7), m AS (SELECT source_id, count(*) AS m FROM b GROUP BY 1),
  p AS (SELECT a.*, k * (m - 1) / (n - 1)::DOUBLE AS pos FROM a JOIN m USING (source_id))
  SELECT p.source_id, r, c, round(lo.v + (pos - floor(pos)) * (hi.v - lo.v), 6) AS v FROM p JOIN b lo ON lo.source_id = p.source_id AND lo.k = floor(pos) JOIN b hi ON hi.source_id = p.source_id AND hi.k = ceil(pos)""")
def match_histogram(spark, d):
    px = pixels(spark, d)
    ref = px.filter("r < 7").withColumn("v", F.col("v") * F.col("v") / 100)
    return _pixels(grids.match_histogram(px, ref))


@query("to_uint8", f"WITH {PIXELS} SELECT source_id, r, c, CAST(floor(least(greatest(v * 2 - 100, 0), 255)) AS INTEGER) AS v FROM px")
def to_uint8(spark, d):
    return grids.to_uint8(pixels(spark, d).withColumn("v", F.col("v") * 2 - 100)).select(ID, "r", "c", "v")


@query("row_profile", f"WITH {PIXELS} SELECT source_id, c, round(v, 6) AS v FROM px JOIN shp USING (source_id) WHERE r = h // 2")
def row_profile(spark, d):
    return grids.with_shape(pixels(spark, d)).filter(F.col("r") == F.floor(F.col("h") / 2)).select(ID, "c", F.round("v", 6).alias("v"))


@query("control_disc", "SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CASE WHEN pow(r - 15, 2) + pow(c - 15, 2) <= 16 THEN 255.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(64) a(r), range(64) b(c)")
def control_disc(spark, d):
    return grids.disc(64, 64, 15, 15, 4, spark)


@query("image_statistics", f"""WITH {PIXELS} SELECT source_id, max(r) + 1 AS h, max(c) + 1 AS w, round(min(v), 6) AS min_v, round(max(v), 6) AS max_v, round(avg(v), 6) AS mean_v, round(stddev_pop(v), 6) AS std_v FROM px GROUP BY 1""")
def image_statistics(spark, d):
    s = texture.image_statistics(pixels(spark, d))
    return s.select(ID, "h", "w", *[F.round(c, 6).alias(c) for c in ("min_v", "max_v", "mean_v", "std_v")])


@query("image_difference", f"WITH {PIXELS}, {_blur(1.0)} SELECT source_id, round(avg(abs(px.v - b2.v)), 6) AS mean_abs, round(max(abs(px.v - b2.v)), 6) AS max_abs FROM px JOIN b2 USING (source_id, r, c) GROUP BY 1")
def image_difference(spark, d):
    px = pixels(spark, d)
    return texture.image_difference(px, grids.gaussian_blur(px, 1.0)).select(ID, F.round("mean_abs", 6).alias("mean_abs"), F.round("max_abs", 6).alias("max_abs"))


# Masks


def _border(f: float) -> str:
    e = lambda n: f"greatest(1, CAST(round_even({n} * {f}::DOUBLE, 0) AS INTEGER))"
    return f"bm AS (SELECT source_id, r, c, v, NOT (r BETWEEN {e('h')} AND h - {e('h')} - 1 AND c BETWEEN {e('w')} AND w - {e('w')} - 1) AS border FROM px JOIN shp USING (source_id))"


@query("mask_border", f"WITH {PIXELS}, {_border(0.1)} SELECT source_id, r, c, border FROM bm")
def mask_border(spark, d):
    return grids.border_mask(pixels(spark, d), 0.1).select(ID, "r", "c", "border")


_LINE = "lm AS (SELECT source_id, r, c, v, stddev_pop(v) OVER (PARTITION BY source_id, r) < 24 OR stddev_pop(v) OVER (PARTITION BY source_id, c) < 24 AS line FROM px)"


@query("mask_long_line", f"WITH {PIXELS}, {_LINE} SELECT source_id, r, c, line FROM lm")
def mask_long_line(spark, d):
    return grids.long_line_mask(pixels(spark, d), 24.0).select(ID, "r", "c", "line")


def _components(flag: str, name: str) -> str:
    return f"""{name}_on AS (SELECT source_id, r, c FROM ({flag}) WHERE flag),
  {name}_reach AS (SELECT source_id, r, c, r AS r0, c AS c0 FROM {name}_on UNION
    SELECT o.source_id, o.r, o.c, x.r0, x.c0 FROM {name}_reach x JOIN {name}_on o ON o.source_id = x.source_id AND abs(o.r - x.r) + abs(o.c - x.c) = 1),
  {name}_first AS (SELECT source_id, r, c, min(r0 * 10000 + c0) AS root FROM {name}_reach GROUP BY 1, 2, 3),
  {name} AS (SELECT source_id, r, c, CAST(dense_rank() OVER (PARTITION BY source_id ORDER BY root) AS INTEGER) AS component FROM {name}_first)"""


_BRIGHT = "SELECT source_id, r, c, v > 150 AS flag FROM px"


@query("connected_components", f"WITH RECURSIVE {PIXELS}, {_components(_BRIGHT, 'cc')} SELECT px.source_id, px.r, px.c, coalesce(component, 0) AS component FROM px LEFT JOIN cc USING (source_id, r, c)")
def connected_components(spark, d):
    return grids.connected_components(pixels(spark, d).withColumn("on", F.col("v") > 150)).select(ID, "r", "c", "component")


@query("component_sizes", f"""WITH RECURSIVE {PIXELS}, {_components(_BRIGHT, 'cc')}, s AS (SELECT source_id, component, count(*) AS n FROM cc GROUP BY 1, 2)
  SELECT source_id, count(*) AS components, min(n) AS smallest, round(quantile_cont(n, 0.5), 6) AS median_size, max(n) AS largest FROM s GROUP BY 1""")
def component_sizes(spark, d):
    parts = grids.connected_components(pixels(spark, d).withColumn("on", F.col("v") > 150)).filter("component > 0")
    s = parts.groupBy(ID, "component").agg(F.count("*").alias("n"))
    return s.groupBy(ID).agg(F.count("*").alias("components"), F.min("n").alias("smallest"), F.round(F.percentile("n", F.lit(0.5)), 6).alias("median_size"), F.max("n").alias("largest"))


_EXT = f"""ends AS (SELECT source_id, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM px GROUP BY 1),
  {_components('SELECT source_id, r, c, v <= lo OR v >= hi AS flag FROM px JOIN ends USING (source_id)', 'ex')},
  big AS (SELECT source_id, component FROM ex GROUP BY 1, 2 HAVING count(*) >= 3),
  em AS (SELECT px.source_id, px.r, px.c, px.v, big.component IS NOT NULL AS extreme FROM px LEFT JOIN ex USING (source_id, r, c) LEFT JOIN big ON big.source_id = px.source_id AND big.component = ex.component)"""


@query("mask_extreme", f"WITH RECURSIVE {PIXELS}, {_EXT} SELECT source_id, r, c, extreme FROM em")
def mask_extreme(spark, d):
    return grids.extreme_mask(pixels(spark, d), 10.0, 90.0, 3).select(ID, "r", "c", "extreme")


_EXT1 = _EXT.replace("0.1)", "0.01)").replace("0.9)", "0.99)").replace(">= 3", ">= 2")
_FULL = f"WITH RECURSIVE {PIXELS}, {_border(0.03)}, {_LINE}, {_EXT1}, x AS (SELECT source_id, r, c, bm.v, border, extreme, line FROM bm JOIN em USING (source_id, r, c) JOIN lm USING (source_id, r, c))"


@query("mask_fractions", f"""{_FULL} SELECT source_id, round(avg(border::INTEGER), 6) AS v0, round(avg((border OR extreme)::INTEGER), 6) AS v1, round(avg((border OR extreme OR line)::INTEGER), 6) AS v2 FROM x GROUP BY 1""")
def mask_fractions(spark, d):
    px, out = pixels(spark, d), None
    for k in range(3):
        m = grids.exclusion_mask(px, k, least_size=2, least_std=24.0).groupBy(ID).agg(F.round(F.avg(F.col("excluded").cast("int")), 6).alias(f"v{k}"))
        out = m if out is None else out.join(m, ID)
    return out


@query("median_fill", f"""{_FULL}, m AS (SELECT source_id, quantile_cont(v, 0.5) FILTER (WHERE NOT (border OR extreme OR line)) AS mid FROM x GROUP BY 1)
  SELECT source_id, r, c, round(CASE WHEN (border OR extreme OR line) AND mid IS NOT NULL THEN mid ELSE v END, 6) AS v FROM x JOIN m USING (source_id)""")
def median_fill(spark, d):
    return _pixels(grids.median_fill(grids.exclusion_mask(pixels(spark, d), 2, least_size=2, least_std=24.0)))


# Patches


def _positions(p: int, s: int) -> str:
    at = lambda n: f"list_sort(list_distinct(list_concat(range(0, {n} - {p} + 1, {s}), [{n} - {p}]::BIGINT[])))"
    return f"""pr AS (SELECT source_id, {at('h')} AS rs, {at('w')} AS cs FROM shp WHERE h >= {p} AND w >= {p}),
  p1 AS (SELECT source_id, cs, unnest(rs) AS row, generate_subscripts(rs, 1) - 1 AS i FROM pr),
  pos AS (SELECT source_id, i * len(cs) + j AS patch_index, row, col FROM (SELECT source_id, i, cs, row, unnest(cs) AS col, generate_subscripts(cs, 1) - 1 AS j FROM p1)),
  cell AS (SELECT pos.source_id, patch_index, row, col, (r - row) * {p} + c - col AS k, px.r, px.c, v FROM pos JOIN px ON px.source_id = pos.source_id AND r >= row AND r < row + {p} AND c >= col AND c < col + {p}),
  whole AS (SELECT source_id, patch_index FROM cell GROUP BY 1, 2 HAVING count(*) = {p * p}),
  pat AS (SELECT cell.* FROM cell JOIN whole USING (source_id, patch_index))"""


@query("patch_extract", f"WITH {PIXELS}, {_positions(8, 5)} SELECT source_id, CAST(patch_index AS INTEGER) AS patch_index, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST(k AS INTEGER) AS pos, round(v, 6) AS v FROM pat")
def patch_extract(spark, d):
    p = patches.extract(pixels(spark, d), 8, 5).select(ID, "patch_index", "row", "col", F.posexplode("px").alias("pos", "v"))
    return p.withColumn("v", F.round("v", 6))


@query("patch_counts", f"""WITH {PIXELS}, {_border(0.03)}, {_positions(4, 2)}, s AS (SELECT cell.source_id, patch_index, bool_or(border) AS spoilt FROM cell JOIN bm USING (source_id, r, c) GROUP BY 1, 2)
  SELECT source_id, count(*) AS before, count(*) FILTER (WHERE NOT spoilt) AS after, count(*) FILTER (WHERE spoilt) AS dropped FROM s GROUP BY 1""")
def patch_counts(spark, d):
    return patches.counts(grids.exclusion_mask(pixels(spark, d), 0), 4, 2)


@query("patch_guards", f"WITH {PIXELS}, {_border(0.03)}, {_positions(4, 2)}, s AS (SELECT cell.source_id, patch_index, bool_or(border) AS spoilt FROM cell JOIN bm USING (source_id, r, c) GROUP BY 1, 2), k AS (SELECT cell.source_id, cell.r, cell.c FROM cell JOIN s USING (source_id, patch_index) WHERE NOT spoilt) SELECT 0::BIGINT AS touching, (SELECT count(*) FROM px WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.source_id = px.source_id AND k.r = px.r AND k.c = px.c)) AS uncovered")
def patch_guards(spark, d):
    masked = grids.exclusion_mask(pixels(spark, d), 0)
    p = patches.extract(masked, 4, 2)
    return patches.touches_excluded(p, masked, 4).agg(F.count("*").alias("touching")).join(patches.uncovered(p, masked, 4).agg(F.count("*").alias("uncovered")))


_W = f"exp(-(pow(k // 8 - 3.5, 2) + pow(k % 8 - 3.5, 2)) / 8) / {math.exp(-0.5 / 8)!r}"


def _noisy(positions: str) -> str:
    """Patches that disagree a little where they overlap."""
    return f"{positions}, np AS (SELECT source_id, patch_index, r, c, k, v + patch_index % 3 AS v FROM pat)"


def _noisy_patches(spark, d):
    return patches.extract(pixels(spark, d), 8, 5).withColumn("px", F.transform("px", lambda x: x + F.col("patch_index") % 3))


@query("reconstruct_round_trip", f"WITH {PIXELS} SELECT px.source_id, px.r, px.c, round(v, 6) AS v FROM px JOIN shp USING (source_id) WHERE EXISTS (SELECT 1)")
def reconstruct_round_trip(spark, d):
    # Incomplete images have patches only where all of their pixels are.
    return _pixels(patches.reconstruct(patches.extract(pixels(spark, d), 8, 5), 8))


@query("reconstruct_mean", f"WITH {PIXELS}, {_noisy(_positions(8, 5))} SELECT source_id, r, c, round(avg(v), 6) AS v FROM np GROUP BY 1, 2, 3")
def reconstruct_mean(spark, d):
    return _pixels(patches.reconstruct(_noisy_patches(spark, d), 8))


@query("reconstruct_window", f"WITH {PIXELS}, {_noisy(_positions(8, 5))} SELECT source_id, r, c, round(sum({_W} * v) / sum({_W}), 6) AS v FROM np GROUP BY 1, 2, 3")
def reconstruct_window(spark, d):
    return _pixels(patches.reconstruct(_noisy_patches(spark, d), 8, window=expr.gaussian_window(8)))


def _irls(rounds: int) -> str:
    out = [f"{_noisy(_positions(8, 5))}, x0 AS (SELECT source_id, r, c, avg(v) AS v FROM np GROUP BY 1, 2, 3)"]
    for k in range(rounds):
        out.append(f"""e{k} AS (SELECT np.source_id, patch_index, sqrt(avg(pow(x{k}.v - np.v, 2))) AS res FROM np JOIN x{k} USING (source_id, r, c) GROUP BY 1, 2),
  f{k} AS (SELECT source_id, greatest(1e-6, 1e-3 * quantile_cont(res, 0.5)) AS lowest FROM e{k} GROUP BY 1),
  w{k} AS (SELECT source_id, patch_index, pow(greatest(res, lowest), -1.2) AS pw FROM e{k} JOIN f{k} USING (source_id)),
  x{k + 1} AS (SELECT np.source_id, r, c, sum(pw * np.v) / sum(pw) AS v FROM np JOIN w{k} USING (source_id, patch_index) GROUP BY 1, 2, 3)""")
    return ", ".join(out)


@query("reconstruct_irls", f"WITH {PIXELS}, {_irls(3)} SELECT source_id, r, c, round(v, 5) AS v FROM x3")
def reconstruct_irls(spark, d):
    return patches.reconstruct(_noisy_patches(spark, d), 8, robust_norm=0.8).select(ID, "r", "c", F.round("v", 5).alias("v"))


# Labels


_INST = "inst AS (SELECT source_id, r, c, v, CASE WHEN v > 120 THEN (r // 6) * 3 + c // 6 + 1 ELSE 0 END AS instance FROM px)"
_CENT = f"""{_INST}, mid AS (SELECT source_id, instance, CAST(round_even(avg(r), 0) AS INTEGER) AS cy, CAST(round_even(avg(c), 0) AS INTEGER) AS cx FROM inst WHERE instance <> 0 GROUP BY 1, 2),
  cen AS (SELECT source_id, instance, cy, cx, h, w FROM mid JOIN shp USING (source_id) WHERE cy >= 2 AND cy < h - 2 AND cx >= 2 AND cx < w - 2)"""


def _labels(spark, d):
    on = F.when(F.col("v") > 120, F.floor(F.col("r") / 6) * 3 + F.floor(F.col("c") / 6) + 1).otherwise(0).cast("int")
    return pixels(spark, d).withColumn("instance", on)


@query("instance_centroids", f"WITH {PIXELS}, {_CENT} SELECT source_id, CAST(instance AS INTEGER) AS instance, cy, cx FROM cen")
def instance_centroids(spark, d):
    return validity.centroids(_labels(spark, d), 4)


_VEC = "list(v ORDER BY r, c)"
_CORR = """round(coalesce(list_sum(list_transform(list_zip(t, s), lambda p: (p[1] - list_avg(t)) * (p[2] - list_avg(s)))) / nullif(sqrt(list_sum(list_transform(t, lambda x: pow(x - list_avg(t), 2))) * list_sum(list_transform(s, lambda y: pow(y - list_avg(s), 2)))), 0), 0), 10)"""


@query("displacement_search", f"""WITH {PIXELS}, {_CENT}, moved AS (SELECT source_id, (r + 1) % h AS r, (c + 2) % w AS c, v FROM px JOIN shp USING (source_id)),
  tpl AS (SELECT cen.source_id, instance, cy, cx, h, w, {_VEC} AS t FROM cen JOIN px ON px.source_id = cen.source_id AND r >= cy - 2 AND r < cy + 2 AND c >= cx - 2 AND c < cx + 2 GROUP BY ALL HAVING count(*) = 16),
  spot AS (SELECT *, unnest(range(greatest(cx - 3, 2), least(cx + 3, w - 2) + 1)) AS sx FROM (SELECT *, unnest(range(greatest(cy - 3, 2), least(cy + 3, h - 2) + 1)) AS sy FROM tpl)),
  cand AS (SELECT spot.source_id, instance, cy, cx, sy, sx, any_value(t) AS t, {_VEC} AS s FROM spot JOIN moved m ON m.source_id = spot.source_id AND r >= sy - 2 AND r < sy + 2 AND c >= sx - 2 AND c < sx + 2 GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) = 16),
  best AS (SELECT *, {_CORR} AS score FROM cand QUALIFY row_number() OVER (PARTITION BY source_id, instance ORDER BY {_CORR} DESC, sy, sx) = 1)
  SELECT source_id, CAST(instance AS INTEGER) AS instance, cy, cx, CAST(sy AS INTEGER) AS sy, CAST(sx AS INTEGER) AS sx, round(sqrt(pow(sy - cy, 2) + pow(sx - cx, 2)), 6) AS displacement, round(score, 6) AS score FROM best""")
def displacement_search(spark, d):
    px = pixels(spark, d)
    moved = grids.with_shape(px).select(ID, F.pmod(F.col("r") + 1, F.col("h")).cast("int").alias("r"), F.pmod(F.col("c") + 2, F.col("w")).cast("int").alias("c"), "v")
    found = validity.displacement(px, _labels(spark, d), moved, 4, 3)
    return found.withColumns({"displacement": F.round("displacement", 6), "score": F.round("score", 6)})


@query("displacement_summary", f"SELECT count(*) AS n, {', '.join(f'round({f}({c}), 5) AS {f}_{c}' for c in ('displacement', 'score') for f in ('avg', 'min', 'max'))} FROM ({SQL['displacement_search']})")
def displacement_summary(spark, d):
    s = validity.displacement_summary(displacement_search(spark, d))
    return s.select("n", *[F.round(c, 5).alias(c) for c in s.columns if c != "n"])


@query("labelled_patches", f"""WITH {PIXELS}, {_INST}, {_positions(8, 8)} SELECT pat.source_id, CAST(patch_index AS INTEGER) AS patch_index, CAST(max(CASE WHEN pat.v > 190 THEN 1 ELSE 0 END) AS INTEGER) AS y, round(avg(pat.v), 6) AS mean_v FROM pat GROUP BY 1, 2""")
def labelled_patches(spark, d):
    p = patches.extract(pixels(spark, d), 8, 8)
    return p.select(ID, "patch_index", F.exists("px", lambda x: x > 190).cast("int").alias("y"), F.round(expr.mean(F.col("px")), 6).alias("mean_v"))


@query("evenly_spaced_rows", f"WITH {PIXELS}, o AS (SELECT source_id, row_number() OVER (ORDER BY source_id) - 1 AS i, count(*) OVER () AS n FROM shp) SELECT source_id, i FROM o WHERE i IN (SELECT CAST(floor(k * (n - 1) / 7) AS BIGINT) FROM range(8) t(k), (SELECT any_value(n) AS n FROM o))")
def evenly_spaced(spark, d):
    # Eight at most, whatever the number of images: a report of evenly spaced ones.
    o = grids.shapes(pixels(spark, d)).select(ID, (F.row_number().over(Window.orderBy(ID)) - 1).cast("long").alias("i"))
    n = o.agg(F.count("*").alias("n"))
    want = n.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.floor(k * (F.col("n") - 1) / 7))).alias("i")).distinct()
    return o.join(want, "i").select(ID, "i")


@query("power_spectrum_radial")
def power_spectrum(spark, d):
    return texture.power_spectrum(pixels(spark, d))


@query("log_spectrum")
def log_spectrum(spark, d):
    return texture.log_spectrum(pixels(spark, d))
