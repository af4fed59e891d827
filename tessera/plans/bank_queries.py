"""Queries on the patch bank: denoising, nearest neighbours, copying, spectra."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import augment, copying, denoise, learning, texture
from .registry import BANK, CELLS, SHAKEN, bank, perturbed, query

SIGMA, K = 0.3, 8
D2 = "pow(list_distance(a.px, b.px), 2)"
NEAR = f"""near AS (SELECT a.id AS query, b.id AS neighbour, {D2} AS d2,
    row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS rank FROM bank a JOIN bank b ON a.id <> b.id)"""


@query("denoise_topk_softmax", f"""WITH {CELLS}, {NEAR}, w AS (SELECT query, neighbour, exp(-(d2 - min(d2) OVER (PARTITION BY query)) / (2 * {SIGMA} * {SIGMA})) AS w FROM near WHERE rank <= {K})
  SELECT query, CAST(pos AS INTEGER) AS pos, round(sum(w * x) / sum(w), 6) AS v FROM w JOIN cells ON neighbour = id GROUP BY 1, 2""")
def denoise_topk(spark, d):
    b = bank(spark, d)
    return denoise.softmax_topk(b, b, SIGMA, K).select("query", "pos", F.round("v", 6).alias("v"))


@query("denoise_full_bank", f"""WITH {CELLS}, p AS (SELECT a.id AS query, b.id AS neighbour, {D2} AS d2 FROM bank a JOIN bank b ON a.id <> b.id),
  w AS (SELECT query, neighbour, exp(-(d2 - min(d2) OVER (PARTITION BY query)) / (2 * {SIGMA} * {SIGMA})) AS w FROM p)
  SELECT query, CAST(pos AS INTEGER) AS pos, round(sum(w * x) / sum(w), 6) AS v FROM w JOIN cells ON neighbour = id GROUP BY 1, 2""")
def denoise_full(spark, d):
    b = bank(spark, d)
    return denoise.softmax_full(b, b, SIGMA).select("query", F.posexplode("px").alias("pos", "v")).select("query", "pos", F.round("v", 6).alias("v"))


@query("nearest_other", f"WITH {BANK}, {NEAR} SELECT query, neighbour, round(sqrt(d2), 6) AS d FROM near WHERE rank = 1")
def nearest_other(spark, d):
    b = bank(spark, d)
    return denoise.nearest(b, b, 1).select("query", "neighbour", F.round(F.sqrt("d2"), 6).alias("d"))


_NN = f"""WITH {SHAKEN}, p AS (SELECT a.id AS query, b.id AS bank, list_distance(a.px, b.px) AS dist FROM syn a, bank b),
  least AS (SELECT bank, min(dist) AS least FROM p GROUP BY 1), alpha AS (SELECT greatest(0.5 * avg(least), 1e-8) AS alpha FROM least),
  nn AS (SELECT query, min(struct_pack(score := dist / (least + alpha), neighbour := bank)) AS b FROM p JOIN least USING (bank), alpha GROUP BY 1)"""


@query("nn_select_normalised", f"{_NN} SELECT query, b.neighbour AS neighbour, round(b.score, 6) AS score FROM nn")
def nn_normalised(spark, d):
    return denoise.nn_normalised(perturbed(spark, d), bank(spark, d), 0.5).select("query", "neighbour", F.round("score", 6).alias("score"))


@query("nn_plain", f"WITH {SHAKEN}, p AS (SELECT a.id AS query, min(struct_pack(d := list_distance(a.px, b.px), neighbour := b.id)) AS b FROM syn a, bank b GROUP BY 1) SELECT query, b.neighbour AS neighbour, round(b.d, 6) AS score FROM p")
def nn_plain(spark, d):
    return denoise.nn_normalised(perturbed(spark, d), bank(spark, d), None).select("query", "neighbour", F.round("score", 6).alias("score"))


@query("bank_usage", f"{_NN}, u AS (SELECT b.neighbour AS neighbour, count(*) AS n FROM nn GROUP BY 1) SELECT count(*) AS distinct_used, max(n) AS max_reuse FROM u")
def bank_usage(spark, d):
    return denoise.bank_usage(denoise.nn_normalised(perturbed(spark, d), bank(spark, d), 0.5))


TOL = 0.002
_BAND = f"""WITH {SHAKEN}, q AS (SELECT id AS query, px AS qp, list_sum(px) / len(px) AS qm FROM syn), b AS (SELECT id AS neighbour, px, list_sum(px) / len(px) AS bm FROM bank),
  near AS (SELECT query, neighbour FROM q JOIN b ON abs(qm - bm) <= {TOL}),
  pairs AS (SELECT * FROM near UNION ALL SELECT query, neighbour FROM q, b WHERE query NOT IN (SELECT query FROM near))"""


@query("mean_prefilter_band_join", f"{_BAND} SELECT query, count(*) AS candidates, min(neighbour) AS first_candidate FROM pairs GROUP BY 1")
def band(spark, d):
    p = denoise.mean_band_candidates(perturbed(spark, d), bank(spark, d), TOL)
    return p.groupBy("query").agg(F.count("*").alias("candidates"), F.min("neighbour").alias("first_candidate"))


_T = (1.0, 0.01, 0.002, 0.0005)
_WITHIN = f"SELECT t AS tolerance, query, count(neighbour) FILTER (WHERE abs(qm - bm) <= t) AS n FROM q, b, (SELECT unnest({list(_T)}::DOUBLE[]) AS t) GROUP BY 1, 2"


@query("candidates_by_tolerance", f"""{_BAND}, c AS ({_WITHIN}), total AS (SELECT count(*) AS total FROM bank)
  SELECT tolerance, count(*) AS queries, CAST(sum(CASE WHEN n = 0 THEN total ELSE n END) AS BIGINT) AS candidates FROM c, total GROUP BY 1""")
def candidates_by_tolerance(spark, d):
    return denoise.candidate_counts(perturbed(spark, d), bank(spark, d), _T)


@query("denoise_prefiltered", f"""{_BAND}, w AS (SELECT query, neighbour, exp(-(pow(list_distance(qp, px), 2) - min(pow(list_distance(qp, px), 2)) OVER (PARTITION BY query)) / (2 * {SIGMA} * {SIGMA})) AS w FROM pairs JOIN q USING (query) JOIN b USING (neighbour)),
  cells AS (SELECT id, unnest(px) AS x, generate_subscripts(px, 1) - 1 AS pos FROM bank)
  SELECT query, CAST(pos AS INTEGER) AS pos, round(sum(w * x) / sum(w), 6) AS v FROM w JOIN cells ON neighbour = id GROUP BY 1, 2""")
def prefiltered(spark, d):
    return denoise.prefiltered_softmax(perturbed(spark, d), bank(spark, d), SIGMA, TOL).select("query", "pos", F.round("v", 6).alias("v"))


@query("pseudo_label_1nn", f"WITH {BANK}, {NEAR} SELECT query, neighbour, b.label AS label FROM near JOIN bank b ON neighbour = b.id WHERE rank = 1")
def pseudo(spark, d):
    b = bank(spark, d)
    return denoise.pseudo_labels(b, b)


@query("weight_collapse", f"""WITH {BANK}, p AS (SELECT a.id AS query, {D2} AS d2 FROM bank a JOIN bank b ON a.id <> b.id), m AS (SELECT query, d2 - min(d2) OVER (PARTITION BY query) AS e FROM p)
  SELECT query, CAST(sigma AS DOUBLE) AS sigma, round(1 / sum(exp(-e / (2 * sigma * sigma))), 6) AS top_weight FROM m, (SELECT unnest([1.0, 0.3, 0.1]::DOUBLE[]) AS sigma) GROUP BY 1, 2""")
def collapse(spark, d):
    b = bank(spark, d)
    return denoise.weight_collapse(b, b, (1.0, 0.3, 0.1)).select("query", "sigma", F.round("top_weight", 6).alias("top_weight"))


U = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("sigma_range", f"""WITH {BANK}, n AS (SELECT count(*) AS n FROM bank), ranked AS (SELECT row_number() OVER (ORDER BY id) - 1 AS i, px FROM bank),
  pick AS (SELECT CAST(floor({U.format("'0:a:' || i")} * n) AS BIGINT) AS a, CAST(floor({U.format("'0:b:' || i")} * n) AS BIGINT) AS b FROM range(2000) t(i), n),
  ds AS (SELECT list_distance(x.px, y.px) AS d FROM pick JOIN ranked x ON x.i = a JOIN ranked y ON y.i = b),
  q AS (SELECT quantile_cont(d, 0.5) AS hi, quantile_cont(d, 0.05) AS lo FROM ds), s AS (SELECT max(list_max(px)) - min(list_min(px)) AS spread FROM bank),
  t AS (SELECT CASE WHEN hi > 1e-6 THEN hi WHEN spread > 0 THEN spread ELSE 1.0 END AS sigma_max, lo FROM q, s)
  SELECT round(sigma_max, 6) AS sigma_max, round(greatest(lo, sigma_max * 0.01), 6) AS sigma_min FROM t""")
def sigma_range(spark, d):
    return denoise.sigma_range(bank(spark, d)).select(F.round("sigma_max", 6).alias("sigma_max"), F.round("sigma_min", 6).alias("sigma_min"))


_HASH = "list_sum(list_transform(px, lambda x, i: CASE WHEN x > list_sum(px) / len(px) THEN (1::HUGEINT << (i - 1)::INTEGER) ELSE 0::HUGEINT END))::HUGEINT"
_HASHED = f"{SHAKEN}, hs AS (SELECT id AS syn, px AS sp, {_HASH}::UBIGINT AS h1 FROM syn), hr AS (SELECT id AS ref, label, px AS rp, {_HASH}::UBIGINT AS h2 FROM bank)"


@query("average_hash", f"WITH {BANK}, h AS (SELECT id, {_HASH}::UBIGINT AS h FROM bank) SELECT id, CAST(h >> 32 AS BIGINT) AS high, CAST(h & 4294967295::UBIGINT AS BIGINT) AS low FROM h")
def average_hash(spark, d):
    h = copying.hashes(bank(spark, d))
    return h.select("id", F.shiftrightunsigned("h", 32).alias("high"), F.col("h").bitwiseAND(F.lit(4294967295)).alias("low"))


_CAND = f"WITH {_HASHED}, cand AS (SELECT syn, ref, label, sp, rp, CAST(bit_count(xor(h1, h2)) AS INTEGER) AS hamming FROM hs, hr WHERE bit_count(xor(h1, h2)) <= 5)"
_NCC = """list_sum(list_transform(list_zip(sp, rp), lambda p: (p[1] - list_sum(sp) / len(sp)) * (p[2] - list_sum(rp) / len(rp))))
  / nullif(sqrt(list_sum(list_transform(sp, lambda x: pow(x - list_sum(sp) / len(sp), 2))) * list_sum(list_transform(rp, lambda y: pow(y - list_sum(rp) / len(rp), 2)))), 0)"""


@query("hamming_candidates", f"{_CAND} SELECT syn, ref, hamming FROM cand")
def hamming_candidates(spark, d):
    return copying.candidates(perturbed(spark, d), bank(spark, d))


@query("ncc_confirm", f"{_CAND} SELECT syn, ref, hamming, round({_NCC}, 6) AS ncc FROM cand WHERE {_NCC} >= 0.95")
def ncc_confirm(spark, d):
    return copying.confirmed(perturbed(spark, d), bank(spark, d)).withColumn("ncc", F.round("ncc", 6))


@query("copying_rate", f"{_CAND}, k AS (SELECT count(DISTINCT syn) AS copied FROM cand WHERE {_NCC} >= 0.95), n AS (SELECT count(*) AS total FROM syn) SELECT copied, total, round(copied / total, 6) AS rate FROM k, n")
def copying_rate(spark, d):
    return copying.copying_rate(perturbed(spark, d), bank(spark, d)).withColumn("rate", F.round("rate", 6))


_REL = "CASE label % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'other' ELSE 'test' END"


@query("copying_rate_by_relation", f"""{_CAND}, k AS (SELECT DISTINCT {_REL} AS relation FROM bank), f AS (SELECT {_REL} AS relation, count(DISTINCT syn) AS copied FROM cand WHERE {_NCC} >= 0.95 GROUP BY 1)
  SELECT relation, coalesce(copied, 0) AS copied, (SELECT count(*) FROM syn) AS total, round(coalesce(copied, 0) / (SELECT count(*) FROM syn), 6) AS rate FROM k LEFT JOIN f USING (relation)""")
def rate_by_relation(spark, d):
    relation = F.when(F.col("label") % 3 == 0, "own").when(F.col("label") % 3 == 1, "other").otherwise("test")
    return copying.rate_by_relation(perturbed(spark, d), bank(spark, d).withColumn("relation", relation)).withColumn("rate", F.round("rate", 6))


_SET = "CASE label % 2 WHEN 0 THEN 'NIST' ELSE 'RODARE' END"


@query("trust_report", f"""{_CAND}, k AS (SELECT DISTINCT {_SET} AS dataset, {_REL} AS relation FROM bank), f AS (SELECT {_SET} AS dataset, {_REL} AS relation, count(DISTINCT syn) AS copied FROM cand WHERE {_NCC} >= 0.95 GROUP BY 1, 2)
  SELECT dataset, relation, coalesce(copied, 0) AS copied, (SELECT count(*) FROM syn) AS total, round(coalesce(copied, 0) / (SELECT count(*) FROM syn), 6) AS rate FROM k LEFT JOIN f USING (dataset, relation)""")
def trust_report(spark, d):
    relation = F.when(F.col("label") % 3 == 0, "own").when(F.col("label") % 3 == 1, "other").otherwise("test")
    reference = bank(spark, d).withColumns({"relation": relation, "dataset": F.when(F.col("label") % 2 == 0, "NIST").otherwise("RODARE")})
    return copying.rate_by_relation(perturbed(spark, d), reference, "dataset", "relation").withColumn("rate", F.round("rate", 6))


@query("copy_fraction", f"""WITH {SHAKEN}, m AS (SELECT a.id, min(list_distance(a.px, b.px)) AS d FROM syn a, bank b GROUP BY 1)
  SELECT round(avg(CASE WHEN d < 0.0255 THEN 1.0 ELSE 0.0 END), 6) AS copy_fraction, count(*) AS n FROM m""")
def copy_fraction(spark, d):
    return copying.copy_fraction(perturbed(spark, d), bank(spark, d), 0.0255).withColumn("copy_fraction", F.round("copy_fraction", 6))


@query("diversity_l1", f"""WITH {CELLS}, p AS (SELECT a.label AS grp, a.id, b.id AS m2, avg(abs(a.x - b.x)) AS d FROM cells a JOIN cells b ON a.label = b.label AND a.pos = b.pos AND a.id < b.id GROUP BY 1, 2, 3)
  SELECT grp, count(*) AS pairs, round(avg(d), 6) AS diversity FROM p GROUP BY 1""")
def diversity_l1(spark, d):
    cells = bank(spark, d).select(F.col("label").alias("grp"), F.col("id").alias("member"), F.posexplode("px").alias("pos", "v"))
    return texture.diversity(cells, "l1").withColumn("diversity", F.round("diversity", 6))


@query("diversity_rmse", f"""WITH {CELLS}, p AS (SELECT a.label AS grp, a.id, b.id AS m2, sqrt(avg(pow(a.x - b.x, 2))) AS d FROM cells a JOIN cells b ON a.label = b.label AND a.pos = b.pos AND a.id < b.id GROUP BY 1, 2, 3)
  SELECT grp, count(*) AS pairs, round(avg(d), 6) AS diversity FROM p GROUP BY 1""")
def diversity_rmse(spark, d):
    cells = bank(spark, d).select(F.col("label").alias("grp"), F.col("id").alias("member"), F.posexplode("px").alias("pos", "v"))
    return texture.diversity(cells, "rmse").withColumn("diversity", F.round("diversity", 6))


@query("pairwise_correlation", f"""WITH {CELLS} SELECT a.label AS grp, a.id AS a, b.id AS b, round(corr(a.x, b.x), 6) AS corr
  FROM cells a JOIN cells b ON a.label = b.label AND a.pos = b.pos AND a.id < b.id GROUP BY 1, 2, 3""")
def pairwise_correlation(spark, d):
    cells = bank(spark, d).select(F.col("label").alias("grp"), F.col("id").alias("member"), F.posexplode("px").alias("pos", "v"))
    return texture.pairwise_correlation(cells).withColumn("corr", F.round("corr", 6))


_CENTRED = f"WITH {BANK}, m AS (SELECT id, list_transform(px, lambda x: x - list_sum(px) / len(px)) AS px FROM bank), cells AS (SELECT id, unnest(px) AS x, generate_subscripts(px, 1) - 1 AS pos FROM m)"


@query("autocorrelation_8x8", f"""{_CENTRED}, s AS (SELECT unnest(range(64)) AS shift), a AS (SELECT a.id, shift // 8 AS dr, shift % 8 AS dc, sum(a.x * b.x) AS a FROM cells a, s, cells b
    WHERE a.id = b.id AND b.pos = ((a.pos // 8 + shift // 8) % 8) * 8 + (a.pos % 8 + shift % 8) % 8 GROUP BY 1, 2, 3)
  SELECT id, CAST(dr AS INTEGER) AS dr, CAST(dc AS INTEGER) AS dc, round(a / max(a) OVER (PARTITION BY id), 6) AS acf FROM a""")
def autocorrelation(spark, d):
    return texture.autocorrelation(bank(spark, d)).withColumn("acf", F.round("acf", 6))


@query("power_spectrum_8x8", f"""{_CENTRED}, f AS (SELECT id, u, w, sum(x * cos({2 * math.pi / 8} * (u * (pos // 8) + w * (pos % 8)))) AS re, sum(x * sin({2 * math.pi / 8} * (u * (pos // 8) + w * (pos % 8)))) AS im
    FROM cells, (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS w) GROUP BY 1, 2, 3)
  SELECT id, CAST(floor(sqrt(pow((u + 4) % 8 - 4, 2) + pow((w + 4) % 8 - 4, 2))) AS INTEGER) AS radius, round(avg(re * re + im * im), 6) AS power FROM f GROUP BY 1, 2""")
def power_spectrum(spark, d):
    return texture.patch_spectrum(bank(spark, d)).withColumn("power", F.round("power", 6))


def _mirror(axis: str) -> str:
    return "(7 - pos // 8) * 8 + pos % 8" if axis == "r" else "pos // 8 * 8 + 7 - pos % 8"


def _draw(name: str) -> str:
    return U.format(f"'0:{name}:' || id")


_TURNS = "CASE k WHEN 1 THEN (pos % 8) * 8 + 7 - pos // 8 WHEN 2 THEN (7 - pos // 8) * 8 + 7 - pos % 8 WHEN 3 THEN (7 - pos % 8) * 8 + pos // 8 ELSE pos END"
_FLIPS = f"""WITH {CELLS}, a AS (SELECT id, pos, x FROM cells),
  hf AS (SELECT t.id, t.pos, s.x FROM a t JOIN a s ON s.id = t.id AND s.pos = CASE WHEN {_draw('h').replace('id', 't.id')} < 0.5 THEN t.pos // 8 * 8 + 7 - t.pos % 8 ELSE t.pos END),
  vf AS (SELECT t.id, t.pos, s.x FROM hf t JOIN hf s ON s.id = t.id AND s.pos = CASE WHEN {_draw('v').replace('id', 't.id')} < 0.5 THEN (7 - t.pos // 8) * 8 + t.pos % 8 ELSE t.pos END),
  turn AS (SELECT id, pos, CASE WHEN {_draw('rot')} < 0.5 THEN CAST(floor({_draw('k')} * 3) + 1 AS INTEGER) ELSE 0 END AS k FROM vf),
  rot AS (SELECT t.id, t.pos, s.x FROM (SELECT id, pos, {_TURNS} AS src FROM turn) t JOIN vf s ON s.id = t.id AND s.pos = t.src)"""


@query("augment_flip_rotate", f"{_FLIPS} SELECT id, CAST(pos AS INTEGER) AS pos, round(x, 6) AS v FROM rot")
def augment_flip_rotate(spark, d):
    out = augment.augment(bank(spark, d), 8, p_noise=0.0, p_bright=0.0)
    return out.select("id", F.posexplode("px").alias("pos", "v")).select("id", "pos", F.round("v", 6).alias("v"))


_NORMAL = f"""round(sqrt(-2.0 * ln(({U.format("'0:n:a:' || id || ':' || pos")} * 4294967296.0 + 1) / 4294967297.0)) * cos({2 * math.pi} * {U.format("'0:n:b:' || id || ':' || pos")}), 8)"""


@query("augment_full", f"""{_FLIPS}, noisy AS (SELECT id, pos, x + CASE WHEN {_draw('noise')} < 0.3 THEN 0.05 * {_NORMAL} ELSE 0 END AS x FROM rot)
  SELECT id, CAST(pos AS INTEGER) AS pos, round(x * CASE WHEN {_draw('bright')} < 0.3 THEN 0.9 + {_draw('f')} * 0.2 ELSE 1 END, 5) AS v FROM noisy""")
def augment_full(spark, d):
    out = augment.augment(bank(spark, d), 8, noise_sigma=0.05)
    return out.select("id", F.posexplode("px").alias("pos", "v")).select("id", "pos", F.round("v", 5).alias("v"))


_H = 4
_UNIT = " + ".join(f"greatest(0, {j / 10 - 0.15} + list_sum(list_transform(px, lambda x, i: x * (((i - 1) * {_H} + {j}) % 7 - 3)))) * {(-1) ** j * 0.5}" for j in range(_H))


@query("classifier_forward", f"WITH {BANK} SELECT id, round(1 / (1 + exp(-(0.1 + {_UNIT}))), 6) AS p FROM bank")
def classifier_forward(spark, d):
    w1 = F.array(*[F.lit(float(k % 7 - 3)) for k in range(64 * _H)])
    b1, w2 = F.array(*[F.lit(j / 10 - 0.15) for j in range(_H)]), F.array(*[F.lit((-1) ** j * 0.5) for j in range(_H)])
    return bank(spark, d).select("id", F.round(learning.forward(F.col("px"), w1, b1, w2, F.lit(0.1), _H), 6).alias("p"))


@query("patch_statistics", f"WITH {CELLS} SELECT id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM cells GROUP BY 1")
def patch_statistics(spark, d):
    return bank(spark, d).select("id", F.round(expr.mean(F.col("px")), 6).alias("mean"), F.round(expr.std(F.col("px")), 6).alias("std"))


@query("gaussian_window", f"SELECT CAST(i AS INTEGER) AS pos, round(exp(-(pow(i // 8 - 3.5, 2) + pow(i % 8 - 3.5, 2)) / 8) / exp(-0.5 / 8), 8) AS weight FROM range(64) t(i)")
def gaussian_window(spark, d):
    return spark.range(64).select(F.col("id").cast("int").alias("pos"), F.round(F.element_at(F.array(*[F.lit(x) for x in expr.gaussian_window(8)]), (F.col("id") + 1).cast("int")), 8).alias("weight"))
