"""Queries on manifests, splits, guards, experiments and plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import learning, lineage, texture
from .registry import query, table

ROWS = "rows AS (SELECT doc_id AS source_id, source AS group_id FROM documents)"
U = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
TEST = "test AS (SELECT group_id FROM rows GROUP BY 1 HAVING min(source_id) % 5 = 0)"
SPLIT = f"""{ROWS}, {TEST}, rest AS (SELECT group_id, row_number() OVER (ORDER BY {U.format("'0:' || group_id")}, group_id) AS k FROM (SELECT DISTINCT group_id FROM rows) WHERE group_id NOT IN (SELECT group_id FROM test)),
  n AS (SELECT greatest(1, CAST(round_even(count(*) * 0.15::DOUBLE, 0) AS INTEGER)) AS n_val FROM rest),
  named AS (SELECT group_id, CASE WHEN k <= n_val THEN 'validation' ELSE 'train' END AS split FROM rest, n UNION ALL SELECT group_id, 'test' FROM test),
  sp AS (SELECT source_id, group_id, split FROM rows JOIN named USING (group_id))"""


def rows(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("source").alias("group_id"))


def split(spark, d):
    r = rows(spark, d)
    test = r.groupBy("group_id").agg(F.min("source_id").alias("m")).filter("m % 5 = 0").select("group_id")
    return lineage.group_split(r, test, 0.15, 0)


@query("group_split", f"WITH {SPLIT} SELECT source_id, group_id, split FROM sp")
def group_split(spark, d):
    return split(spark, d)


@query("split_leak_check", f"WITH {SPLIT} SELECT count(*) AS groups_in_several FROM (SELECT group_id FROM sp GROUP BY 1 HAVING count(DISTINCT split) > 1)")
def split_leak_check(spark, d):
    return lineage.split_groups(split(spark, d)).agg(F.count("*").alias("groups_in_several"))


@query("pairwise_overlaps", """WITH g AS (SELECT DISTINCT source AS group_id, lang AS split FROM documents)
  SELECT x.split AS a, y.split AS b, count(*) AS n FROM g x JOIN g y USING (group_id) WHERE x.split < y.split GROUP BY 1, 2""")
def pairwise_overlaps(spark, d):
    return lineage.pairwise_overlaps(table(spark, d, "documents").select(F.col("source").alias("group_id"), F.col("lang").alias("split")))


def _guard(kind: str) -> str:
    return f"""WITH {SPLIT}, ids AS (SELECT source_id FROM sp WHERE split = '{kind}'), groups AS (SELECT DISTINCT group_id FROM sp WHERE split = '{kind}'), lin AS (SELECT DISTINCT doc_id AS id FROM labels)
  SELECT id FROM lin WHERE id IN (SELECT source_id FROM ids) OR id IN (SELECT source_id FROM rows JOIN groups USING (group_id))"""


def _lineage(spark, d, kind):
    s = split(spark, d).filter(F.col("split") == kind)
    text = lambda c: F.col(c).cast("string").alias("id")
    group_of = rows(spark, d).select(text("source_id"), "group_id")
    found = lineage.contaminated(table(spark, d, "labels").select(text("doc_id")), s.select(text("source_id")), s.select(F.col("group_id").alias("id")).distinct(), group_of)
    return found.select(F.col("id").cast("long").alias("id"))


@query("lineage_guard", _guard("test"))
def lineage_guard(spark, d):
    return _lineage(spark, d, "test")


@query("holdout_guard", _guard("validation"))
def holdout_guard(spark, d):
    return _lineage(spark, d, "validation")


@query("manifest_split_lookup", f"WITH {SPLIT} SELECT l.doc_id AS source_id, coalesce(split, 'unassigned') AS split, coalesce(split, 'unassigned') <> 'test' AS eligible FROM labels l LEFT JOIN (SELECT * FROM sp WHERE source_id % 3 > 0) s ON s.source_id = l.doc_id")
def manifest_split_lookup(spark, d):
    known = split(spark, d).filter("source_id % 3 > 0")
    return lineage.with_split(table(spark, d, "labels").select(F.col("doc_id").alias("source_id")), known).withColumn("eligible", lineage.eligible(F.col("split")))


@query("manifest_audit", "WITH g AS (SELECT lang AS dataset, source AS group_id, count(*) AS n FROM documents GROUP BY 1, 2) SELECT dataset, CAST(sum(n) AS BIGINT) AS images, count(*) AS n_groups, max(n) AS largest_group FROM g GROUP BY 1")
def manifest_audit(spark, d):
    return lineage.audit(table(spark, d, "documents").select(F.col("lang").alias("dataset"), F.col("source").alias("group_id")))


@query("group_members", "SELECT source AS group_id, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1")
def group_members(spark, d):
    return lineage.members(rows(spark, d)).select("group_id", F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("claim_guard", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\bIt\b')")
def claim_guard(spark, d):
    return lineage.claims(table(spark, d, "documents"), "text", "It").select("doc_id")


@query("pool_union", "SELECT pool, count(*) AS n FROM (SELECT 'labelled' AS pool FROM labels UNION ALL SELECT 'all' FROM documents) GROUP BY 1")
def pool_union(spark, d):
    a = table(spark, d, "labels").select(F.lit("labelled").alias("pool"))
    return a.unionByName(table(spark, d, "documents").select(F.lit("all").alias("pool"))).groupBy("pool").agg(F.count("*").alias("n"))


@query("distinct_groups", "SELECT DISTINCT source AS group_id FROM documents")
def distinct_groups(spark, d):
    return rows(spark, d).select("group_id").distinct()


@query("minus_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def minus_ids(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("intersect_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def intersect_ids(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("histogram_prices", """WITH v AS (SELECT l_returnflag, l_extendedprice::DOUBLE AS v FROM lineitem), e AS (SELECT l_returnflag, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1),
  b AS (SELECT l_returnflag, CAST(least(floor((v - lo) / (hi - lo) * 256), 255) AS INTEGER) AS bin, count(*) AS n FROM v JOIN e USING (l_returnflag) GROUP BY 1, 2),
  f AS (SELECT g.l_returnflag, CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM (SELECT l_returnflag, unnest(range(256)) AS i FROM e) g LEFT JOIN b ON b.l_returnflag = g.l_returnflag AND b.bin = g.i)
  SELECT l_returnflag, bin, n, round(n / sum(n) OVER (PARTITION BY l_returnflag), 8) AS share FROM f""")
def histogram_prices(spark, d):
    return texture.histogram(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", 256).withColumn("share", F.round("share", 8))


@query("histogram_fixed_range", """WITH b AS (SELECT event_type, CAST(least(floor((value::DOUBLE - 10) / 40 * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 10 AND 50 GROUP BY 1, 2),
  f AS (SELECT g.event_type, CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM (SELECT event_type, unnest(range(20)) AS i FROM (SELECT DISTINCT event_type FROM events)) g LEFT JOIN b ON b.event_type = g.event_type AND b.bin = g.i)
  SELECT event_type, bin, n, round(n / nullif(sum(n) OVER (PARTITION BY event_type), 0), 8) AS share FROM f""")
def histogram_fixed_range(spark, d):
    return texture.histogram(table(spark, d, "events"), "event_type", "value", 20, 10.0, 50.0).withColumn("share", F.round("share", 8))


_DESCRIBE = "count({v}) AS n, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std, round(min({v}), 4) AS min, round(quantile_cont({v}, 0.25), 4) AS p25, round(quantile_cont({v}, 0.5), 4) AS p50, round(quantile_cont({v}, 0.75), 4) AS p75, round(max({v}), 4) AS max"


def _rounded(df, keys):
    return df.select(*keys, "n", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query("describe_by_group", f"SELECT source, {_DESCRIBE.format(v='n_chars::DOUBLE')} FROM documents GROUP BY 1")
def describe_by_group(spark, d):
    return _rounded(texture.describe(table(spark, d, "documents"), "source", "n_chars"), ["source"])


@query("describe_frame", f"SELECT {_DESCRIBE.format(v='l_extendedprice::DOUBLE')} FROM lineitem")
def describe_frame(spark, d):
    return _rounded(texture.describe(table(spark, d, "lineitem").withColumn("v", F.col("l_extendedprice").cast("double")), None, "v"), [])


_DRAWS = f"""g AS (SELECT source AS group_id, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1),
  ranked AS (SELECT *, row_number() OVER (ORDER BY group_id) - 1 AS k FROM g), total AS (SELECT count(*) AS groups FROM g),
  draws AS (SELECT r AS replicate, CAST(floor({U.format("'1:' || r || ':' || i")} * groups) AS BIGINT) AS k FROM range(200) t(r), (SELECT groups, unnest(range(groups)) AS i FROM total))"""


def _scored(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("source").alias("group_id"), (F.col("quality") == 1).cast("int").alias("correct"))


@query("bootstrap_groups", f"WITH {_DRAWS} SELECT CAST(replicate AS INTEGER) AS replicate, round(sum(hits) / sum(n), 8) AS accuracy FROM (SELECT DISTINCT * FROM draws) JOIN ranked USING (k) GROUP BY 1")
def bootstrap_groups(spark, d):
    return learning.bootstrap(_scored(spark, d)).withColumn("accuracy", F.round("accuracy", 8))


@query("bootstrap_multiplicity", f"WITH {_DRAWS} SELECT CAST(replicate AS INTEGER) AS replicate, round(sum(hits) / sum(n), 8) AS accuracy FROM draws JOIN ranked USING (k) GROUP BY 1")
def bootstrap_multiplicity(spark, d):
    return learning.bootstrap(_scored(spark, d), multiplicity=True).withColumn("accuracy", F.round("accuracy", 8))


@query("bootstrap_summary", f"WITH {_DRAWS}, a AS (SELECT replicate, sum(hits) / sum(n) AS accuracy FROM (SELECT DISTINCT * FROM draws) JOIN ranked USING (k) GROUP BY 1) SELECT round(avg(accuracy), 8) AS mean_accuracy, round(quantile_cont(accuracy, 0.025), 8) AS low, round(quantile_cont(accuracy, 0.975), 8) AS high FROM a")
def bootstrap_summary(spark, d):
    s = learning.bootstrap_summary(learning.bootstrap(_scored(spark, d)))
    return s.select(*[F.round(c, 8).alias(c) for c in s.columns])


@query("majority_baseline", "SELECT round(greatest(avg(quality), 1 - avg(quality)), 8) AS baseline FROM labels")
def majority_baseline(spark, d):
    return learning.majority_baseline(table(spark, d, "labels"), "quality").withColumn("baseline", F.round("baseline", 8))


@query("verdict", "SELECT o_orderkey, CASE WHEN o_orderkey % 70 / 10.0 - 3.5 >= 2 THEN 'BENEFIT' WHEN o_orderkey % 70 / 10.0 - 3.5 <= -1 THEN 'HARM' ELSE 'INCONCLUSIVE' END AS verdict FROM orders")
def verdict(spark, d):
    return table(spark, d, "orders").select("o_orderkey", learning.verdict(F.col("o_orderkey") % 70 / 10.0 - 3.5).alias("verdict"))


_SWEEP = "s AS (SELECT nullif(o_custkey % 6, 0) AS topk, (o_orderkey % 100) / 1000.0::DOUBLE AS copy_fraction, (o_orderkey % 17) / 2.0::DOUBLE AS diversity, (o_custkey % 31)::DOUBLE AS mean_std FROM orders), by_k AS (SELECT topk, avg(copy_fraction) AS copy_fraction, avg(diversity) AS diversity, avg(mean_std) AS mean_std, count(*) AS runs FROM s WHERE copy_fraction < 0.05 AND diversity > 2 GROUP BY 1)"


@query("sweep_choice", f"WITH {_SWEEP} SELECT coalesce(topk::VARCHAR, 'full') AS topk, round(copy_fraction, 6) AS copy_fraction, round(diversity, 6) AS diversity, round(mean_std, 6) AS mean_std, runs, by_k.topk IS NOT DISTINCT FROM (SELECT topk FROM by_k WHERE topk IS NOT NULL ORDER BY copy_fraction, topk LIMIT 1) AS chosen FROM by_k")
def sweep_choice(spark, d):
    o = table(spark, d, "orders")
    s = o.select(F.nullif(F.col("o_custkey") % 6, F.lit(0)).alias("topk"), (F.col("o_orderkey") % 100 / 1000.0).alias("copy_fraction"), (F.col("o_orderkey") % 17 / 2.0).alias("diversity"), (F.col("o_custkey") % 31).cast("double").alias("mean_std"))
    return learning.sweep_choice(s).select(F.coalesce(F.col("topk").cast("string"), F.lit("full")).alias("topk"), *[F.round(c, 6).alias(c) for c in ("copy_fraction", "diversity", "mean_std")], "runs", "chosen")


@query("seeded_draws", f"""SELECT doc_id, round({U.format("'7:' || doc_id")}, 10) AS u FROM documents""")
def seeded_draws(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(expr.uniform(7, F.col("doc_id")), 10).alias("u"))


@query("geometric_schedule", "SELECT CAST(i AS INTEGER) AS step, round(exp(ln(50.0) + i * (ln(0.5) - ln(50.0)) / 11), 8) AS sigma FROM range(12) t(i)")
def geometric_schedule(spark, d):
    return spark.createDataFrame([(i, s) for i, s in enumerate(expr.geometric_schedule(50.0, 0.5, 12))], "step int, sigma double").withColumn("sigma", F.round("sigma", 8))


@query("luminance", "SELECT p_partkey, round(0.299 * (p_partkey % 256) + 0.587 * (p_partkey * 7 % 256) + 0.114 * (p_partkey * 13 % 256), 6) AS v FROM part")
def luminance(spark, d):
    from ..sources.images import luminance as of

    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.round(of(k % 256, k * 7 % 256, k * 13 % 256), 6).alias("v"))


@query("file_stems", r"SELECT p_partkey, regexp_replace(lower(p_name || '.PNG'), '\.(png|tif|tiff|jpg|jpeg)$', '') AS stem FROM part")
def file_stems(spark, d):
    from ..sources.images import stem

    return table(spark, d, "part").select("p_partkey", stem(F.concat("p_name", F.lit(".PNG"))).alias("stem"))


@query("list_literals", "SELECT c_custkey, (c_custkey % 4)::INTEGER AS instance_count FROM customer")
def list_literals(spark, d):
    from ..sources.datasets import literal_size

    text = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), F.col("c_custkey") % 4 + 1), lambda i: F.concat(F.lit("'"), i.cast("string"), F.lit("'"))), ", "), F.lit("]"))
    trimmed = F.regexp_replace(text, r",? ?'[0-9]+'\]$", "]")
    return table(spark, d, "customer").select("c_custkey", literal_size(trimmed).alias("instance_count"))
