"""Guards, sources and operators on small tables, with the cases that must fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import copying, denoise, grids, learning, lineage, patches, texture, validity
from tessera.sources import datasets, images


def image(spark, a, source="s"):
    return spark.createDataFrame([(source, r, c, float(v)) for (r, c), v in np.ndenumerate(np.asarray(a))], "source_id string, r int, c int, v double")


def array(px):
    p = px.toPandas()
    return p.pivot(index="r", columns="c", values="v").to_numpy()


def test_claims(spark):
    t = spark.createDataFrame([("an electron microscopy image",), ("SEMICONDUCTOR",), ("SEM_x",)], "text string")
    lineage.check_claims(t)
    with pytest.raises(lineage.ModalityClaimError):
        lineage.check_claims(t.union(spark.createDataFrame([("a SEM image",)], "text string")))


def test_lineage_guards(spark):
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    group_of = spark.createDataFrame([("a", "G1"), ("b", "G2"), ("t", "GT")], "id string, group_id string")
    args = (df("t"), df("GT"), group_of)
    lineage.check(df("a", "b"), *args)
    for bad in ("t", "GT"):
        with pytest.raises(lineage.LeakageError, match=bad):
            lineage.check(df("a", bad), *args)
    with pytest.raises(lineage.HoldoutLeakageError):
        lineage.check(df("t2"), df("x"), df("GT"), group_of.union(spark.createDataFrame([("t2", "GT")], group_of.schema)), error=lineage.HoldoutLeakageError)


def test_group_split_invariant(spark):
    rows = lambda *x: spark.createDataFrame(x, "source_id string, group_id string, split string")
    lineage.check_split(rows(("a1", "A", "train"), ("a2", "A", "train"), ("b1", "B", "test")))
    with pytest.raises(lineage.LeakageError):
        lineage.check_split(rows(("a1", "A", "train"), ("a2", "A", "test"), ("b1", None, "test")))


def test_group_split_holds_out_the_share(spark):
    rows = spark.createDataFrame([(f"s{i}", f"g{i % 40}") for i in range(200)], "source_id string, group_id string")
    test = spark.createDataFrame([("g0",), ("g1",)], "group_id string")
    s = lineage.group_split(rows, test, 0.15, 0)
    assert s.count() == 200 and lineage.split_groups(s).isEmpty()
    assert {r["split"]: r["n"] for r in s.groupBy("split").agg(F.count_distinct("group_id").alias("n")).collect()} == {"test": 2, "validation": 6, "train": 32}


def test_empty_synthetic_set_has_no_rate(spark):
    schema = "id long, px array<double>"
    ref = spark.createDataFrame([(1, [float(i) for i in range(64)])], schema)
    assert copying.copying_rate(spark.createDataFrame([], schema), ref).first()["rate"] is None


def test_copying_identical_unrelated_and_flat(spark):
    rng = np.random.default_rng(1)
    mk = lambda a, at=0: spark.createDataFrame([(i + at, [float(v) for v in x]) for i, x in enumerate(a)], "id long, px array<double>")
    a, b = rng.normal(size=(5, 64)), rng.normal(size=(5, 64))
    assert copying.copying_rate(mk(a), mk(a)).first()["rate"] == 1.0
    assert copying.copying_rate(mk(a), mk(b)).first()["rate"] == 0.0
    flat = copying.candidates(mk([np.full(64, 10.0)]), mk([np.full(64, 245.0)]))
    assert flat.count() == 1 and copying.confirmed(mk([np.full(64, 10.0)]), mk([np.full(64, 245.0)])).count() == 0


def test_bands_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4, 64))
    a = np.concatenate([base + rng.normal(0, s, base.shape) for s in (0.02, 0.05, 0.1)])
    mk = lambda x: spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(x)], "id long, px array<double>")
    got = {(r["syn"], r["ref"]) for r in copying.candidates(mk(a), mk(base)).collect()}
    h = lambda x: x > x.mean()
    assert got == {(i, j) for i in range(len(a)) for j in range(4) if (h(a[i]) != h(base[j])).sum() <= 5} and got


def test_patch_cases(spark):
    px = image(spark, np.arange(64).reshape(8, 8))
    masked = px.withColumn("excluded", (F.col("r") < 3) & (F.col("c") < 3))
    p = patches.extract(masked, 4, 2)
    assert p.count() < patches.extract(px, 4, 2).count() and patches.touches_excluded(p, masked, 4).isEmpty()
    assert np.allclose(array(patches.reconstruct(patches.extract(px, 4, 3), 4)), np.arange(64).reshape(8, 8))
    with pytest.raises(ValueError):
        patches.positions(px, 4, 5)
    with pytest.raises(ValueError):
        patches.reconstruct(p, 4, robust_norm=2.0)
    assert patches.extract(image(spark, np.zeros((3, 3))), 4, 2).isEmpty()


def test_all_masked_image_stays(spark):
    px = image(spark, [[1, 2], [3, 4]]).withColumn("excluded", F.lit(True))
    assert np.array_equal(array(grids.median_fill(px)), [[1, 2], [3, 4]])


def test_flat_image_statistics(spark):
    px = image(spark, np.full((8, 8), 100.0))
    assert texture.gradient_histogram(px).filter("bin = 0").first()["share"] == 1.0
    assert texture.histogram(px, "source_id", "v", 4).agg(F.sum("n")).first()[0] == 64


def test_displacement_of_a_moved_image(spark):
    a = np.random.default_rng(4).normal(size=(40, 40))
    px = image(spark, a)
    labels = px.withColumn("instance", F.when(F.col("r").between(18, 20) & F.col("c").between(18, 20), 1).otherwise(0))
    assert validity.displacement(px, labels, px, 8, 6).first()["displacement"] == 0.0
    moved = image(spark, np.roll(a, (3, -2), (0, 1)))
    got = validity.displacement(px, labels, moved, 8, 6).first()
    assert abs(got["displacement"] - np.sqrt(13)) < 1e-9 and got["score"] > 0.999


def test_tiles_of_many_blocks_agree_with_one(spark):
    rng = np.random.default_rng(5)
    b = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(50, 4)))], "id long, px array<double>")
    one = denoise.nearest(b, b, 3).orderBy("query", "rank").collect()
    old, denoise.BLOCK = denoise.BLOCK, 8
    try:
        many = denoise.tiles(b, b, lambda q, r: {"query": q.column("id").to_numpy(), "n": np.full(q.num_rows, r.num_rows)}, "query long, n long", 8)
        assert {r[0] for r in many.groupBy("query").agg(F.sum("n").alias("n")).select("n").collect()} == {50}
    finally:
        denoise.BLOCK = old
    assert [(r["query"], r["rank"]) for r in one] == [(i, k) for i in range(50) for k in (1, 2, 3)]


def test_verdict_edges(spark):
    d = spark.createDataFrame([(2.0,), (1.99,), (-1.0,), (-0.99,)], "d double")
    assert [r[0] for r in d.select(learning.verdict(F.col("d"))).collect()] == ["BENEFIT", "INCONCLUSIVE", "HARM", "INCONCLUSIVE"]


def test_files(spark, tmp_path):
    a = np.random.default_rng(6).integers(0, 65535, (5, 4)).astype(np.uint16)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A1.PNG").write_bytes(images.encode_png(a))
    (tmp_path / "in" / "notes.txt").write_text("x")
    files = images.scan(spark, str(tmp_path / "in"))
    px = images.read_pixels(files, "labels")
    assert [r["source_id"] for r in files.collect()] == ["a1"] and np.array_equal(array(px), a)
    out = images.write_png(px.withColumn("v", F.col("v") / 256), str(tmp_path / "out")).first()["path"]
    assert np.array_equal(images.decode_png(open(out, "rb").read()), a // 256)
    (tmp_path / "m.csv").write_text("filename,doi,regions\na1.png,10.1/x,\"['p', 'q']\"\nb2.png,10.1/y,\n")
    assert [tuple(r) for r in datasets.read_metadata(spark, str(tmp_path / "m.csv")).orderBy("source_id").collect()] == [("a1", "10.1/x", 2), ("b2", "10.1/y", 0)]
    split = spark.createDataFrame([("a1", "10.1/x", "train"), ("b2", "10.1/y", "test")], "source_id string, group_id string, split string")
    datasets.write_split(split, str(tmp_path / "split"), 0, 0.15)
    assert sorted(map(tuple, datasets.read_split(spark, str(tmp_path / "split")).collect())) == sorted(map(tuple, split.collect()))
    datasets.write_csv(split, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_manifest(spark, tmp_path):
    (tmp_path / "i").mkdir()
    for n in ("a1", "b2"):
        (tmp_path / "i" / f"{n}.png").write_bytes(images.encode_png(np.random.default_rng(7).integers(0, 255, (20, 20)).astype(np.uint8)))
    meta = spark.createDataFrame([("a1", "G1", 3), ("b2", "G2", 0)], "source_id string, group_id string, instance_count int")
    split = spark.createDataFrame([("a1", "train")], "source_id string, split string")
    other = datasets.intensity_rows(spark.createDataFrame([("/d/set1/set1_cex_noise_000_contrast_100.tiff",), ("/d/set6/set6_cex_noise_000_contrast_100.tiff",), ("/d/set4/x.tiff",)], "path string"))
    m = datasets.build_manifest(spark, meta, images.scan(spark, str(tmp_path / "i")), split, [other])
    assert {(r["source_id"], r["split"], r["height"]) for r in m.collect()} == {("a1", "train", 20), ("b2", "unassigned", 20), ("set1", "train", 0), ("set6", "test", 0)}
    with pytest.raises(ValueError):
        datasets.check_set("set4")
    with pytest.raises(lineage.LeakageError):
        datasets.check_set("set6")


def test_fields(spark):
    fields = spark.createDataFrame([("f1", "F"), ("f2", "F")], "source_id string, field_id string")
    rows = datasets.field_rows(spark.createDataFrame([("/r/images/f1.tif",), ("/r/ANP_3/q.tif",)], "path string"), fields)
    assert [(r["group_id"], r["split"], r["modality_claim"]) for r in rows.collect()] == [("F", "test", "SEM")]
    with pytest.raises(Exception, match="unknown source"):
        datasets.field_of(spark.createDataFrame([("zz",)], "source_id string"), fields).collect()


def test_stream_of_arrivals(spark, tmp_path):
    from tessera.streaming import arrivals

    (tmp_path / "x.png").write_bytes(images.encode_png(np.zeros((2, 2), np.uint8)))
    q = arrivals(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").start()
    q.processAllAvailable()
    q.stop()
    assert [r["source_id"] for r in spark.table("arrived").collect()] == ["x"]


def test_command_line(spark, tmp_path, capsys):
    from tessera.plans import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(images.encode_png(np.random.default_rng(8).integers(0, 255, (48, 48)).astype(np.uint8)))
    cli.main(["generate", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out"), "--downscale", "0.5", "--num-scales", "2", "--num-steps-per-scale", "2"])
    assert images.decode_png((tmp_path / "out" / "a.png").read_bytes()).shape == (24, 24)
    cli.main(["sweep", str(tmp_path / "in"), "--output", str(tmp_path / "s"), "--seeds", "0", "1", "--topk-grid", "2", "99999", "--num-scales", "2", "--downscale", "0.5", "--num-steps-per-scale", "2"])
    assert spark.read.json(str(tmp_path / "s")).count() == 2


def test_noise_levels_of_table_and_kernel_agree(spark):
    from tessera.functions import kernels

    bank = np.random.default_rng(5).normal(100, 20, (40, 3, 3))
    rows = spark.createDataFrame([(i, x.ravel().tolist()) for i, x in enumerate(bank)], "id long, px array<double>")
    found = denoise.sigma_range(rows, pairs=300, seed=4).first()
    assert np.allclose(tuple(found), kernels.sigma_range(bank, pairs=300, seed=4))


def test_guarded_loads(spark, tmp_path):
    shapes = {"a": (4, 3), "b": (2, 2), "t": (2, 3)}
    for name, shape in shapes.items():
        (tmp_path / f"{name}.png").write_bytes(images.encode_png(np.full(shape, 300 + len(name), np.uint16)))
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    group_of = spark.createDataFrame([("a", "g1"), ("b", "g2"), ("t", "gt")], "id string, group_id string")
    files = images.scan(spark, str(tmp_path))
    seen = files.filter("source_id <> 't'")
    for load in (datasets.load_sources, datasets.load_segmaps):
        assert load(seen, ids("a", "b", "t"), ids("t"), ids("gt"), group_of).count() == 16
        with pytest.raises(lineage.LeakageError):
            load(files, ids("a", "b", "t"), ids(), ids("gt"), group_of)
        with pytest.raises(ValueError):
            load(seen, ids("a"), ids("t"), ids("gt"), group_of)
    labels = datasets.load_segmaps(seen, ids("a", "b"), ids(), ids(), group_of)
    assert labels.agg(F.max("v")).first()[0] == 301


def test_measures_fill_the_manifest(spark):
    rows = datasets.as_manifest(spark.createDataFrame([("f", "g"), ("h", "g")], "source_id string, group_id string"), "RODARE", "SEM")
    lab = image(spark, [[5, 0, 5], [5, 0, 0], [0, 7, 7]], "f")
    got = {r["source_id"]: r for r in datasets.with_measures(rows, image(spark, np.arange(9).reshape(3, 3) * 20, "f"), lab, connected=True).collect()}
    assert (got["f"]["instance_count"], got["f"]["height"], got["f"]["width"]) == (3, 3, 3) and got["h"]["height"] == 0
    assert datasets.with_measures(rows, labels=lab).filter("source_id = 'f'").first()["instance_count"] == 2


def test_arms_learn_the_same_whatever_the_ranges(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    rows = [(a, i, [float(v) for v in x[i]], int(x[i, 0] > 0)) for a in ("a", "b") for i in range(60)]
    pools = spark.createDataFrame(rows, "arm string, id long, px array<double>, y int")
    whole = {r["arm"]: r for r in learning.train_arms(pools, steps=50, batch=8, hidden=3).collect()}
    direct = learning.train(x, (x[:, 0] > 0).astype(float), steps=50, batch=8, hidden=3)
    assert np.allclose(whole["a"]["w1"], direct.w1.ravel()) and np.allclose(whole["b"]["b1"], direct.b1)
    parts = {r["arm"]: r for r in learning.train_arms(pools, steps=50, batch=8, hidden=3, rows_a_range=16).collect()}
    assert set(parts) == {"a", "b"} and parts["a"]["w1"] == parts["b"]["w1"]


def test_places_by_ranges_of_ids(spark):
    df = spark.range(0, 3000, 3).withColumn("x", F.lit(1)).repartition(7)
    for n in (64, 1_000_000):
        rows = {r["id"]: r["i"] for r in denoise.numbered(df, rows_a_range=n).collect()}
        assert rows == {3 * k: k for k in range(1000)}


def test_diversity_by_blocks_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(30, 6))
    rows = [("g", k, p, float(m[k, p])) for k in range(30) for p in range(6) if (k, p) != (4, 2)] + [("alone", 1, 0, 1.0)]
    df = spark.createDataFrame(rows, "grp string, member long, pos int, v double")
    m[4, 2] = np.nan
    want = np.mean([np.sqrt(np.nanmean((m[a] - m[b]) ** 2)) for a in range(30) for b in range(a)])
    for block in (4, 256):
        (r,) = texture.diversity(df, "rmse", block).collect()
        assert (r["grp"], r["pairs"]) == ("g", 435) and abs(r["diversity"] - want) < 1e-12


@pytest.mark.parametrize("offset", [0.0, 1e4, 1e160])
def test_bounded_search_is_that_of_all_distances(offset):
    rng = np.random.default_rng(11)
    b = rng.normal(size=(700, 6)) + offset
    b[5:9] = b[4]
    q = np.concatenate([b[:50], rng.normal(size=(100, 6)) + offset])
    q[60] = np.nan
    bi, qi = rng.permutation(700), np.arange(150)
    with np.errstate(over="ignore", invalid="ignore"):
        d = ((q[:, None] - b[None]) ** 2).sum(axis=2)
    d[qi[:, None] == bi[None]] = np.inf
    want = [(i, bi[j]) for i in range(150) for j in np.lexsort((bi, d[i]))[:5] if np.isfinite(d[i, j])]
    row, col, value = denoise.least_pairs(q, b, qi, bi, 5, skip_same=True)
    assert list(zip(row, bi[col], strict=True)) == want and np.allclose(value, d[row, col], rtol=1e-12)
    scale = rng.uniform(1e-8, 2, 700)
    d = np.sqrt(((q[:60, None] - b[None]) ** 2).sum(axis=2)) / scale
    row, col, value = denoise.least_pairs(q[:60], b, qi[:60], bi, 1, scale)
    assert list(bi[col]) == [bi[np.lexsort((bi, x))[0]] for x in d]


def test_blocks_grow_with_the_table():
    assert [denoise.blocks(n) for n in (0, 2048, 10_000, 102_564, 615_384)] == [1, 1, 5, 8, 19]


def test_weights_collapse_in_one_pass(spark):
    x = np.random.default_rng(12).normal(size=(40, 4))
    b = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, px array<double>")
    got = {(r["query"], r["sigma"]): r["top_weight"] for r in denoise.weight_collapse(b, b, (1.0, 0.2)).collect()}
    plan = denoise.weight_collapse(b, b, (1.0, 0.2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1
    for i in range(40):
        d = np.delete(((x[i] - x) ** 2).sum(axis=1), i)
        for s in (1.0, 0.2):
            assert abs(got[i, s] - 1 / np.exp(-(d - d.min()) / (2 * s * s)).sum()) < 1e-12


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_dealt_once_and_never_sent_to_all(spark):
    px = image(spark, np.random.default_rng(13).normal(size=(12, 10)))
    found = [grids.pad_reflect(px, 3), grids.resize_bilinear(px, 0.6), grids.gaussian_blur(px, 1.0), grids.local_variance(px), grids.sobel(px), patches.extract(px, 8, 5), patches.counts(px.withColumn("excluded", F.lit(False)), 8, 5)]
    for df in found:
        plan = plan_of(df)
        assert plan.count("Exchange") == 1 and "Join" not in plan and df.count() > 0
    for norm in (None, 0.8):
        plan = plan_of(patches.reconstruct(patches.extract(px, 8, 5), 8, robust_norm=norm))
        assert plan.count("Exchange") == 2 and "Join" not in plan


def test_filters_of_images_with_gaps(spark):
    a = np.random.default_rng(14).normal(size=(6, 5))
    rows = [("s", r, c, None if (r, c) == (2, 2) else float(a[r, c])) for r in range(6) for c in range(5) if (r, c) != (4, 1)]
    px = spark.createDataFrame(rows, "source_id string, r int, c int, v double")
    got = {(x["r"], x["c"]): x["v"] for x in grids.gaussian_blur(px, 0.25).collect()}
    weights = {-1: None, 0: None, 1: None}
    from tessera.functions import expr

    weights = dict(zip((-1, 0, 1), expr.gaussian_kernel_weights(0.25), strict=True))
    edge = lambda i, n: -i - 1 if i < 0 else 2 * n - 1 - i if i >= n else i
    v = {(r, c): x for _, r, c, x in rows}
    one = {}
    for r, c in v:
        near = [(k, v.get((edge(r + d, 6), c))) for d, k in weights.items()]
        one[r, c] = sum(k * x for k, x in near if x is not None)
    want = {(r, c): sum(k * one[r, edge(c + d, 5)] for d, k in weights.items() if (r, edge(c + d, 5)) in one) for r, c in v}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {(x["row"], x["col"]) for x in patches.extract(px, 3, 3).collect()} == {(0, 0), (0, 2), (3, 2)}
    assert [x for x in patches.extract(px, 3, 3).filter("row = 0 and col = 2").first()["px"]].count(None) == 1


def test_band_is_counted_and_weighed_without_pairs(spark):
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(size=(60, 4)), np.full((40, 4), 0.25), [[50.0] * 4]])
    mk = lambda a: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(a)], "id long, px array<double>")
    q, b = np.concatenate([x[:70] + 0.01, [[9.0] * 4]]), x
    qm, bm = ((a[:, 0] + a[:, 1] + a[:, 2] + a[:, 3]) / 4 for a in (q, b))
    within = lambda t: np.abs(qm[:, None] - bm[None]) <= t
    tolerances = (100.0, 0.01, 0.0, -1.0, float(abs(qm[0] - bm[7])))
    got = {(r["query"], r["tolerance"]): r["n"] for r in denoise.band_counts(mk(q), mk(b), tolerances).collect()}
    assert got == {(i, t): int(n) for t in tolerances for i, n in enumerate(within(t).sum(axis=1))}
    total = {r["tolerance"]: r["candidates"] for r in denoise.candidate_counts(mk(q), mk(b), tolerances).collect()}
    assert total == {t: int(np.where((n := within(t).sum(axis=1)) == 0, len(b), n).sum()) for t in tolerances}
    found = {(r["query"], r["pos"]): (r["candidates"], r["v"]) for r in denoise.prefiltered_softmax(mk(q), mk(b), 0.7, 0.02).collect()}
    for i in range(len(q)):
        c = within(0.02)[i] if within(0.02)[i].any() else np.ones(len(b), bool)
        d = ((q[i] - b[c]) ** 2).sum(axis=1)
        w = np.exp(-(d - d.min()) / (2 * 0.49))
        assert all(found[i, p][0] == c.sum() and abs(found[i, p][1] - (w @ b[c])[p] / w.sum()) < 1e-12 for p in range(4))


def test_band_tiles_are_those_that_meet(spark):
    rows = [(i, [float(i)] * 2) for i in range(400)]
    b = denoise._means(spark.createDataFrame(rows, "id long, px array<double>"))
    part = denoise.band_tiles(b, b, 5.0, lambda q, r: {"n": [q.num_rows * r.num_rows]}, "n long", 20).agg(F.sum("n")).first()[0]
    assert 400 * 11 - 30 <= part < 400 * 80


def test_correlation_by_blocks_is_that_of_all_pairs(spark):
    m = np.random.default_rng(16).normal(size=(25, 6))
    for gaps in (False, True):
        rows = [("g", k, p, float(m[k, p])) for k in range(25) for p in range(6) if not gaps or (k, p) != (4, 2)]
        df = spark.createDataFrame(rows, "grp string, member long, pos int, v double")
        for block in (4, 1024):
            found = texture.pairwise_correlation(df, block)
            assert "Join" not in plan_of(found).split("FlatMapCoGroups")[0]
            got = {(r["a"], r["b"]): r["corr"] for r in found.collect()}
            use = lambda a, b: np.delete(np.arange(6), 2) if gaps and 4 in (a, b) else np.arange(6)
            assert set(got) == {(a, b) for b in range(25) for a in range(b)}
            assert all(abs(v - np.corrcoef(m[a, use(a, b)], m[b, use(a, b)])[0, 1]) < 1e-12 for (a, b), v in got.items())


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_percentiles_of_all_rows_by_brackets(spark, accuracy):
    rng = np.random.default_rng(17)
    for x in (rng.normal(size=2001), rng.integers(0, 4, 1000).astype(float), np.array([3.5]), np.zeros(0)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        got = texture.describe(df, None, "v", accuracy).first()
        want = df.agg(*[F.percentile("v", F.lit(p / 100)).alias(f"p{p}") for p in (25, 50, 75)]).first()
        assert got["n"] == len(x) and all(got[p] == want[p] or abs(got[p] - want[p]) < 1e-12 for p in ("p25", "p50", "p75"))


@pytest.mark.parametrize(("sigma", "far"), [(1.0, 0.0), (0.02, 0.0), (1.0, 1e6)])
def test_weights_of_a_pair_of_blocks_serve_both_ways(sigma, far, monkeypatch):
    # In several chunks; with one shift for all, with a running one (0.02), and by direct differences (1e6).
    monkeypatch.setattr(denoise, "CHUNK", 16)
    rng = np.random.default_rng(15)
    a, b = (rng.normal(size=(n, 4)) for n in (70, 50))
    b[0] += far
    same = (np.array([3, 69]), np.array([40, 2]))
    d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    both = denoise._weight_sums(a, b, same, sigma, twice=True, step=32)
    assert (both is None) == (sigma < 1 or far > 0)
    d[same] = np.inf
    for (low, sums, n), x, y, e in zip(both or denoise._weight_sums(a, b, same, sigma, step=32), (a, b), (b, a), (d, d.T), strict=False):
        w = np.exp(-(e - e.min(axis=1, keepdims=True)) / (2 * sigma * sigma))
        assert np.allclose(low, e.min(axis=1), rtol=1e-11) and np.allclose(sums[:, -1], w.sum(axis=1), rtol=1e-10) and (n == len(y)).all()
        assert np.allclose(sums[:, :-1], w @ y, rtol=1e-10, atol=1e-10)


@pytest.mark.parametrize("sigma", [1.0, 0.02])
def test_a_bank_weighs_each_pair_of_its_own_once(spark, sigma, monkeypatch):
    monkeypatch.setattr(denoise, "BLOCK", 16)
    x = np.random.default_rng(16).normal(size=(60, 4))
    b = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, px array<double>")
    seen = denoise.pair_tiles(b, lambda q, r: {"qb": q.column("qb").to_numpy()[:1], "bb": r.column("bb").to_numpy()[:1], "n": [q.num_rows * r.num_rows]}, "qb int, bb int, n long", 16).collect()
    assert all(r["qb"] <= r["bb"] for r in seen) and sum(r["n"] * (1 + (r["qb"] < r["bb"])) for r in seen) == 3600
    got = {r["query"]: r for r in denoise.softmax_full(b, b, sigma).collect()}
    for i in range(60):
        d = ((x[i] - x) ** 2).sum(axis=1)
        d[i] = np.inf
        w = np.exp(-(d - d.min()) / (2 * sigma * sigma))
        assert np.allclose(got[i]["px"], w @ x / w.sum(), rtol=1e-11) and abs(got[i]["top_weight"] - 1 / w.sum()) < 1e-11
