"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources get word targets by weight, capped at a number of epochs. Each source's
documents, in the order of a seeded hash, are a random permutation that is cut
into blocks of about ``block_words`` words. Its exact quota is a number of
blocks: all of them for every full epoch, then blocks in a permuted order, the
last of which is taken in part, and the block of one document that fills the
rest. A binary tree over the output shards splits the vector of all quotas, at
every node by a multivariate hypergeometric draw, down to a quota for each
source and shard. Each shard then draws its number of the source's permuted
blocks, disjoint from every other shard's, and shuffles its documents locally
by a seeded key. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, unit

#: Buckets of the hash order that are summed before a cut is looked for inside one of them.
RADIX_BITS = 14


#: What a dealt block stands for: all its documents, those of the epoch's last block that are in, or one document.
WHOLE, PART, EXTRA = 0, 1, 2


def _bucket(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed.bitwiseXOR(F.lit(-(2**63))), 64 - RADIX_BITS).cast("int")


def _log_gamma(z: Column) -> Column:
    """ln gamma for z >= 1: Stirling's series seven steps further on, error below 1e-12."""
    y = z + 7.0
    down = z
    for k in range(1, 7):
        down = down * (z + float(k))
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - F.ln(down)


def hypergeometric(u: Column, good: Column, total: Column, draws: Column) -> Column:
    """How many of ``draws`` from ``total`` are among its ``good`` ones, for a uniform ``u``.

    Inverts the distribution by going out from its mode on both sides, for as
    far as any mass that a double can hold (14 standard deviations and 60).
    """
    g, n, d = (c.cast("double") for c in (good, total, draws))
    low, high = F.greatest(F.lit(0.0), d + g - n), F.least(d, g)
    mode = F.least(high, F.greatest(low, F.floor((d + 1) * (g + 1) / (n + 2)).cast("double")))
    given = F.array(F.struct(u.alias("u"), g.alias("g"), n.alias("n"), d.alias("d"), low.alias("low"), high.alias("high"), mode.alias("m")))

    def invert(a: Column) -> Column:
        lg = F.transform(
            F.array(a["g"], a["m"], a["g"] - a["m"], a["n"] - a["g"], a["d"] - a["m"], a["n"] - a["g"] - a["d"] + a["m"], a["n"], a["d"], a["n"] - a["d"]),
            lambda v: _log_gamma(v + 1.0),
        )
        peak = F.exp(lg[0] - lg[1] - lg[2] + lg[3] - lg[4] - lg[5] - lg[6] + lg[7] + lg[8])
        spread = F.sqrt(F.greatest(F.lit(1.0), a["d"] * a["g"] / F.greatest(a["n"], F.lit(1.0))))
        steps = F.least(F.ceil(spread * 14 + 60), F.greatest(F.lit(1).cast("long"), (a["high"] - a["low"]).cast("long")))
        start = F.struct((a["u"] - peak).alias("left"), a["m"].alias("x"), a["m"].alias("xu"), peak.alias("pu"), a["m"].alias("xd"), peak.alias("pd"))

        def walk(s: Column, _: Column) -> Column:
            up = s["xu"] < a["high"]
            pu = F.when(up, s["pu"] * (a["g"] - s["xu"]) * (a["d"] - s["xu"]) / ((s["xu"] + 1) * F.greatest(F.lit(1.0), a["n"] - a["g"] - a["d"] + s["xu"] + 1))).otherwise(0.0)
            xu = F.when(up, s["xu"] + 1).otherwise(s["xu"])
            down = s["xd"] > a["low"]
            pd = F.when(down, s["pd"] * s["xd"] * (a["n"] - a["g"] - a["d"] + s["xd"]) / ((a["g"] - s["xd"] + 1) * (a["d"] - s["xd"] + 1))).otherwise(0.0)
            xd = F.when(down, s["xd"] - 1).otherwise(s["xd"])
            x = F.when(s["left"] <= 0, s["x"]).when(s["left"] - pu <= 0, xu).when(s["left"] - pu - pd <= 0, xd).otherwise(s["x"])
            left = F.when(s["left"] <= 0, s["left"]).otherwise(s["left"] - pu - pd)
            return F.struct(left.alias("left"), x.alias("x"), xu.alias("xu"), pu.alias("pu"), xd.alias("xd"), pd.alias("pd"))

        return F.aggregate(F.sequence(F.lit(1).cast("long"), steps), start, walk)["x"].cast("long")

    return F.when(draws <= 0, F.lit(0).cast("long")).when(good >= total, draws).otherwise(F.transform(given, invert)[0])


def splitting_tree(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """``quotas`` (one row, ``counts array<long>``) split to rows (shard int, counts array<long>).

    Shards differ by one block at most in their total; each source's counts add
    up to its quota exactly.
    """
    nodes = quotas.select(F.lit(0).alias("shard"), F.lit(n_shards).alias("width"), "counts")
    while n_shards > 1:
        left_width = F.floor(F.col("width") / 2).cast("int")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
        nodes = nodes.withColumns({"__half": left_width, "__total": total, "__draws": F.floor(total * left_width / F.col("width")).cast("long")})
        start = F.struct(F.array().cast("array<long>").alias("out"), F.col("__total").alias("n"), F.col("__draws").alias("d"))

        def draw(s: Column, c: Column) -> Column:
            u = unit(F.xxhash64(F.lit(seed), F.col("shard"), F.col("width"), F.size(s["out"])))
            x = hypergeometric(u, c, s["n"], s["d"])
            return F.struct(F.concat(s["out"], F.array(x)).alias("out"), (s["n"] - c).alias("n"), (s["d"] - F.element_at(F.array(x), 1)).alias("d"))

        nodes = nodes.withColumn("__left", F.when(F.col("width") > 1, F.aggregate("counts", start, draw)["out"]).otherwise(F.col("counts")))
        left = F.struct(F.col("shard"), F.greatest(F.col("__half"), F.lit(1)).alias("width"), F.col("__left").alias("counts"))
        right = F.struct((F.col("shard") + F.col("__half")).alias("shard"), (F.col("width") - F.col("__half")).alias("width"), F.zip_with("counts", "__left", lambda c, x: c - x).alias("counts"))
        nodes = nodes.select(F.explode(F.when(F.col("width") > 1, F.array(left, right)).otherwise(F.array(left))).alias("n")).select("n.*")
        nodes = cut(nodes, "tree")
        n_shards = (n_shards + 1) // 2
    return nodes.select("shard", "counts")


def _targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size) with weight and target: lambda * weight, up to max_epochs sizes."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sizes.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumns({"cap": F.col("source_size").cast("double") * max_epochs, "all": F.sum("source_size").over(Window.partitionBy()) * F.lit(share)})
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, onward = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # From the first source whose cap isn't reached on, all share the same level.
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(Window.partitionBy())["level"])
    return s.select("source", "source_size", "rank", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(df: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_epochs: int = 3, n_shards: int = 16, block_words: int = 50_000, seed: int = 5, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row of ``df`` with what the mix takes of it.

    Adds ``size`` (words), ``source_size``, ``target`` (of its source, words),
    ``copies`` (0 to ``max_epochs``), ``taken`` (words) and ``placements`` (the
    output shard of each copy). A document's copies are those of the dealt
    blocks that hold it; whole documents are taken, and of the one block in
    part the first by hash and the one more that comes nearest to the target. A null source is a source of its own;
    null and empty texts have no words, and only their copies count. Rows with
    the same key and text are taken together. Input columns of the added names
    are replaced; an empty table gives an empty result; reruns agree.
    """
    added = ("size", "source_size", "target", "copies", "taken", "placements")
    base = fresh(df, *added, "__h", "__src", "__blk", "__rank", "__stop", "__extra", "__homes")
    rows = base.withColumns({
        "size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"),
        "__h": F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(F.col(text))),
        "__src": F.struct(F.col(source).cast("string").alias("source")),
    })
    light = cut(rows.select(F.col("__src.source").alias("source"), F.col("size"), F.col("__h").alias("h")), "mix-rows")
    sources = _targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    some = F.col("source_size") > 0
    sources = sources.withColumns({
        "full": F.when(some, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size") + 1e-12))).otherwise(0).cast("int"),
        "blocks": F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(block_words))).cast("long"),
    })
    sources = cut(sources.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("source_size"))), "mix-sources")
    of_source = lambda table, name="source": F.col(f"{table}.{name}").eqNullSafe(F.col("s.source"))
    place = lambda h, n: F.least(n - 1, F.floor(unit(h) * n)).cast("long")
    turn = lambda epoch: F.xxhash64(F.lit(seed + 1), "rank", "block", epoch)
    light = light.alias("l").join(sources.alias("s"), of_source("l")).select("rank", "h", "size", "full", "rest", place(F.col("h"), F.col("blocks")).alias("block")).withColumn("k", turn(F.col("full")))

    # Quotas: all blocks of the full epochs, then whole blocks in permuted order up to the target, and one in part.
    blocks = cut(light.groupBy("rank", "block", "full", "rest", "k").agg(F.sum("size").alias("words")), "mix-blocks")
    last = blocks.filter("rest > 0").withColumn("bucket", _bucket(F.col("k")))
    edge = last.groupBy("rank", "rest", "bucket").agg(F.sum("words").alias("words"))
    edge = edge.withColumn("before", F.sum("words").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("words"))
    edge = cut(edge.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select("rank", "bucket", "before"), "mix-edge")
    inside = last.join(edge, ["rank", "bucket"]).withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("rank").orderBy("k", "block")))
    first = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("k", "block", (F.col("rest") - F.col("upto") + F.col("words")).alias("gap"))))
    ends = cut(inside.groupBy("rank").agg(first.alias("e")).select("rank", F.col("e.k").alias("stop_k"), F.col("e.block").alias("part"), F.col("e.gap").alias("gap")), "mix-ends")
    # Of the block in part the documents before stop_h; then the one document more that comes nearest to the target.
    docs = light.join(ends, "rank").filter((F.col("rest") > 0) & (F.col("k") >= F.col("stop_k")))
    split = docs.filter(F.col("block") == F.col("part")).groupBy("rank", "h", "gap").agg(F.sum("size").alias("size"))
    split = split.withColumn("upto", F.sum("size").over(Window.partitionBy("rank").orderBy("h")))
    split = split.groupBy("rank").agg(F.min(F.when(F.col("upto") > F.col("gap"), F.struct("h", (F.col("gap") - F.col("upto") + F.col("size")).alias("left")))).alias("e"))
    split = cut(split.select("rank", F.col("e.h").alias("stop_h"), F.col("e.left").alias("left")), "mix-split")
    spare = docs.join(split, "rank").filter((F.col("block") != F.col("part")) | (F.col("h") >= F.col("stop_h")))
    spare = spare.groupBy("rank", "block", "h", "left").agg(F.sum("size").alias("size")).filter((F.col("size") > 0) & (F.abs(F.col("left") - F.col("size")) < F.col("left")))
    spare = spare.groupBy("rank").agg(F.min(F.struct(F.abs(F.col("left") - F.col("size")).alias("off"), "h", "block")).alias("e")).select("rank", F.col("e.h").alias("extra_h"), F.col("e.block").alias("extra"))
    plan = sources.join(ends, "rank", "left").join(split, "rank", "left").join(spare, "rank", "left")
    plan = cut(plan.select("source", "source_size", "target", "rank", "blocks", "full", "rest", "stop_k", "part", "stop_h", "extra_h", "extra"), "mix-plan")

    # The quota's blocks in a permutation of each source, and the tree that deals them out.
    known = blocks.select("rank", "block", "k").join(plan.select("rank", "full", "rest", "stop_k", "part", "extra"), "rank")
    whole = (F.col("rest") > 0) & (F.col("stop_k").isNull() | (F.col("k") < F.col("stop_k")))
    kind = lambda n, epoch: F.struct(F.lit(n).alias("kind"), epoch.alias("epoch"))
    full = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("full") - 1)), lambda e: kind(WHOLE, e))).otherwise(F.array().cast("array<struct<kind:int,epoch:int>>"))
    more = [(WHOLE, whole), (PART, F.col("block") == F.col("part")), (EXTRA, F.col("block") == F.col("extra"))]
    rest = F.array(*[F.when(F.coalesce(c, F.lit(False)), kind(n, F.col("full"))) for n, c in more])
    drawn = known.select("rank", "block", F.explode(F.concat(full, F.filter(rest, lambda x: x.isNotNull()))).alias("x")).select("rank", "block", "x.kind", "x.epoch")
    drawn = drawn.withColumn("turn", F.xxhash64(F.lit(seed + 2), "rank", "block", "epoch", "kind")).withColumn("bucket", _bucket(F.col("turn")))
    drawn = cut(drawn, "mix-drawn")
    ahead = drawn.groupBy("rank", "bucket").agg(F.count("*").alias("n"))
    ahead = cut(ahead.select("rank", "bucket", (F.sum("n").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("n")).alias("ahead")), "mix-ahead")
    here = Window.partitionBy("rank", "bucket").orderBy("turn", "block", "epoch", "kind")
    drawn = drawn.join(ahead, ["rank", "bucket"]).withColumn("draw", F.col("ahead") + F.row_number().over(here))
    counts = sources.join(drawn.groupBy("rank").agg(F.count("*").alias("n")), "rank", "left").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("c"))
    leaves = splitting_tree(counts.select(F.col("c.n").alias("counts")), n_shards, seed + 2)
    leaves = leaves.select("shard", F.posexplode("counts").alias("p", "n")).select("shard", (F.col("p") + 1).alias("rank"), "n")
    leaves = cut(leaves.withColumn("upto", F.sum("n").over(Window.partitionBy("rank").orderBy("shard"))).filter("n > 0"), "mix-leaves")
    dealt = drawn.join(leaves, "rank").filter((F.col("draw") <= F.col("upto")) & (F.col("draw") > F.col("upto") - F.col("n")))
    homes = cut(dealt.groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "kind", "shard"))).alias("homes")), "mix-homes")

    # A document goes where its block has been dealt.
    here = plan.select(F.col("source").alias("of"), F.struct("source_size", "target", "rank", "blocks", "stop_h", "extra_h").alias("s")).alias("p")
    mine = rows.alias("d").join(here, F.col("d.__src.source").eqNullSafe(F.col("p.of")))
    mine = mine.select("d.*", F.col("p.s.source_size").alias("source_size"), F.col("p.s.target").alias("target"), F.col("p.s.rank").alias("__rank"), F.col("p.s.stop_h").alias("__stop"), F.col("p.s.extra_h").alias("__extra"), place(F.col("d.__h"), F.col("p.s.blocks")).alias("__blk"))
    placed = mine.join(homes.select(F.col("rank").alias("__rank"), F.col("block").alias("__blk"), F.col("homes").alias("__homes")), ["__rank", "__blk"], "left")
    taken = lambda x: (x["kind"] == WHOLE) | ((x["kind"] == PART) & (F.col("__h") < F.col("__stop"))) | ((x["kind"] == EXTRA) & (F.col("__h") == F.col("__extra")))
    shards = F.transform(F.filter(F.coalesce("__homes", F.array().cast("array<struct<epoch:int,kind:int,shard:int>>")), taken), lambda x: x["shard"])
    placed = placed.withColumn("placements", shards).withColumn("copies", F.size("placements"))
    return placed.select(*[F.col(f"`{c}`") for c in base.columns], "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "placements")


def draw(mixed: DataFrame, *, seed: int = 5, key: str = "doc_id") -> DataFrame:
    """One row for each copy that :func:`mix` takes, with ``mix_shard`` and ``mix_order``, the local shuffle's key."""
    copies = mixed.select("*", F.posexplode("placements").alias("mix_copy", "mix_shard"))
    return copies.withColumn("mix_order", F.xxhash64(F.lit(seed + 3), F.col(key), "mix_copy", "mix_shard"))


def mixing_digest(df: DataFrame) -> DataFrame:
    """The contract's columns of :func:`mix`, and the shards as a comma-joined list."""
    m = mix(df)
    return m.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("placements").cast("array<string>"), ",").alias("shards"))
