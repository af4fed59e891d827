"""Jaccard self-join of word n-gram sets by a grouped prefix join.

Documents with equal sets are one node. Under one global order of the shingles
(rare ones first) two similar sets share a shingle of their prefixes; nodes
with identical prefixes and sizes are collapsed into one group. Group pairs
that share prefix shingles are filtered by size and by the number they must
share; what remains is expanded to its members, whose whole sets are verified.

The order puts a fixed share of the hash space first and sorts it by the
shingles' frequency in the whole corpus, so that frequencies are gathered for
that share only: chunks of texts ask for the counts of their shingles in
packed sorted blobs dealt by key range. A shingle that one text alone has
leads to no other and is left out of the index.

Links of dense groups are never all written. Members of a large candidate
group are first compared within blocks and with a few leaders that visit all
blocks; only what stays outside the largest class is then compared with the
rest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_parts, discard, discard_since, give_back, so_far
from .components import components
from .packing import expand, expand_sorted, squeeze, squeeze_sorted
from .tokens import encode, gram_hashes, steps, word_hashes

#: Shingles are compared by hashes of so many bits; the index has their upper bits.
ID_BITS, INDEX_BITS = 56, 48
#: Text of a chunk, and text whose shingles one range of the counts is to hold, in bytes.
CHUNK_BYTES = 2 << 20
RANGE_BYTES = 12 << 20
#: Ids in one row of a chunk's sets.
ROW_IDS = 1 << 14
#: A prefix shingle of up to so many groups gives their pairs; groups of others join the first of their band of sizes.
PAIRED = 64
#: Rows whose addresses (some 60 bytes each) are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Shingles that one verification task holds; larger candidate groups are split into blocks.
TASK_SHINGLES = 1 << 18
#: Members of a large candidate group that are compared with all others first.
LEADERS = 4


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle ids of each text: of all its n-word windows, or of the whole if it is shorter."""
    codes, offsets, vocabulary = encode(texts)
    hashes = word_hashes(vocabulary)[codes] if len(codes) else np.zeros(0, np.uint64)
    grams = gram_hashes(hashes, n) >> np.uint64(64 - ID_BITS)
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if z - a >= n:
            yield np.unique(grams[a : z - n + 1])
        else:
            yield gram_hashes(hashes[a:z], z - a) >> np.uint64(64 - ID_BITS) if z > a else np.zeros(0, np.uint64)


class Order:
    """The global order: ids below ``first`` by frequency, then the others; both by hash within."""

    def __init__(self, num: int, den: int, text_bytes: int) -> None:
        self.num, self.den = num, den
        share = min(1.0, 2.5 * (den - num) / den)
        self.first = np.uint64(int(share * 2**INDEX_BITS))
        # Counters for some 30 times the shingles there can be, so that few share one.
        width = min(INDEX_BITS, max(24, math.ceil(math.log2(max(text_bytes, 1))) + 3))
        self.drop = np.uint64(INDEX_BITS - width)
        ranges = max(0, math.ceil(math.log2(max(1.0, text_bytes * share / RANGE_BYTES))))
        self.ranges = np.uint64(max(0, width - ranges))

    def prefix_length(self, size: int) -> int:
        return size - (self.num * size + self.den - 1) // self.den + 1

    def leading(self, ids: np.ndarray) -> np.ndarray:
        """Of a sorted set what its prefix can hold, as index ids: all below ``first``, or more if these are too few."""
        short = ids >> np.uint64(ID_BITS - INDEX_BITS)
        return short[: max(int(np.searchsorted(short, self.first)), self.prefix_length(len(ids)))]

    def counters(self, leading: np.ndarray) -> np.ndarray:
        return leading[leading < self.first] >> self.drop

    def ranks(self, leading: np.ndarray, asked: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Places in the order: the frequency above the id; ids beyond ``first`` after all others."""
        inside = leading < self.first
        above = np.full(len(leading), 1 << 14, np.int64)
        above[inside] = codes[np.searchsorted(asked, leading[inside] >> self.drop)]
        return (above << INDEX_BITS) + leading.astype(np.int64)


def frequency_code(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact to 63, then in eighths of a doubling."""
    large = 64 + 8 * np.log2(np.maximum(counts, 64) / 64)
    return np.where(counts < 64, counts, np.minimum(large, 255)).astype(np.uint8)


def _read_sets(key_type: pa.DataType, key: str, text: str, n: int, order: Order) -> Callable:
    """Of each chunk its rows, its distinct sets, what their prefixes can hold, and the counts it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, chunk = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.column(key)
            for a, z in steps(batch.column(text), CHUNK_BYTES):
                chunk += 1
                yield from of(f"{label}-{chunk}", keys.slice(a, z - a), batch.column(text).slice(a, z - a))

    def of(chunk: str, keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        nodes, sizes, distinct = [], [], {}
        for ids in shingle_sets(texts, n):
            node = xxhash.xxh3_128_digest(ids.tobytes()) if len(ids) else None
            if node is not None and node not in distinct:
                distinct[node] = ids
            nodes.append(node)
            sizes.append(len(ids))
        yield rows("docs", chunk, len(nodes), key=keys.cast(key_type), node=nodes, size=sizes)
        if not distinct:
            return
        held = list(distinct.values())
        yield rows("sets", chunk, len(held), node=list(distinct), size=[len(s) for s in held], a=[squeeze_sorted(s) for s in held])
        leading = [order.leading(s) for s in held]
        sizes = np.array([(len(s), len(x)) for s, x in zip(held, leading, strict=True)], np.uint32)
        names = list(distinct)
        # Some rows of a bounded length each; a long set is a row of its own.
        turn = np.cumsum(sizes[:, 1], dtype=np.int64) // ROW_IDS
        cuts = [0, *(np.nonzero(np.diff(turn))[0] + 1).tolist(), len(held)]
        parts = list(zip(cuts, cuts[1:], strict=False))
        yield rows("leading", chunk, len(parts), node=[b"".join(names[x:y]) for x, y in parts], a=[squeeze_sorted(np.concatenate(leading[x:y])) for x, y in parts], b=[squeeze(sizes[x:y].ravel()) for x, y in parts])
        asked, counts = np.unique(order.counters(np.concatenate(leading)), return_counts=True)
        of = (asked >> order.ranges).astype(np.int64)
        cuts = [0, *(np.nonzero(np.diff(of))[0] + 1).tolist(), len(asked)] if len(asked) else [0]
        parts = list(zip(cuts, cuts[1:], strict=False))
        yield rows("asks", chunk, len(parts), size=[int(of[x]) for x, _ in parts], a=[squeeze_sorted(asked[x:y]) for x, y in parts], b=[squeeze(counts[x:y].astype(np.uint32)) for x, y in parts])
        give_back()

    def rows(part: str, chunk: str, m: int, key: pa.Array | None = None, **of: list) -> pa.RecordBatch:
        kinds = {"node": pa.binary(), "size": pa.int64(), "a": pa.binary(), "b": pa.binary()}
        columns = [pa.array(of[k], t) if k in of else pa.nulls(m, t) for k, t in kinds.items()]
        return pa.RecordBatch.from_arrays([pa.array([part] * m, pa.string()), pa.array([chunk] * m, pa.string()), pa.nulls(m, key_type) if key is None else key, *columns], names=["part", "chunk", "key", *kinds])

    return run


def _answer(where: tuple, asks: pa.Table) -> pa.Table:
    """The frequencies of a range over all chunks, for each chunk in the order of its counters."""
    keys = [expand_sorted(b) for b in asks.column("a").to_pylist()]
    own = np.concatenate([expand(b, np.uint32) for b in asks.column("b").to_pylist()])
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    codes = frequency_code(np.bincount(inverse, own, minlength=len(distinct)))[inverse]
    ends = np.cumsum([len(k) for k in keys])
    out = [squeeze(c) for c in np.split(codes, ends[:-1])]
    give_back()
    return pa.table({"chunk": asks.column("chunk"), "rng": pa.array([where[0].as_py()] * len(keys), pa.int64()), "codes": pa.array(out, pa.binary())})


def _prefixes(order: Order) -> Callable:
    """Of each set of a chunk that shares a prefix shingle: its group of prefix and size, and what of the prefix is indexed."""

    def run(leading: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("node", "size", "grp", "last", "spare", "prefix")}
        chunk = leading.column("chunk")[0].as_py() if leading.num_rows else None
        held = [expand_sorted(b) for b in leading.column("a").to_pylist()]
        asked = np.unique(order.counters(np.concatenate(held))) if held else np.zeros(0, np.uint64)
        got = sorted(zip(answers.column("rng").to_pylist(), answers.column("codes").to_pylist(), strict=True))
        codes = np.concatenate([expand(c, np.uint8) for _, c in got]) if got else np.zeros(0, np.uint8)
        for names, flat, lengths in zip(leading.column("node").to_pylist(), held, leading.column("b").to_pylist(), strict=True):
            sizes = expand(lengths, np.uint32).reshape(-1, 2).astype(np.int64)
            ranks = order.ranks(flat, asked, codes)
            ends = np.cumsum(sizes[:, 1])
            alone = np.int64(2) << np.int64(INDEX_BITS)
            for i, (size, length) in enumerate(sizes.tolist()):
                mine = np.sort(ranks[ends[i] - length : ends[i]])[: order.prefix_length(size)]
                shared = mine[mine >= alone]
                if not len(shared):
                    continue
                indexed = np.unique(shared)
                out["node"].append(names[16 * i : 16 * i + 16])
                out["size"].append(size)
                out["grp"].append(xxhash.xxh3_64_intdigest(mine.tobytes(), seed=size) - (1 << 63))
                out["last"].append(int(mine[-1]))
                out["spare"].append(len(shared) - len(indexed))
                out["prefix"].append(indexed)
        give_back()
        kinds = {"node": pa.binary(), "prefix": pa.list_(pa.int64())}
        return pa.table({"chunk": pa.array([chunk] * len(out["node"]), pa.string())} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return run


def link(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """For each set the index of a set that stands for its connected component.

    A set is compared with all others at once, by counting along inverted
    lists. The largest component never has to be compared itself: it is whole
    as soon as all sets outside of it have been.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    ids, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(m), sizes)
    order = np.argsort(codes, kind="stable")
    lists, ends = owners[order], np.cumsum(np.bincount(codes, minlength=len(ids)))
    starts, offsets = np.concatenate([[0], ends[:-1]]), np.concatenate([[0], np.cumsum(sizes)])
    root, done = np.arange(m), np.zeros(m, dtype=bool)
    members = np.ones(m, dtype=int)
    while True:
        largest = int(members.argmax())
        todo = np.nonzero(~done & (root != largest))[0]
        if not len(todo):
            return root.tolist()
        for i in todo.tolist():
            if root[i] == members.argmax():
                continue
            done[i] = True
            mine = codes[offsets[i] : offsets[i + 1]]
            shared = np.bincount(np.concatenate([lists[starts[c] : ends[c]] for c in mine.tolist()]), minlength=m)
            near = np.nonzero(den * shared >= num * (sizes[i] + sizes - shared))[0]
            roots = np.unique(root[near])
            if len(roots) > 1:
                into = int(roots[members[roots].argmax()])
                root[np.isin(root, roots)] = into
                members[into] = members[roots].sum()
                members[roots[roots != into]] = 0

def link_across(some: list[np.ndarray], others: list[np.ndarray], mine: list, theirs: list, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs (of some, of others) that are similar and of different classes, one for each class that a set of ``some`` reaches."""
    ids, codes = np.unique(np.concatenate(others), return_inverse=True)
    sizes = np.array([len(s) for s in others])
    owners = np.repeat(np.arange(len(others)), sizes)
    lists, ends = owners[np.argsort(codes, kind="stable")], np.cumsum(np.bincount(codes, minlength=len(ids)))
    starts = np.concatenate([[0], ends[:-1]])
    out = []
    for i, s in enumerate(some):
        at = np.searchsorted(ids, s)
        at = at[(at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == s)]
        if not len(at):
            continue
        shared = np.bincount(np.concatenate([lists[starts[c] : ends[c]] for c in at.tolist()]), minlength=len(others))
        near = np.nonzero(den * shared >= num * (len(s) + sizes - shared))[0]
        reached = {theirs[j]: (i, j) for j in near.tolist() if theirs[j] != mine[i]}
        out += reached.values()
    return out


def candidate_groups(groups: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root) of the groups that may hold linked members, by candidate group.

    Takes (grp, size, last, spare, prefix). Pairs that share an indexed
    shingle of up to ``PAIRED`` groups are filtered by size and by what they
    must share. In larger buckets every group joins the first group of its
    band of sizes, and bands next to each other are joined: a superset of all
    links, in rows that grow with the bucket and not with its square.
    """
    entries = cut(groups.select("grp", "size", "last", "spare", F.explode("prefix").alias("id")), "entries")
    met = entries.groupBy("id").agg(F.count("*").alias("groups")).filter("groups > 1")
    met = cut_parts(met.withColumn("part", F.when(F.col("groups") > PAIRED, "large").otherwise("small")), "part", ("small", "large"), "buckets")
    compatible = lambda small, big: big * num <= small * den
    one = F.struct("size", "grp", "last", "spare")
    few = entries.join(met["small"].select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    few = few.select("all", F.posexplode("all").alias("i", "x"))
    few = few.select("x", F.explode(F.filter(F.slice("all", F.col("i") + 2, PAIRED), lambda o: compatible(F.col("x.size"), o["size"]))).alias("y"))
    sides = [F.col(f"x.{c}").alias(f"{c}1") for c in ("grp", "size", "last", "spare")] + [F.col(f"y.{c}").alias(f"{c}2") for c in ("grp", "size", "last", "spare")]
    pairs = few.select(*sides).groupBy("grp1", "grp2", "size1", "size2", "last1", "last2", "spare1", "spare2").agg(F.count("*").alias("shared"))
    overlap = F.ceil(F.lit(float(num)) * (F.col("size1") + F.col("size2")) / F.lit(float(num + den)) - 1e-9)
    # Of the set whose prefix ends first, all that it shares up to there has been counted, but for ids that fell together.
    rest = lambda s: F.ceil(F.col(s) * float(num) / float(den) - 1e-9) - 1
    beyond = F.when(F.col("last1") < F.col("last2"), rest("size1")).when(F.col("last1") > F.col("last2"), rest("size2")).otherwise(F.least(rest("size1"), rest("size2")))
    edges = pairs.filter(F.col("shared") + F.least("spare1", "spare2") + beyond >= overlap).select(F.col("grp1").alias("a"), F.col("grp2").alias("b"))

    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(den / num))) if num < den else F.col("size")
    many = entries.join(met["large"].select("id"), "id", "left_semi").select("id", "grp", band.cast("long").alias("band"))
    first = cut(many.groupBy("id", "band").agg(F.min("grp").alias("first")), "firsts")
    stars = many.join(first, ["id", "band"]).select(F.col("grp").alias("a"), F.col("first").alias("b"))
    # Rounding may put a size on the other side of a band's edge: bands up to two apart are joined.
    apart = first.select("id", F.explode(F.array(F.col("band") + 1, F.col("band") + 2)).alias("band"), F.col("first").alias("a")).join(first, ["id", "band"]).select("a", F.col("first").alias("b"))
    return components(edges.unionByName(stars).unionByName(apart), "a", "b")


def verified(sets: DataFrame, wanted: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root) by class of linked nodes, from candidate groups (node, chunk, cand, size, weight)."""
    bounded = wanted.count() <= BROADCAST_ROWS
    blocks = F.ceil(F.col("weight") / F.lit(TASK_SHINGLES)).cast("int")
    wanted = wanted.withColumn("blocks", blocks)
    large = wanted.filter("blocks > 1")
    split = not large.isEmpty()
    hashed = F.xxhash64("node")
    leaders = large.groupBy("cand", F.pmod(hashed, F.lit(LEADERS)).alias("turn")).agg(F.min(F.struct(hashed.alias("h"), "node")).alias("m")).select(F.col("m.node").alias("node"), F.lit(True).alias("leads"))
    if split:
        wanted = cut(wanted.join(cut(leaders, "leaders"), "node", "left"), "wanted")
    else:
        wanted = wanted.withColumn("leads", F.lit(None).cast("boolean"))

    def held(some: DataFrame) -> DataFrame:
        return sets.select("node", "chunk", F.col("a").alias("ids")).join(F.broadcast(some) if bounded else some, ["node", "chunk"])

    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    visits = F.when(F.col("leads"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    first = held(wanted).select("cand", "node", "ids", F.explode(visits).alias("i"))

    def within(t: pa.Table) -> pa.Table:
        names = t.column("node").to_pylist()
        roots = link([expand_sorted(p) for p in t.column("ids").to_pylist()], num, den)
        give_back()
        return pa.table({"node": pa.array(names, pa.binary()), "root": pa.array([names[r] for r in roots], pa.binary())})

    links = cut(first.groupBy("cand", "i").applyInArrow(within, "node binary, root binary"), "links")
    edges = links.filter("node <> root")
    if not split:
        return edges.unionByName(edges.select(F.col("root").alias("node"), "root").distinct())
    classes = components(edges, "node", "root")
    members = wanted.filter("blocks > 1").join(classes, "node", "left").select("cand", "node", "chunk", "size", "weight", F.coalesce("root", "node").alias("root"))
    members = cut(members, "members")
    heaviest = members.groupBy("cand", "root").agg(F.sum("size").alias("w")).groupBy("cand").agg(F.max_by("root", F.struct("w", "root")).alias("main"))
    rest = members.join(heaviest, "cand").filter("root <> main").groupBy("cand").agg(F.sum("size").alias("loose"))
    rest = cut(rest.join(heaviest, "cand"), "rest")
    if rest.isEmpty():
        return classes
    part = lambda w: F.ceil(F.col(w) / F.lit(TASK_SHINGLES)).cast("int")
    todo = cut(members.join(rest, "cand").withColumns({"rows": part("loose"), "columns": part("weight")}).select("cand", "node", "chunk", "root", "main", "rows", "columns"), "todo")
    place = lambda salt, of: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(of)).cast("int")
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    whole = held(todo)
    column = whole.select("cand", "node", "root", "ids", F.lit(False).alias("asks"), place(3, "columns").alias("j"), F.explode(every("rows")).alias("i"))
    row = whole.filter("root <> main").select("cand", "node", "root", "ids", F.lit(True).alias("asks"), F.explode(every("columns")).alias("j"), place(2, "rows").alias("i"))

    def across(t: pa.Table) -> pa.Table:
        asks = np.asarray(t.column("asks").combine_chunks().cast(pa.int8())).astype(bool)
        sides = [t.filter(pa.array(m)) for m in (asks, ~asks)]
        (n1, r1, s1), (n2, r2, s2) = ((x.column("node").to_pylist(), x.column("root").to_pylist(), [expand_sorted(p) for p in x.column("ids").to_pylist()]) for x in sides)
        found = link_across(s1, s2, r1, r2, num, den) if s1 and s2 else []
        give_back()
        return pa.table({"node": pa.array([n1[i] for i, _ in found], pa.binary()), "root": pa.array([n2[j] for _, j in found], pa.binary())})

    more = cut(column.unionByName(row).groupBy("cand", "i", "j").applyInArrow(across, "node binary, root binary"), "more")
    return components(edges.unionByName(more), "node", "root")


def jaccard_components(df: DataFrame, *, n: int = 4, num: int = 85, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``df``.

    Rows are linked if den * |intersection| >= num * |union| of their sets of
    distinct ``n``-word shingles (the whole text as one if it has fewer words;
    words are runs of anything but ASCII white space, A-Z in lower case).
    ``component_id`` is the smallest key that links reach, the own included.
    Null, empty and blank texts have no shingles, are linked with nothing and
    keep their own key. Rows with the same text or key all stay; a null key
    gets the smallest other key of its component, else null. Other columns are
    ignored; an empty table gives an empty result. Shingles are compared by
    56-bit hashes.
    """
    spark, mark = df.sparkSession, so_far(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()
    arrow_key = rows.select("key").limit(0).toArrow().schema.field("key").type
    order = Order(num, den, int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0))
    read = rows.mapInArrow(_read_sets(arrow_key, "key", "text", n, order), f"part string, chunk string, key {key_type}, node binary, size long, a binary, b binary")
    parts = cut_parts(read, "part", ("docs", "sets", "leading", "asks"), "shingles")
    answers = cut(parts["asks"].select(F.col("size").alias("rng"), "chunk", "a", "b").groupBy("rng").applyInArrow(_answer, "chunk string, rng long, codes binary"), "answers")
    discard(parts["asks"])
    leading = parts["leading"].select("chunk", "node", "a", "b")
    found = leading.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_prefixes(order), "chunk string, node binary, size long, grp long, last long, spare long, prefix array<long>")
    found = cut(found, "prefixes")
    for done in (parts["leading"], answers):
        discard(done)

    groups = found.groupBy("grp", "size").agg(F.first(F.struct("last", "spare", "prefix")).alias("g")).select("grp", "size", "g.*")
    candidates = candidate_groups(groups, num, den)
    nodes = found.groupBy("node", "size", "grp").agg(F.min("chunk").alias("chunk"))
    nodes = cut(nodes.join(candidates, nodes["grp"] == candidates["node"], "left").select(nodes["node"], "size", "chunk", F.coalesce("root", "grp").alias("cand")), "nodes")
    # Written first, so that the join can split a candidate group that holds many nodes.
    weight = cut(nodes.groupBy("cand").agg(F.sum("size").alias("weight"), F.count("*").alias("members")).filter("members > 1").drop("members"), "weights")
    joined = verified(parts["sets"], cut(nodes.join(weight, "cand"), "wanted"), num, den)

    docs = parts["docs"].select("key", "size", "node")
    low = docs.filter("size > 0").groupBy("node").agg(F.min("key").alias("low"))
    classes = cut(low.join(joined, "node").select("node", "low", "root"), "joined")
    best = classes.groupBy("root").agg(F.min("low").alias("best"))
    # Nodes that are linked with no other take their own smallest key.
    linked = classes.join(best, "root").select("node", "best")
    ids = cut(low.join(linked, "node", "left").select("node", F.coalesce("best", "low").alias("component_id")), "classes")
    discard(parts["sets"])
    discard_since(spark, mark, parts["docs"], ids)
    out = docs.join(ids, "node", "left")
    return out.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def ngram_join_digest(documents: DataFrame) -> DataFrame:
    return jaccard_components(documents)
