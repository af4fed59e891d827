"""Language-model scores by deleted interpolation.

The probability of a word after its context is a mixture of maximum-likelihood
estimates (bigram, unigram, uniform). The mixture's weights depend on a bucket
of the context's frequency and are learned by expectation-maximisation on the
counts of texts that were deleted from the estimates' training.

Counts are gathered without a row for each token. Texts are read in chunks; a
chunk asks, in packed sorted blobs dealt by key range, for the corpus counts of
its distinct words and word pairs, and is answered in blobs of the same order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_parts, discard, give_back, id_crc, mix64
from .packing import expand, expand_sorted, squeeze, squeeze_sorted
from .tokens import encode, steps, word_hashes

PAIR_BITS = 48
#: Text of a chunk, and text whose keys one range of the counts is to hold, in bytes.
CHUNK_BYTES = 8 << 20
RANGE_BYTES = 12 << 20
#: No word has white space, so these stand for none.
END, START = (xxhash.xxh64_intdigest(x) for x in ("\n", "\t"))
#: Context frequencies 0, 1, 2, 3-4, 5-8, ... fall into buckets of their own.
BUCKETS = 40
#: Steps of a binary order of magnitude by which estimates are told apart in the statistics for the weights.
FINENESS = 4


def bucket(frequency: np.ndarray) -> np.ndarray:
    return np.where(frequency <= 0, 0, 1 + np.ceil(np.log2(np.maximum(frequency, 1)))).astype(int).clip(0, BUCKETS - 1)


class Chunk:
    """Sequences of some texts: codes of each text's words and its end, and hashes of the codes."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> None:
        self.codes, self.lengths, self.hashes = codes, lengths, hashes
        self.docs = np.repeat(np.arange(len(lengths)), lengths)
        starts = np.cumsum(lengths) - lengths
        self.before = np.empty_like(codes)
        self.before[1:] = codes[:-1]
        self.before[starts] = 1  # START has code 1, END code 0; every text has its end
        pairs = mix64(mix64(hashes[self.before]) + hashes[codes]) >> np.uint64(64 - PAIR_BITS)
        self.pairs, self.pair_of = np.unique(pairs, return_inverse=True)
        self.by_hash = np.argsort(hashes)

    @classmethod
    def of(cls, texts: pa.Array) -> Chunk:
        words, offsets, vocabulary = encode(texts)
        n = np.diff(offsets)
        seen = np.bincount(words, minlength=len(vocabulary))
        order = np.argsort(-seen, kind="stable")  # frequent words get small codes, which pack well
        code = np.empty(len(vocabulary), np.int64)
        code[order] = np.arange(2, len(vocabulary) + 2)
        lengths = n + 1
        codes = np.zeros(int(lengths.sum()), np.int64)
        codes[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = code[words] if len(words) else words
        hashes = np.concatenate([np.array([END, START], np.uint64), word_hashes(vocabulary)[order] if vocabulary else np.zeros(0, np.uint64)])
        return cls(codes, lengths, hashes)

    def asks(self, counted: np.ndarray, bits: int) -> list[tuple[str, int, bytes, bytes]]:
        """(kind, range, keys, own counts of the texts in ``counted``), keys ascending over the ranges."""
        weight = counted[self.docs].astype(float)
        words = np.bincount(self.codes, weight, minlength=len(self.hashes))
        words[1] = counted.sum()
        pairs = np.bincount(self.pair_of, weight, minlength=len(self.pairs))
        out = []
        for kind, keys, counts, width in (("w", self.hashes[self.by_hash], words[self.by_hash], 64), ("p", self.pairs, pairs, PAIR_BITS)):
            of = (keys >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            cuts = [0, *(np.nonzero(np.diff(of))[0] + 1).tolist(), len(keys)]
            out += [(kind, int(of[a]), squeeze_sorted(keys[a:z]), squeeze(counts[a:z].astype(np.uint32))) for a, z in zip(cuts, cuts[1:], strict=False) if z > a]
        return out

    def counts(self, answers: list[tuple[str, int, bytes, bytes]]) -> tuple[np.ndarray, ...]:
        """For each token the counts of itself, its context and both, by (main, deleted): arrays of shape (2, tokens)."""
        got: dict[str, list] = {"w": [], "p": []}
        for kind, _, main, held in sorted(answers, key=lambda a: (a[0], a[1])):
            got[kind].append(np.stack([expand(main, np.uint64), expand(held, np.uint64)]))
        words, pairs = (np.concatenate(got[k], axis=1).astype(np.int64) for k in ("w", "p"))
        place = np.empty(len(self.by_hash), np.int64)
        place[self.by_hash] = np.arange(len(self.by_hash))
        words = words[:, place]
        return words[:, self.codes], words[:, self.before], pairs[:, self.pair_of]


def _read(key: str, text: str, bits: int, chunk_bytes: int, arrow_key: pa.DataType):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, z in steps(batch.column(text), chunk_bytes):
                part = batch.slice(a, z - a)
                role = np.asarray(part.column("role"), dtype=np.int64)
                for held in (False, True):
                    mine = np.nonzero((role == 2) == held)[0]
                    if not len(mine):
                        continue
                    chosen = part.take(pa.array(mine))
                    c = Chunk.of(chosen.column(text))
                    n += 1
                    asks = c.asks(role[mine] > 0, bits)
                    keys = pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), chosen.column(key).cast(arrow_key))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(["texts", *["asks"] * len(asks)]), pa.array([f"{label}-{n}"] * (len(asks) + 1)), pa.array([held] * (len(asks) + 1)),
                            pa.array([None, *[x[0] for x in asks]], pa.string()), pa.array([None, *[x[1] for x in asks]], pa.int64()),
                            pa.array([squeeze(c.codes.astype(np.uint32)), *[x[2] for x in asks]], pa.binary()), pa.array([squeeze(c.lengths.astype(np.uint32)), *[x[3] for x in asks]], pa.binary()),
                            pa.array([squeeze(c.hashes), *[None] * len(asks)], pa.binary()), pa.concat_arrays([keys, pa.nulls(len(asks), keys.type)]),
                        ],
                        names=["part", "chunk", "held", "kind", "rng", "a", "b", "hashes", "keys"],
                    )

    return run


def _answer(where: tuple, asks: pa.Table) -> pa.Table:
    """Sums of a range over all chunks, for each chunk in the order of its keys; and the range's totals."""
    keys = [expand_sorted(b) for b in asks.column("a").to_pylist()]
    own = np.concatenate([expand(b, np.uint32) for b in asks.column("b").to_pylist()]).astype(float)
    held = np.repeat(np.asarray(asks.column("held").combine_chunks().cast(pa.int8())).astype(bool), [len(k) for k in keys])
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    main = np.bincount(inverse, own * ~held, minlength=len(distinct)).astype(np.uint64)
    deleted = np.bincount(inverse, own * held, minlength=len(distinct)).astype(np.uint64)
    at, a, b = 0, [], []
    for k in keys:
        mine = inverse[at : at + len(k)]
        a.append(squeeze(main[mine]))
        b.append(squeeze(deleted[mine]))
        at += len(k)
    words = where[0].as_py() == "w"
    real = (distinct != np.uint64(START)) & words
    totals = [int(main[real].sum()), int(deleted[real].sum()), int(((main + deleted)[real] > 0).sum())]
    n = len(keys)
    return pa.table({
        "chunk": pa.array([*asks.column("chunk").to_pylist(), None], pa.string()), "held": pa.array([*asks.column("held").to_pylist(), None], pa.bool_()),
        "kind": pa.array([where[0].as_py()] * (n + 1)), "rng": pa.array([where[1].as_py()] * (n + 1), pa.int64()),
        "main": pa.array([*a, None], pa.binary()), "deleted": pa.array([*b, None], pa.binary()), "totals": pa.array([*[None] * n, totals], pa.list_(pa.int64())),
    })


def _chunk_of(texts: pa.Table) -> Chunk:
    t = texts.slice(0, 1)
    return Chunk(expand(t["a"][0].as_py(), np.uint32).astype(np.int64), expand(t["b"][0].as_py(), np.uint32).astype(np.int64), expand(t["hashes"][0].as_py(), np.uint64))


def _answers(t: pa.Table) -> list[tuple[str, int, bytes, bytes]]:
    return list(zip(t["kind"].to_pylist(), t["rng"].to_pylist(), t["main"].to_pylist(), t["deleted"].to_pylist(), strict=True))


def estimates(word: np.ndarray, context: np.ndarray, pair: np.ndarray, total: int, kinds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Maximum-likelihood estimates: of the pair given its context, of the word, and the uniform one (an unknown word is one kind more)."""
    return pair / np.maximum(context, 1), word / max(total, 1), 1.0 / (kinds + 1)


def learn_weights(cells: list[tuple[int, int | None, int | None, int]], uniform: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights (pair, word, uniform) by bucket of the context's frequency.

    ``cells`` are the deleted texts' tokens counted by bucket and by the
    estimates' orders of magnitude. Every bucket is drawn a little to the
    weights of all buckets, so that empty ones are defined.
    """
    start = np.array([0.55, 0.4, 0.05])
    if not cells:
        weights = np.tile(start, (BUCKETS, 1))
        weights[0] = [0, 0.9, 0.1]
        return weights
    level = lambda q: 0.0 if q is None else 2.0 ** (-q / FINENESS)
    b = np.array([c[0] for c in cells])
    p = np.array([[level(c[1]), level(c[2]), uniform] for c in cells])
    n = np.array([c[3] for c in cells], dtype=float)
    every = start.copy()
    for _ in range(rounds):
        share = p * every
        every = (n[:, None] * share / share.sum(1, keepdims=True)).sum(0)
        every /= every.sum()
    weights = np.tile(every, (BUCKETS, 1))
    for _ in range(rounds):
        share = p * weights[b]
        share = n[:, None] * share / np.maximum(share.sum(1, keepdims=True), 1e-300)
        for k in range(3):
            weights[:, k] = np.bincount(b, share[:, k], minlength=BUCKETS) + 2.0 * every[k]
        weights /= weights.sum(1, keepdims=True)
    weights[0, 0] = 0.0
    weights[:, 2] = np.maximum(weights[:, 2], 1e-7)
    return weights / weights.sum(1, keepdims=True)


def score_corpus(df: DataFrame, trained: Column, *, key: str = "doc_id", text: str = "text", deleted_one_in: int = 16, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES, seed: int = 4) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row of ``df``.

    The model learns from the rows where ``trained`` holds; of these, one in
    ``deleted_one_in`` by a seeded hash of the key is deleted from the
    estimates while the weights are learned, and added for the scores. Tokens
    are words and an end of each text; null and empty texts are an end alone.
    ``base_score`` is add-one smoothing of single tokens, both scores are sums
    of log10 probabilities. Repeated rows stay and count; null keys are kept;
    other columns are ignored; an empty table gives an empty result.
    """
    deleted = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(deleted_one_in)) == 0
    role = F.when(~F.coalesce(trained, F.lit(False)), 0).when(deleted, 2).otherwise(1).cast("long")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), role.alias("role"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / range_bytes))))
    kind = rows.schema["key"].dataType.simpleString()
    arrow_key = rows.select("key").limit(0).toArrow().schema.field("key").type
    read = rows.mapInArrow(_read("key", "text", bits, chunk_bytes, arrow_key), f"part string, chunk string, held boolean, kind string, rng long, a binary, b binary, hashes binary, keys array<{kind}>")
    parts = cut_parts(read, "part", ("texts", "asks"), "lm-read")
    texts, asks = parts["texts"], parts["asks"]
    answers = cut_parts(asks.groupBy("kind", "rng").applyInArrow(_answer, "chunk string, held boolean, kind string, rng long, main binary, deleted binary, totals array<long>").withColumn("part", F.when(F.col("chunk").isNull(), "totals").otherwise("answers")), "part", ("answers", "totals"), "lm-answers")
    discard(asks)
    got = answers["totals"].filter("kind = 'w'").agg(*[F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)) for i in range(3)]).first()
    main, held, kinds = int(got[0]), int(got[1]), int(got[2])
    total = main + held
    uniform = 1.0 / (kinds + 1)
    given = answers["answers"].select("chunk", "held", "kind", "rng", "main", "deleted")

    def tally(t: pa.Table, a: pa.Table) -> pa.Table:
        rows: dict[tuple[int, int, int], int] = {}
        if t.num_rows and a.num_rows:
            word, context, pair = _chunk_of(t).counts(_answers(a))
            give_back()
            p2, p1, _ = estimates(word[0], context[0], pair[0], main, kinds)
            order = lambda p: np.where(p > 0, np.rint(-np.log2(np.maximum(p, 1e-30)) * FINENESS), -1).astype(np.int64)
            cells, n = np.unique(np.stack([bucket(context[0]), order(p2), order(p1)]), axis=1, return_counts=True)
            rows = dict(zip(map(tuple, cells.T.tolist()), n.tolist(), strict=True))
        b, q2, q1 = zip(*rows, strict=True) if rows else ((), (), ())
        some = lambda q: pa.array([None if x < 0 else x for x in q], pa.int64())
        return pa.table({"b": pa.array(b, pa.int64()), "q2": some(q2), "q1": some(q1), "n": pa.array(list(rows.values()), pa.int64())})

    stats = texts.filter("held").groupBy("chunk").cogroup(given.filter("held").groupBy("chunk")).applyInArrow(tally, "b long, q2 long, q1 long, n long")
    # As many cells at most as there are buckets and orders of magnitude, whatever the corpus.
    cells = [tuple(r) for r in stats.groupBy("b", "q2", "q1").agg(F.sum("n").alias("n")).orderBy("b", "q2", "q1").collect()]
    weights = learn_weights(cells, uniform)

    def score(t: pa.Table, a: pa.Table) -> pa.Table:
        c = _chunk_of(t)
        word, context, pair = (x.sum(axis=0) for x in c.counts(_answers(a)))
        give_back()
        p2, p1, p0 = estimates(word, context, pair, total, kinds)
        w = weights[bucket(context)]
        model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
        base = np.log10((word + 1) / (total + 1 * (kinds + 1)))
        add = lambda v: np.bincount(c.docs, v, minlength=len(c.lengths))
        return pa.table({"key": t["keys"].combine_chunks().flatten(), "n_tokens": pa.array(c.lengths), "n_known": pa.array(add((word > 0).astype(float)).astype(np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(model))})

    scored = texts.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(score, f"key {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def lm_digest(documents: DataFrame) -> DataFrame:
    held_out = id_crc(F.col("doc_id")) % 7 == 2
    scored = score_corpus(documents, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
